"""Connected components of a link table: star steps while it is large, one task once it is small.

Neither links nor labels pass through the driver. Large tables take alternating large-star and
small-star steps; nodes with very many links appear there as join keys only, which adaptive
execution splits, and in aggregations that combine on the map side. Of the rounds' tables the last
is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import delete_folder, fresh_folder, materialize, tidy

SMALL = 2_000_000  # links, 32 MB, that one task may hold


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``edges`` (a, b): links of any direction, repeats and loops allowed. Returns (node, root).

    ``root`` is the smallest node reachable. Nodes without a link to another one are not listed.
    Links with a null end are ignored; without links there are no rows. ``small`` is the number of
    links that are joined up in one task.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    path = fresh_folder(spark, "links")
    links, before = materialize(both, "links", path), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= small:
            return materialize(links.coalesce(1).mapInArrow(tidy(_joined_up), "node long, root long"), "roots")
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, path, before = path, fresh_folder(spark, "links"), state
        links = materialize(_small_star(_large_star(links)), "links", path)
        delete_folder(spark, last)


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of all nodes of a small table: least labels along links, then along labels, until nothing moves."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    u, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while True:
            next_ = root[root]
            if np.array_equal(next_, root):
                break
            root = next_
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)], pa.int64()), pa.array(nodes[root[at : at + (1 << 16)]], pa.int64())], names=["node", "root"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbourhood."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
