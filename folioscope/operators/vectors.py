"""Vector search by a stored, partitioned index with filters inside; ``retrieval.vector_search`` is the exact one.

Vectors are stored by the nearest of about the square root of their number of centroids, which are
fitted on a bounded sample; long lists are cut into blocks, so that a list with a third of all
vectors is many tasks' work. A census says how many chunks of each paper, version and type a list
holds. A question visits lists in the order of their centroids: as many as the sample asks for, and
more until they hold enough chunks that its scope allows, so that a narrow scope looks further. What
is visited is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.arrow import arrow_schema
from folioscope.operators.retrieval import _nearest
from folioscope.operators.scopes import META, SCOPE, best, scope_condition

SAMPLE, LISTS, BLOCK, ENOUGH, TARGET, SEED = 20_000, 4096, 4096, 20, 0.97, 11


@dataclass
class VectorIndex:
    """``rows`` (list, block, chunk_id, embedding, ...), ``census`` (list, paper_id, ..., n), ``blocks`` (list, blocks); unit ``centroids``, lists that are visited at least."""

    rows: DataFrame
    census: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    probes: int

    def visits(self, questions: DataFrame, limit: int) -> DataFrame:
        """(query_id, list): what each question looks at."""
        centroids, kind = self.centroids, dict(questions.dtypes)["query_id"]
        schema = f"query_id {kind}, lists array<int>"
        out = arrow_schema(schema)

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = [np.argsort(-(centroids @ np.asarray(v, np.float32)), kind="stable") if len(v) == centroids.shape[1] else [] for v in batch.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(near, out.field("lists").type)], schema=out)

        near = questions.where("embedding is not null").select("query_id", "embedding").mapInArrow(order, schema)
        placed = near.select("query_id", F.posexplode("lists").alias("place", "list"))
        scope = [c for c in SCOPE if c in questions.columns]
        held = self.census
        if scope:
            asked = questions.select("query_id", *scope).dropDuplicates(["query_id"])
            # a scope names few papers and versions: what it allows in each list, by a join with the census
            held = asked.join(held, scope_condition(scope)).groupBy("query_id", "list").agg(F.sum("n").alias("n"))
            placed = placed.join(held, ["query_id", "list"])
        else:
            placed = placed.join(held.groupBy("list").agg(F.sum("n").alias("n")), "list")
        before = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        seen = placed.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return seen.where((F.col("place") < self.probes) | (F.col("seen") < ENOUGH * limit)).select("query_id", "list")

    def search(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, chunk_id, score, rank) by cosine, of questions as ``retrieval.vector_search`` takes them.

        Scores are exact; which chunks are seen is not. A question whose scope allows up to
        ``ENOUGH`` times ``limit`` chunks sees all of them.
        """
        if limit <= 0:
            raise ValueError("a limit must be positive")
        scope = [c for c in SCOPE if c in questions.columns]
        kinds = dict(self.rows.dtypes)
        schema = f"query_id {dict(questions.dtypes)['query_id']}, chunk_id {kinds['chunk_id']}, score double"
        pairs = self.visits(questions, limit).join(self.blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = pairs.select("query_id", "list", "block").join(questions.select("query_id", "embedding", *scope), "query_id")

        def look(asked: pa.Table, rows: pa.Table) -> pa.Table:
            block = []
            for q in asked.to_pylist():
                lists = [frozenset(q[c]) if q.get(c) else None for c in SCOPE[:2]]
                block.append((q["query_id"], np.array(q["embedding"], float), *lists, "include_references" not in scope or bool(q["include_references"])))
            own = rows.drop_columns(["list", "block"]).combine_chunks().to_batches()
            return pa.Table.from_batches(list(_nearest(block, limit, "cosine", out)(iter(own))))

        out = arrow_schema(schema)
        meta = [c for c in META if c in kinds] if scope else []
        found = sent.groupBy("list", "block").cogroup(self.rows.select("list", "block", "chunk_id", "embedding", *meta).groupBy("list", "block")).applyInArrow(look, schema)
        return best(found, limit)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def fit(sample: np.ndarray, total: int, k: int = 10) -> tuple[np.ndarray, int]:
    """Unit centroids by spherical k-means over a sample of unit vectors, and the lists that hold ``TARGET`` of its nearest ``k``."""
    rng = np.random.default_rng(SEED)
    lists = int(max(1, min(LISTS, len(sample) // 20, round(total**0.5))))
    centers = sample[np.sort(rng.choice(len(sample), lists, replace=False))]
    own = np.zeros(len(sample), int)
    for _ in range(8):
        own = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=lists) > 0
        centers = np.where(filled[:, None], _unit(sums), centers)
    own = (sample @ centers.T).argmax(1)
    asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
    near = np.argsort(-(sample[asked] @ sample.T), axis=1)[:, 1 : k + 1]
    rank = np.argsort(np.argsort(-(sample[asked] @ centers.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(TARGET * len(needed)))]) + 1 if len(needed) else lists
    return centers.astype(np.float32), probes


def build_vector_index(vectors: DataFrame, folder: str, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of vectors (chunk_id, embedding, and any of paper_id, version_id, content_type) below ``folder``.

    Null vectors, zero ones, those with components that aren't finite, and those of another length
    than most are left out, as no cosine finds them. At most twice ``sample`` vectors come to the driver.
    """
    spark: SparkSession = vectors.sparkSession
    meta = [c for c in META if c in vectors.columns]
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), *meta)
    sizes = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        raise ValueError("there is no vector to index")
    dim, total = sizes[0]["size"], sizes[0]["count"]
    good = good.where(F.size("embedding") == dim)
    share = min(1.0, sample / total)
    drawn = good.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("embedding").limit(2 * sample).collect()
    if len(drawn) < 2:
        drawn = good.select("embedding").limit(1000).collect()
    centroids, probes = fit(_unit(np.array([r[0] for r in drawn], float)), total)
    schema = f"{', '.join(f'{c} {k}' for c, k in good.dtypes)}, list int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ centroids.T).argmax(1).astype(np.int32))], names=[*batch.schema.names, "list"])

    good.mapInArrow(assign, schema).write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    census = assigned.groupBy("list", *meta).agg(F.count("*").alias("n"))
    census.write.parquet(f"{folder}/census")
    blocks = spark.read.parquet(f"{folder}/census").groupBy("list").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    blocks.write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    block = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    placed = assigned.join(F.broadcast(blocks), "list").withColumn("block", block).drop("blocks")  # at most LISTS rows
    placed.repartitionByRange("list", "block").sortWithinPartitions("list", "block").write.parquet(f"{folder}/rows")
    return VectorIndex(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/census"), blocks, centroids, probes)
