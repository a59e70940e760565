"""Sequence packing: shortest pack first over the length histogram.

Documents become id sequences, cut into pieces of the sequence length at most. Only the histogram
of piece lengths (bounded by the sequence length) reaches the driver; it is packed longest length
first, each time into the packs with the least in them, whole groups of equal packs at once. Pieces
then meet their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.chunked_encoding import encoder
from folioscope.llm.common import materialize, ship, sliced, tidy

_BUCKET = 512  # pieces of a length that are ranked together


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece, cut at multiples of ``capacity``."""
    kind = dict(docs.dtypes)["doc_id"]
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer_path)
        for batch in batches:
            for part in sliced(batch, 8 << 20):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), to_ids.encode(part.column("text"))):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        some = ids[4 * at : 4 * (at + capacity)]
                        rows.append((doc, at, len(some) // 4, zlib.crc32(some), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (part.schema.field("doc_id").type, *[pa.int64()] * 4))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, keeps=tokenizer_path), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns: ((length, how often), ...) in their order in the pack, and how many packs.

    Lengths are placed longest first, each into the open packs with the least in them; a pattern
    whose packs outnumber the pieces is split. Only where nothing fits are packs opened.
    """
    by_space: dict[int, list[list]] = defaultdict(list)  # free tokens -> [pattern, packs]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        space = capacity
        while left:
            while space >= length and not by_space.get(space):
                space -= 1
            if space < length:
                each = min(capacity // length, left)
                packs = left // each
                by_space[capacity - each * length].append([((length, each),), packs])
                left -= packs * each
                space = capacity
                continue
            pattern, packs = by_space[space].pop()
            used = min(packs, left)
            if used < packs:
                by_space[space].append([pattern, packs - used])
            last, times = pattern[-1]
            longer = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            by_space[space - length].append([longer, used])
            left -= used
    return [(pattern, packs) for space in sorted(by_space) for pattern, packs in by_space[space]]


def places(patterns: list, offset_bits: int = 40) -> dict[str, np.ndarray]:
    """Slots as rank intervals: of each length, the ranks from ``key`` on go to packs from ``base`` on."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rows.append((length << offset_bits | rank[length], base, offset))
                rank[length] += packs
                offset += length
        base += packs
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": columns[0].copy(), "base": columns[1].copy(), "offset": columns[2].copy()}


def ranked(rows: DataFrame, histogram: DataFrame) -> DataFrame:
    """``rows`` with the rank (from 0) of each among the rows of its length; no length has to fit a task.

    Rows of a length are dealt into buckets of limited size by a hash, ranked there, and moved by
    the counts of the buckets before.
    """
    buckets = histogram.select("length", F.ceil(F.col("count") / _BUCKET).alias("buckets"))  # one row per length: bounded
    dealt = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids (no special tokens added, then ``end_id``) lie in exactly one piece each;
    pieces fill their sequence from offset 0 without gaps. Null and empty texts have the end id
    alone. Repeated rows are packed each; a null doc_id is kept. Other columns are ignored.
    """
    cut = materialize(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    histogram = cut.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most ``capacity`` rows
    slots = places(shortest_pack_first(counts, capacity))
    small = cut.sparkSession.createDataFrame(list(counts.items()), "length long, count long")
    rows = ranked(cut, small).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = (length << 40) | rank
            at = np.searchsorted(slots["key"], key, side="right") - 1
            more = [pa.array(slots["base"][at] + key - slots["key"][at]), pa.array(slots["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
