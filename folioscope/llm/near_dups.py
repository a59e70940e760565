"""Near-duplicate documents: candidates by bits of minima, exact similarity of their word shingles.

Documents are similar when the sets of their shingles (five words, A-Z lower-cased) have a Jaccard
similarity of 0.8 or more. At that similarity SimHash differs in 15 of 100 bits where a block of
text is added, cut or replaced, which takes too many lookups. The fingerprints here have one bit of
each of many minima of the set (MinHash): such a bit differs with half of one minus the similarity,
10 of 100, whatever the edit; as many tables of segments are searched as the wanted recall needs
(both grow with the logarithm of the corpus, to keep table entries sparse). Fingerprints that are
near over all their bits form loose components; inside these the shingle sets are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import free_names, map_texts, materialize, meet, ship, sliced, slots, tidy
from folioscope.llm.components import components
from folioscope.llm.simhash import by_group, dealt_pairs, link_batch, near_links, shingle_hashes, span

RECALL, SIGMAS = 0.999, 4  # of a lone pair at the threshold: met in some table, and standing below the distance that still counts
BLOCK, MANY, UNIT = 1024, 48, 8192  # UNIT: bytes of text that count as one row of a block
_PART = 1024


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle."""
    parts = [np.array(x, np.uint64) for x in shingle_hashes((text or "").encode().lower().split(), size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


@cache
def _orders(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``count`` orders of 32-bit values, as columns."""
    import xxhash

    made = [[xxhash.xxh32_intdigest(k.to_bytes(4, "big"), seed) for k in range(count)] for seed in (1, 2)]
    return np.array(made[0], np.uint32)[:, None] | np.uint32(1), np.array(made[1], np.uint32)[:, None]


def minima_print(shingles: np.ndarray, count: int) -> list[int]:
    """``count`` signed 64-bit words: a bit of the set's least value in each of as many orders as bits."""
    times, plus = _orders(64 * count)
    values, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(64 * count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), _PART):
        np.minimum(least, (times * values[at : at + _PART] + plus).min(1), out=least)
    bits = (least ^ (least >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(31)
    return np.packbits(bits.astype(bool)).view(">i8").tolist()


def layout(count: int, similarity: float) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """Tables (word, shift, width, radius), words of the fingerprint, and the distance that still counts.

    Two sets share their least value as often as their Jaccard similarity says; where not, half the bits differ.
    """
    flip = (1 - similarity) / 2 * 1.05
    width = min(32, max(16, math.ceil(math.log2(max(2, count))) + 2))
    hit = (1 - flip) ** width + width * flip * (1 - flip) ** (width - 1)
    tables = max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - hit)))
    each = 64 // width
    words = -(-tables // each)
    bits = 64 * words
    most = math.ceil(bits * flip + SIGMAS * math.sqrt(bits * flip * (1 - flip)))
    return [(t // each, t % each * width, width, 1) for t in range(tables)], words, most


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch):
            sets = [shingle_set(t, size).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("root"), part.column("node"), part.column("members"), pa.array(sets, pa.binary())], names=["root", "node", "members", "set"])


def _exact(similarity: float):
    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list = []
        group, ids, raw = batch.column("group").to_numpy(), batch.column("node").to_numpy(), batch.column("set").to_pylist()
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
            sizes = np.array([len(x) for x in sets], np.int64)
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(sizes) - sizes
            mark = np.zeros(len(names), np.int64)

            def near(x, open_):
                fits = (sizes[open_] >= similarity * sizes[x]) & (similarity * sizes[open_] <= sizes[x])  # noqa: B023
                own = open_[fits]
                mark[:] = 0  # noqa: B023
                mark[flat[first[x] : first[x] + sizes[x]]] = 1  # noqa: B023
                if len(own) > MANY:  # one pass over the whole block
                    shared = np.zeros(len(sizes), np.int64)  # noqa: B023
                    shared[sizes > 0] = np.add.reduceat(mark[flat], first[sizes > 0])  # noqa: B023
                    both = shared[own]
                else:
                    both = np.array([mark[flat[first[y] : first[y] + sizes[y]]].sum() for y in own.tolist()], np.int64)  # noqa: B023
                found = np.zeros(len(open_), bool)
                found[fits] = both >= similarity * (sizes[own] + sizes[x] - both)  # noqa: B023
                return found

            span(ids[a:b], near, out)
        return link_batch(out)

    return by_group(links)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, th, node, component_id) of every row: the smallest doc_id of each group of near duplicates.

    ``th`` is xxhash64 of the text and tells rows of one id apart; ``node`` stands for the set of
    shingles. Groups are the components of exact similarity links among the candidates. Texts
    without words (null, empty, blank) are copies of one another. Repeated rows stay repeated;
    null ids name a group only if it has no other (component_id is null then). Texts of any length
    are taken whole; those that are compared side by side are bounded by their bytes (``BLOCK``
    times ``UNIT`` on average, one text at least). An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    count = docs.count()
    tables, words, distance = layout(count, similarity)
    names = [f"f{k}" for k in range(words)]

    def make():
        def work(texts, kept):
            sets = [shingle_set(t, size) for t in texts]
            prints = [minima_print(x, words) for x in sets]
            return kept | {"node": [_node(x) for x in sets]} | {f: [p[k] for p in prints] for k, f in enumerate(names)}

        return work

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    units = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / UNIT).cast("long").alias("units")
    sketch = materialize(map_texts(rows.select("*", units), f"doc_id {kind}, th long, units long, node long, " + ", ".join(f"{f} long" for f in names), ["doc_id", "th", "units"], make), "sketch")
    distinct = sketch.groupBy(F.col("node").alias("id")).agg(*[F.min(f).alias(f) for f in names], F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "units")).alias("rep"))
    distinct = materialize(distinct, "distinct")
    loose = components(near_links(distinct, names, tables, distance))
    member = distinct.join(loose, distinct.id == loose.node, "left").select(F.coalesce("root", "id").alias("root"), F.col("id").alias("node"), "rep")
    member = materialize(member, "members")
    crowd = member.groupBy("root").agg(F.count("*").alias("n"), F.sum("rep.units").alias("members")).where("n > 1")
    wanted = meet(member, ["root"], crowd, distinct.count()).select("root", "node", "members", F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("root", "node", "members", "text")
    sets = texts.mapInArrow(tidy(lambda it: _sets(it, size)), "root long, node long, members long, set binary")
    dealt = dealt_pairs(sets, "root", "members", BLOCK, "node").select("group", "node", "set")
    dealt = dealt.repartition(slots(spark), "group").sortWithinPartitions("group")
    roots = components(dealt.mapInArrow(tidy(_exact(similarity)), "a long, b long"))
    named = distinct.join(roots, distinct.id == roots.node, "left").select(F.col("id").alias("node"), F.coalesce("root", "id").alias("root"), "rep.doc_id")
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    by_node = meet(named, ["root"], least, distinct.count()).select("node", "component_id")
    return sketch.select("doc_id", "th", "node").join(by_node, "node").select("doc_id", "th", "node", "component_id")


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` less all near duplicates but one of each group, the one with the smallest doc_id.

    Of rows with that id in one group, one stays. In a group of null ids alone, one row of each
    text stays. Columns of any name come through as they are.
    """
    d, t, h = free_names(docs, 3)
    groups = near_duplicates(docs, similarity, size)
    own_text = F.when(F.col("doc_id").isNull(), F.col("th"))
    kept = groups.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias(d), "component_id", own_text.alias("own")).agg(F.min("th").alias(t))
    own = docs.withColumn(h, F.coalesce(F.xxhash64("text"), F.lit(0)))
    joined = own.join(kept.select(d, t), F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)))
    return joined.dropDuplicates([d, t]).select(*[F.col(f"`{c}`") for c in docs.columns])
