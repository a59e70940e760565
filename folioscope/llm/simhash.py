"""SimHash near duplicates by multi-index hashing.

The 64 bits are cut into segments with radii chosen so that fingerprints within the allowed
distance agree in some segment up to its radius (the pigeonhole principle: radii sum to distance
- segments + 1). Every distinct fingerprint stands in each segment's table and probes the table
at every value of a small Hamming ball; table matches are verified over all 64 bits.

A pair that differs in a segment is found from the side with more of the differing bits set, so
balls only clear bits or keep their number. Crowded table entries are dealt out in pairs of blocks
of limited size, and each block pair returns a spanning forest instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_texts, materialize, meet, slots, tidy
from folioscope.llm.components import components

SEED, BLOCK = 42, 512
_PART = 4096
_LOOKUPS, _MOST_TASKS = 4 << 20, 50_000  # lookups that a task makes, as far as there aren't too many tasks


def shingle_hashes(words: list[bytes], size: int) -> Iterator[list[int]]:
    """XXH64 values of all shingles of a text's words, in lists of limited length."""
    import xxhash

    h = xxhash.xxh64_intdigest
    if not words:
        return
    n = max(1, len(words) - size + 1)
    for at in range(0, n, _PART):
        some = words[at : at + _PART + size - 1]
        text = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(size, len(some))
        yield [h(text[a:b], SEED) for a, b in zip(starts[: len(some) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprint(text: str | None, size: int) -> int:
    """A bit is 1 if set in over half of the shingles' hashes, repeats included."""
    ones, total = np.zeros(64, np.int64), 0
    for some in shingle_hashes((text or "").encode().lower().split(), size):
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
        total += len(some)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint of every whole text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer words
    than ``size`` is one shingle; null, empty and blank texts have fingerprint zero.
    """

    def make():
        return lambda texts, kept: {id_col: kept[id_col], "fp": [fingerprint(t, size) for t in texts]}

    return map_texts(docs, f"{id_col} {dict(docs.dtypes)[id_col]}, fp long", [id_col], make)


def fitting(distance: int, prints: int) -> list[tuple[int, int, int]]:
    """The segments that take the least work for so many distinct fingerprints.

    Work is the lookups (half of a ball, see ``_keys``) and what they meet in tables that fill up
    with the corpus: few wide segments with larger balls suit many fingerprints.
    """

    def work(own) -> float:
        balls = [(w, sum(comb(w, k) for k in range(r + 1)) / 2 + 1) for _, w, r in own if r >= 0]
        return sum(n * (1 + prints / 2**w) for w, n in balls)

    return min((segments(distance, count) for count in range(2, min(8, distance + 1) + 1)), key=work)


def segments(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; a negative radius means that it needs no lookup."""
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    spare = distance - count + 1
    radii = [spare // count + (i < spare % count) if spare >= 0 else -(i >= distance + 1) for i in range(count)]
    shifts = np.concatenate(([0], np.cumsum(widths)[:-1])).tolist()
    return list(zip(shifts, widths, radii))


def _keys(words: list[str], tables: list[tuple[int, int, int, int]]) -> F.Column:
    """(table and value, whether it is a probe) of all lookups; tables: (word, shift, width, radius)."""
    out = []
    for i, (word, shift, width, radius) in enumerate(tables):
        if radius < 0:
            continue
        value = F.shiftrightunsigned(F.col(words[word]), shift).bitwiseAND((1 << width) - 1)
        tag = i << 40
        out.append(F.array(F.struct((value + F.lit(tag)).alias("key"), F.lit(False).alias("probe"))))
        for flips in range(1, radius + 1):
            for bits in combinations(range(width), flips):
                mask = sum(1 << b for b in bits)
                held = value.bitwiseAND(mask)
                # of the two sides, the one with more of the bits set probes; at a tie the one with the lowest
                more = F.bit_count(held) * 2 + (value.bitwiseAND(1 << bits[0]) != 0).cast("int") > flips
                out.append(F.when(more, F.array(F.struct((value.bitwiseXOR(F.lit(mask)) + F.lit(tag)).alias("key"), F.lit(True).alias("probe")))))
    return F.flatten(F.array_compact(F.array(*out)))


def span(ids: np.ndarray, near, out: list) -> None:
    """Links that span the components of one block; ``near(x, open)`` tells which of ``open`` link with ``x``."""
    open_, todo = np.arange(len(ids)), []
    while len(open_):
        if not todo:
            todo, open_ = [int(open_[0])], open_[1:]
        x = todo.pop()
        if not len(open_):
            break
        linked = near(x, open_)
        if linked.any():
            found = open_[linked]
            out.append((np.full(len(found), ids[x]), ids[found]))
            todo.extend(found.tolist())
            open_ = open_[~linked]


def by_group(links):
    """An Arrow map over rows sorted by ``group`` that calls ``links`` with whole groups only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group, which may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            cut = int(np.argmax(group == group[-1]))
            if cut or (held and group[0] != last):
                yield links(_one([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
            last = group[-1]
        if held:
            yield links(_one(held))

    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows, of any size: binary columns get 64-bit offsets."""
    kinds = pa.schema([(f.name, pa.large_binary() if pa.types.is_binary(f.type) else f.type) for f in batches[0].schema])
    return pa.Table.from_batches(batches).cast(kinds).combine_chunks().to_batches()[0]


def link_batch(out: list) -> pa.RecordBatch:
    a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def dealt_pairs(rows: DataFrame, key: str, size: str, block: int, own) -> DataFrame:
    """``rows`` with a ``group``: crowds of a key (``size`` rows) in pairs of blocks of about ``block`` rows."""
    rows = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int"))
    mine = F.pmod(F.xxhash64(own), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j) * F.col("blocks") + F.greatest(mine, j))
    return rows.withColumn("pair", F.explode(pairs)).withColumn("group", F.xxhash64(key, "pair"))


def _verify(words: list[str], distance: int):
    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list = []
        group, ids = batch.column("group").to_numpy(), batch.column("id").to_numpy()
        fps = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in words], 1)
        apart = lambda x, y: np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        sizes = np.diff(edges)
        small = np.repeat(sizes <= 24, sizes)
        g, f, d = group[small], fps[small], ids[small]
        for step in range(1, 24):  # all pairs of small groups, by their distance in the sorted rows
            same = np.flatnonzero(g[step:] == g[:-step])
            if not len(same):
                break
            same = same[apart(f[same], f[same + step]) <= distance]
            out.append((d[same], d[same + step]))
        for k in np.flatnonzero(sizes > 24):
            some, own = fps[edges[k] : edges[k + 1]], ids[edges[k] : edges[k + 1]]
            span(own, lambda x, open_: apart(some[open_], some[x]) <= distance, out)  # noqa: B023
        return link_batch(out)

    return by_group(links)


def near_links(distinct: DataFrame, words: list[str], tables: list[tuple[int, int, int, int]], distance: int) -> DataFrame:
    """(a, b): links of ids whose fingerprints meet in a table and differ in ``distance`` bits at most.

    ``distinct`` has one row per fingerprint: id (long) and the columns ``words`` (64 bits each).
    The links reach every pair's component: each crowded lookup returns a spanning forest of its
    verified pairs.
    """
    count = distinct.count()
    each = sum(sum(comb(width, k) for k in range(radius + 1)) / 2 + 1 for _, _, width, radius in tables if radius >= 0)
    tasks = max(slots(distinct.sparkSession), min(_MOST_TASKS, int(count * each / _LOOKUPS)))  # a few megabytes of fingerprints make many lookups
    rows = distinct.repartition(tasks, "id").select("id", F.explode(_keys(words, tables)).alias("x")).select("id", "x.key", "x.probe")
    crowd = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("none")).where("n > 1 and not none").select("key", "n", F.col("n").alias("size"))
    met = meet(rows.select("id", "key"), ["key"], crowd, count)
    dealt = dealt_pairs(met.join(distinct.select("id", *words), "id"), "key", "size", BLOCK, "id").select("group", "id", *words)
    dealt = dealt.repartition(slots(distinct.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(tidy(_verify(words, distance)), "a long, b long")


def near_groups(docs: DataFrame, size: int = 4, distance: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) of every row; the component is named by its smallest id.

    Texts link when their fingerprints (see ``fingerprints``) differ in ``distance`` bits at most,
    those of texts without words included; components are transitive. Repeated rows stay
    repeated. Rows with a null id link nothing; they get the id of an equal fingerprint's
    component, null if there is none. Copies are folded by fingerprint before any lookup. Texts of
    any length are taken whole; an empty table gives no rows. The segments follow the number of
    distinct fingerprints (see ``fitting``), which changes the work and not the links.
    """
    prints = materialize(fingerprints(docs, size, id_col), "fingerprints").withColumnRenamed(id_col, "own_id")
    distinct = prints.where("own_id is not null").groupBy("fp").agg(F.min(F.col("own_id").cast("long")).alias("id"))
    distinct = materialize(distinct, "distinct")
    tables = [(0, *x) for x in fitting(distance, distinct.count())]
    roots = components(near_links(distinct, ["fp"], tables, distance))
    named = distinct.join(roots, distinct.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(F.col("own_id").alias(id_col), "fp", "component_id")


def hex_print(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
