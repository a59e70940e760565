"""Ranked lexical search by a two-level quantised index.

Documents stand in blocks of bounded text. The index has a row for each term of a block: its
documents, level one (a byte of impact for each, rounded up) and level two (the exact number of
occurrences). A search adds up level one: that gives every document an upper bound of its score,
and a lower bound that is less by what the rounding may have added. The k-th greatest lower bound of
an item, over all blocks, is passed by every document that can be among its best k; those alone are
scored again, exactly, from level two. All sums are whole numbers, so the result is exact.

Every block holds all its documents' terms, so that a term of a third of all documents is spread
over all blocks, and building the index moves no posting between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import fresh_folder, materialize, ship, sliced, tidy

BLOCK_BYTES, TOP, STEP = 4 << 20, 1_000_000, 3922  # an impact is below TOP; STEP * 255 is TOP and a little more
ASKED = 50_000  # asked (item, term) pairs that a task takes at once
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:0x30] = _TABLE[0x3A:0x41] = _TABLE[0x5B:0x61] = _TABLE[0x7B:0x80] = 0x20
_TABLE[0x41:0x5B] += 0x20  # A-Z alone are lower-cased


def terms_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of ``texts`` one after the other, and the number of each text's."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = _TABLE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    word = low != 0x20
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    bounds = np.unique(offsets - offsets[0])
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    joined = inner[word[inner] & word[inner - 1]]  # a term of one text may touch that of the next
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), joined]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), joined]))
    lengths = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(low[word].tobytes()))
    return flat, np.diff(np.searchsorted(starts, offsets - offsets[0]))


@dataclass
class Index:
    """path: rows (block, term, df, docs, impacts, tfs), and one a block without term: ids, and the lengths as tfs.

    count: documents with a term at least; length: all their terms.
    """

    path: str
    count: int
    length: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)


SCHEMA = "block long, term string, df long, docs binary, impacts binary, tfs binary, ids array<long>"


def part(tf: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    """A posting's share of a score, without the term's weight."""
    m = 100 - 50 + (50 * n * count) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """Index every document's whole text, in a new folder of the shared one.

    Two passes: one counts documents with terms and their terms, one writes the index. Null and empty
    texts have no terms; repeated rows are documents each; a text longer than a block is a block of
    its own; other columns are ignored; an empty table gives an empty index.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = length = 0
        for batch in batches:
            for some in sliced(batch, block_bytes):
                n = terms_of(some.column("text"))[1]
                count, length = count + int((n > 0).sum()), length + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([length], pa.int64())], names=["count", "length"])

    sums = rows.select("text").mapInArrow(tidy(measure), "count long, length long").agg(F.sum("count"), F.sum("length")).first()
    count, length = int(sums[0] or 0), int(sums[1] or 0)
    shape = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in sliced(batch, block_bytes):
                flat, n = terms_of(some.column("text"))
                if len(flat):
                    yield from inverted(block, some.column("id"), flat, n, count, length, shape)
                    block += 1

    path = fresh_folder(spark, "lexical")
    rows.mapInArrow(tidy(invert), SCHEMA).write.option("compression", "zstd").parquet(path)
    return Index(path, count, length)


def inverted(block: int, ids: pa.Array, flat: pa.StringArray, n: np.ndarray, count: int, length: int, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The index rows of a block; documents are numbered in it from 0."""
    code = flat.dictionary_encode()
    key = code.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // len(n), key % len(n)
    first = np.searchsorted(term, np.arange(len(code.dictionary) + 1))
    impact = -(-part(tf.astype(np.int64), n[doc], count, length) // STEP)
    bounds = first.astype(np.int32)

    def lists(values: np.ndarray, width: int) -> pa.BinaryArray:
        return pa.BinaryArray.from_buffers(pa.binary(), len(code.dictionary), [None, pa.py_buffer(bounds * width), pa.py_buffer(values.tobytes())])

    size = len(code.dictionary)
    postings = [pa.array(np.full(size, block)), code.dictionary, pa.array(np.diff(first)), lists(doc.astype("<u4"), 4), lists(impact.astype(np.uint8), 1), lists(tf.astype("<u4"), 4)]
    yield pa.RecordBatch.from_arrays([*postings, pa.nulls(size, shape.field("ids").type)], schema=shape)
    own = [[block], [None], [len(n)], [None], [None], [n.astype("<u4").tobytes()], [ids.to_pylist()]]
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, shape)], schema=shape)


def questions(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item_id, term): the terms of each item once; ``q`` numbers the rows of ``items``."""
    ship(items.sparkSession)
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")), "items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch):
                flat, n = terms_of(some.column("text"))
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([some.column("q").take(at), some.column("item_id").take(at), flat], names=["q", "item_id", "term"])

    return materialize(numbered.mapInArrow(tidy(split), "q long, item_id long, term string").distinct(), "asked")


def _with_terms(rows: DataFrame, asked: DataFrame, bytes_: int) -> DataFrame:
    """Index rows joined with ``asked`` (a row a term): by broadcast, up to 32 MB of it, else by shuffle."""
    return rows.join(F.broadcast(asked) if bytes_ <= 32 << 20 else asked.hint("shuffle_hash"), "term")


def _accumulate(batch: pa.Table, of: str, kind: str, score) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item that asks for terms of the batch: (item, sum over its terms, sum of its weights) for every document of the block."""
    docs = [np.frombuffer(x, "<u4") for x in batch.column("docs").to_pylist()]
    values = [score(i, np.frombuffer(x, kind)) for i, x in enumerate(batch.column(of).to_pylist())]
    size = 1 + max(int(d[-1]) for d in docs)
    wanted: dict[int, list] = {}
    for i, asked in enumerate(batch.column("asked").to_pylist()):
        for a in asked:
            wanted.setdefault(a["q"], []).append((i, a["w"]))
    for q, terms in sorted(wanted.items()):
        total, weight = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for i, w in terms:
            total[docs[i]] += w * values[i]
            weight[docs[i]] += w
        yield q, total, weight


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0, for each row of ``items``.

    Equal scores by ascending doc_id; equal rows among documents are ranked each, equal rows among
    items are answered each. Items without terms (null, empty), and an empty index, give no rows.
    """
    spark = items.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not index.count:
        return empty
    rows = index.rows(spark)
    pairs = questions(items, id_col, text_col)
    words = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = pairs.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if not size[0]:
        return empty
    bytes_ = int(size[1]) + 24 * size[0]
    seen = _with_terms(rows.where("term is not null").select("term", "df"), words.select("term"), bytes_)
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.count + 2) / (2 * F.col("df") + 1)))
    weighted = seen.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w")).where("w > 0")
    groups = -(-size[0] // ASKED)  # items are dealt out to groups, so that a task's share of them is bounded
    group = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")
    asked = materialize(pairs.join(weighted, "term").groupBy("term", group.alias("g")).agg(F.collect_list(F.struct("q", "w")).alias("asked")), "weights")
    postings = rows.where("term is not null")

    def bounds(batch: pa.Table) -> pa.Table:
        key = batch.column("block")[0].as_py(), batch.column("g")[0].as_py()
        out: list[list] = [[], [], [], []]
        for q, total, weights in _accumulate(batch, "impacts", np.uint8, lambda _, x: x.astype(np.int64) * STEP):
            upper, at = total, np.flatnonzero(total)
            lower = upper[at] - (STEP - 1) * weights[at]
            least = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else 0
            fit = upper[at] >= least  # all that can be among the best k of this block
            for own, value in zip(out, (np.full(int(fit.sum()), q), at[fit], upper[at][fit], lower[fit])):
                own.append(value)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table([pa.array(np.full(len(flat[0]), key[0])), pa.array(np.full(len(flat[0]), key[1]), pa.int32()), *(pa.array(x.astype(np.int64)) for x in flat)], names=["block", "g", "q", "doc", "upper", "lower"])

    cheap = _with_terms(postings.select("block", "term", "docs", "impacts"), asked, bytes_)
    bounded = materialize(cheap.groupBy("block", "g").applyInArrow(bounds, "block long, g int, q long, doc long, upper long, lower long"), "bounds")
    best = Window.partitionBy("q").orderBy(F.desc("lower"))
    least = bounded.select("q", "lower").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).groupBy("q").agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
    able = bounded.join(least, "q").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("block", "g", "q", "doc")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        known = right.column("ids").is_valid()
        own = right.filter(known)
        batch = right.filter(pa.compute.invert(known))
        if left.num_rows and own.num_rows and batch.num_rows:
            n = np.frombuffer(own.column("tfs")[0].as_py(), "<u4").astype(np.int64)
            docs = [np.frombuffer(x, "<u4") for x in batch.column("docs").to_pylist()]
            order = np.argsort(left.column("q").to_numpy(), kind="stable")
            qs, ds = left.column("q").to_numpy()[order], left.column("doc").to_numpy()[order]
            edges = np.flatnonzero(np.diff(qs, prepend=qs[0] - 1))
            chosen = {int(qs[a]): ds[a:b] for a, b in zip(edges, np.append(edges[1:], len(qs)))}
            scores = _accumulate(batch, "tfs", "<u4", lambda i, x: part(x.astype(np.int64), n[docs[i]], index.count, index.length))
            for q, total, _ in scores:
                at = chosen.get(q, np.zeros(0, np.int64))
                for column, value in zip(out, (np.full(len(at), q), own.column("ids")[0].values.take(pa.array(at)).to_pylist(), total[at])):
                    column.append(value)
        ids = pa.array([x for some in out[1] for x in some], pa.int64())
        return pa.table([pa.array(np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64), pa.int64()), ids, pa.array(np.concatenate(out[2]) if out[2] else np.zeros(0, np.int64), pa.int64())], names=["q", "doc_id", "score"])

    full = _with_terms(postings.select("block", "term", "docs", "tfs"), asked, bytes_).select("block", "g", "docs", "tfs", F.lit(None).cast("array<long>").alias("ids"), "asked")
    every = spark.range(groups).select(F.col("id").cast("int").alias("g"))  # a block's lengths, for every group of items
    lengths = rows.where("term is null").crossJoin(F.broadcast(every)).select("block", "g", "docs", "tfs", "ids", F.lit(None).cast(full.schema["asked"].dataType).alias("asked"))
    needed = able.groupBy("block", "g").count().select("block", "g")
    both = full.unionByName(lengths).join(needed, ["block", "g"], "left_semi")
    scored = able.groupBy("block", "g").cogroup(both.groupBy("block", "g")).applyInArrow(exact, "q long, doc_id long, score long")
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(pairs.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
with words as (
    select d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as d, * from documents)),
lengths as (select d, any_value(doc_id) as doc_id, count(*) as n from words group by d),
corpus as (select count(*) as c, sum(n)::bigint as l from lengths),
tfs as (select d, term, count(*) as tf from words group by d, term),
dfs as (select term, count(*) as df from tfs group by term),
asked as (
    select distinct q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as q, * from benchmark)),
weights as (select q, item_id, term, floor(1000 * ln((2 * c + 2)::double / (2 * df + 1)))::bigint as w from asked join dfs using (term), corpus),
scores as (
    select q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * c) // l))))::bigint as score
    from weights join tfs using (term) join lengths using (d), corpus group by q, item_id, d, doc_id),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50"""
