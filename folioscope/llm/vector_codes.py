"""Codes of vectors by product quantisation; codebooks from Lloyd rounds over all vectors, with heaps of slacks.

Vectors become integers and are cut into parts; each part position has a codebook. A round assigns
every part to its nearest entry and replaces every entry by the floor of its parts' mean, all in
whole numbers. Rounds after the first look at few parts: a part knows the distance u to its entry
and l to the next best. While entries move, u grows by at most its entry's drift and l falls by at
most the greatest drift of another entry, so the part stays where it is while its slack l - u is
greater than the drift summed since. Every block of vectors keeps a heap of slacks for each entry;
a round pops only the parts that the entry's cumulative drift has reached, scans those exactly, and
passes on what they change in the sums.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import free_names, materialize, meet, ship, tidy

BLOCK = 4096  # vectors of a block, below 2**16
_MARGIN = 1e-9  # of a distance: far above the rounding of roots, so that no bound is too good


def whole_numbers(column: pa.Array, dim: int, width: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of every component, vectors x ``width`` (zeros beyond ``dim``), within +-``most``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    out = np.zeros((len(x), width), np.int64)
    out[:, :dim] = np.clip(np.floor(x * scale), -most, most).astype(np.int64)
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lowest) and the slack of its bounds."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 8 * top * top * x.shape[1] < 1 << 52 else np.int64  # doubles are exact there, and faster
    a, b = x.astype(kind), book.astype(kind)
    square = ((b * b).sum(1)[None] - 2 * (a @ b.T)) + (a * a).sum(1)[:, None]
    own = square.argmin(1)
    rows = np.arange(len(x))
    u = np.sqrt(square[rows, own].astype(np.float64))
    if len(book) == 1:
        return own, np.full(len(x), np.inf)
    square[rows, own] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    low = np.sqrt(square.min(1).astype(np.float64))
    return own, low - u - _MARGIN * (low + u + 1)


class Heaps:
    """The parts of a block at one position: a heap of (key, row) for each entry, kept as arrays in heap order.

    A key is the slack plus the drift that the entry had when the part was pushed.
    """

    def __init__(self, entries: int, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        self.ends = np.concatenate(([0], np.cumsum(counts)))
        self.keys, self.rows, self.open = keys, rows, {}

    def heap(self, e: int) -> list:
        if e not in self.open:
            a, b = self.ends[e], self.ends[e + 1]
            self.open[e] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))
        return self.open[e]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pops the rows whose key the drift of their entry has reached."""
        filled = np.flatnonzero(np.diff(self.ends))
        out = []
        for e in filled[self.keys[self.ends[filled]] <= drift[filled]].tolist():
            heap, least = self.heap(e), drift[e]
            while heap and heap[0][0] <= least:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def push(self, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for e, key, row in zip(entries.tolist(), keys.tolist(), rows.tolist()):
            heapq.heappush(self.heap(e), (key, row))

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = [], []
        for e in range(len(self.ends) - 1):
            if e in self.open:
                keys.append(np.array([k for k, _ in self.open[e]], np.float32))
                rows.append(np.array([r for _, r in self.open[e]], np.uint16))
            else:
                keys.append(self.keys[self.ends[e] : self.ends[e + 1]])
                rows.append(self.rows[self.ends[e] : self.ends[e + 1]])
        return np.concatenate(keys), np.concatenate(rows)


def _below(x: np.ndarray) -> np.ndarray:
    """In single precision, rounded down."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def first_round(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, keys and rows (positions x vectors) after scanning every part."""
    parts, entries, cut = books.shape
    codes = np.empty((parts, len(x)), np.uint8)
    keys, rows = np.empty((parts, len(x)), np.float32), np.empty((parts, len(x)), np.uint16)
    for p in range(parts):
        codes[p], slack = scan(x[:, p * cut : (p + 1) * cut], books[p])
        order = np.lexsort((slack, codes[p]))  # sorted, so a heap
        keys[p], rows[p] = _below(slack[order]), order
    return codes, keys, rows


def next_round(x: np.ndarray, books: np.ndarray, drift: np.ndarray, codes: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> int:
    """Mend ``codes``, ``keys`` and ``rows`` in place for moved entries; returns how many parts were scanned."""
    parts, entries, cut = books.shape
    scanned = 0
    for p in range(parts):
        heaps = Heaps(entries, keys[p], rows[p], np.bincount(codes[p], minlength=entries))
        again = heaps.violated(drift[p])
        if not len(again):
            continue
        scanned += len(again)
        own, slack = scan(x[again, p * cut : (p + 1) * cut], books[p])
        heaps.push(own, _below(slack + drift[p][own]), again)
        codes[p][again] = own
        keys[p], rows[p] = heaps.stored()
    return scanned


def moved(x: np.ndarray, cut: int, entries: int, old: np.ndarray | None, new: np.ndarray) -> list[dict]:
    """What the change from ``old`` to ``new`` codes adds to each entry's count and sums."""
    out = []
    for p in range(len(new)):
        at = np.arange(len(x)) if old is None else np.flatnonzero(old[p] != new[p])
        if not len(at):
            continue
        part = x[at, p * cut : (p + 1) * cut]
        sums, n = np.zeros((entries, cut), np.int64), np.zeros(entries, np.int64)
        np.add.at(sums, new[p][at], part)
        np.add.at(n, new[p][at], 1)
        if old is not None:
            np.subtract.at(sums, old[p][at], part)
            np.subtract.at(n, old[p][at], 1)
        for e in np.flatnonzero((n != 0) | (sums != 0).any(1)).tolist():
            out.append({"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()})
    return out


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector isn't null or empty and has no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, fine))


def compress(
    rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every kept row, the codebooks: positions x entries x components).

    Codebooks start as the parts of the ``entries`` smallest ids (equal ids by their vector, null ids
    last; all rows, if fewer). ``code`` has an entry's index as two hex digits for each position;
    ``error`` is the squared distance of all parts to their entries. Rows whose vector is null, empty
    or holds null or non-finite components are dropped, and so are vectors of another length than
    most; where the length isn't a multiple of ``parts``, zeros follow. Whole numbers are kept within
    what lets an error of any vector fit in 64 bits (2**28 at 64 components). Repeated rows count
    each; labels of any type, nulls too, pass through; other columns are ignored. An empty table
    gives no rows and no codebooks.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = dict(rows.dtypes)[label_col]
    out = f"{id_col} long, {label_col} {kind}, code string, error long"
    good = usable(rows, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>" if "double" in dict(rows.dtypes)[vector_col] else "array<float>").alias("v"), F.col(label_col).alias("label"))
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 1), np.int64)
    dim = sizes[0]["size"]
    cut = -(-dim // parts)
    width, most = parts * cut, int((2**62 / dim) ** 0.5) // 2
    good = good.where(F.size("v") == dim)
    start = good.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows
    first = whole_numbers(pa.array([list(r["v"]) for r in start], pa.list_(pa.float64())), dim, width, scale, most)
    books = np.ascontiguousarray(first.reshape(len(first), parts, cut).transpose(1, 0, 2))
    held = len(first)
    drift = np.zeros((parts, held))
    state = f"ids array<long>, labels array<{kind}>, x binary, codes binary, keys binary, rows binary, scanned long, moves array<struct<part:int,entry:int,n:long,sums:array<long>>>"

    def schema_of(ddl: str) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        return to_arrow_schema(_parse_datatype_string(ddl))

    stored = schema_of(state)

    def row(ids, labels, x, codes, keys, order, scanned, moves) -> pa.RecordBatch:
        values = [x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64).tobytes(), codes.tobytes(), keys.tobytes(), order.tobytes(), scanned, moves]
        arrays = [pa.array([ids], stored.field("ids").type), pa.array([labels], stored.field("labels").type)]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([v], f.type) for v, f in zip(values, list(stored)[2:]))], schema=stored)

    def opened(batch: pa.RecordBatch, i: int):
        ids, labels, x, codes, keys, order = (batch.column(c)[i].as_py() for c in ("ids", "labels", "x", "codes", "keys", "rows"))
        n = len(ids)
        whole = np.frombuffer(x, np.int16 if len(x) == 2 * n * width else np.int64).astype(np.int64).reshape(n, width)
        return ids, labels, whole, *(np.frombuffer(b, t).reshape(parts, n).copy() for b, t in ((codes, np.uint8), (keys, np.float32), (order, np.uint16)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = whole_numbers(some.column("v"), dim, width, scale, most)
                codes, keys, order = first_round(x, books)
                yield row(some.column("id").to_pylist(), some.column("label").to_pylist(), x, codes, keys, order, codes.size, moved(x, cut, held, None, codes))

    def stepper(books: np.ndarray, drift: np.ndarray):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, x, codes, keys, order = opened(batch, i)
                    old = codes.copy()
                    scanned = next_round(x, books, drift, codes, keys, order)
                    yield row(ids, labels, x, codes, keys, order, scanned, moved(x, cut, held, old, codes))

        return step

    def finish(books: np.ndarray, drift: np.ndarray):
        def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels, x, codes, keys, order = opened(batch, i)
                    next_round(x, books, drift, codes, keys, order)
                    off = x.reshape(len(x), parts, cut) - books[np.arange(parts)[None], codes.T]
                    error = (off * off).sum((1, 2))
                    text = codes.T.tobytes().hex()
                    code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                    arrays = [pa.array(ids, pa.int64()), pa.array(labels, ended.field(1).type), pa.array(code, pa.string()), pa.array(error, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, schema=ended)

        return end

    ended = schema_of(out)
    sums, counts = np.zeros((parts, held, cut), np.int64), np.zeros((parts, held), np.int64)
    table = materialize(good.mapInArrow(tidy(begin), state), "codes")
    for done in range(rounds):
        moves = table.select(F.explode("moves").alias("m")).groupBy("m.part", "m.entry")
        found = moves.agg(F.sum("m.n").alias("n"), *[F.sum(F.col("m.sums")[i]).alias(f"s{i}") for i in range(cut)]).collect()  # positions x entries
        for r in found:
            counts[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array([r[f"s{i}"] for i in range(cut)], np.int64)
        new = np.where(counts[..., None] > 0, sums // np.maximum(1, counts)[..., None], books)
        way = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2))
        order = np.sort(way, 1)
        others = np.where(way == order[:, -1:], order[:, -2:-1] if held > 1 else 0, order[:, -1:])  # the greatest of the other entries
        others = np.where((way == order[:, -1:]).sum(1, keepdims=True) > 1, order[:, -1:], others)
        drift, books = drift + (way + others) * (1 + _MARGIN), new
        if done < rounds - 1:
            table = materialize(table.select("ids", "labels", "x", "codes", "keys", "rows").mapInArrow(tidy(stepper(books, drift)), state), "codes")
    final = table.select("ids", "labels", "x", "codes", "keys", "rows").mapInArrow(tidy(finish(books, drift)), out)
    return final, books


def digest(books: np.ndarray) -> str:
    """sha256 of all components, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over all rows of the same label, nulls together.

    A label with a great share of all rows is dealt out over many tasks. A sum beyond 64 bits is null.
    """
    none, value = free_names(coded, 2)
    missing = F.col(label_col).isNull()
    zero = F.first(label_col, ignorenulls=True)
    rows = materialize(coded, "coded")
    total, some = rows.agg(F.count(F.lit(1)), zero).first()
    if some is None:  # no label at all: one sum for all
        return rows.crossJoin(F.broadcast(rows.agg(F.try_sum("error").alias("label_error"))))  # one row
    keyed = rows.withColumn(none, missing).withColumn(value, F.coalesce(F.col(label_col), F.lit(some)))
    each = keyed.groupBy(none, value).agg(F.count(F.lit(1)).alias("n"), F.try_sum("error").alias("label_error"))
    return meet(keyed, [none, value], each, total).drop(none, value)


#: DuckDB SQL of ``op11``: two rounds over all parts, written out.
def oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    ctes = [
        """kept as (select row_number() over (order by vec_id nulls last, embedding, label) as r, vec_id, label, [cast(floor(256 * x::double) as bigint) for x in embedding] as v
            from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"cut as (select r, p.p, v[p.p * len(v) // {parts} + 1 : (p.p + 1) * len(v) // {parts}] as v from kept, (select unnest(range({parts})) as p) p)",
        f"book0 as (select p, r - 1 as e, v from cut where r <= {entries})",
    ]
    for t in range(rounds + 1):
        ctes.append(f"""near{t} as (select c.r, c.p, min(struct_pack(d := list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := b.e)) as m
            from cut c join book{t} b on c.p = b.p group by c.r, c.p)""")
        if t < rounds:
            ctes.append(f"""sums{t} as (select c.p, n.m.e as e, i.i, floor(sum(c.v[i.i])::bigint / count(*)) :: bigint as s
                from cut c join near{t} n on c.r = n.r and c.p = n.p, (select unnest(range(1, 1 + (select max(len(v)) from cut))) as i) i group by c.p, n.m.e, i.i)""")
            ctes.append(f"mean{t} as (select p, e, list(s order by i) as v from sums{t} group by p, e)")
            ctes.append(f"book{t + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from book{t} b left join mean{t} m on b.p = m.p and b.e = m.e)")
    ctes.append(f"coded as (select r, string_agg(lower(printf('%02x', m.e)), '' order by p) as code, sum(m.d)::bigint as error from near{rounds} group by r)")
    ctes.append(f"sha as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as s from book{rounds})")
    return f"""with {", ".join(ctes)} select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error, s as codebooks_sha256
        from kept k join coded c on k.r = c.r, sha"""
