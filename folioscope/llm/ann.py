"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Fitting looks at a bounded sample; every vector is indexed. There are about as many lists as the
square root of the number of vectors; many centroids are made and looked up in two levels. A query
visits the lists of its best centroids, and more in its own order until they hold enough vectors,
scores their codes by asymmetric distance tables and reranks the best exactly on the original
vectors. How many lists are visited is chosen on the sample, for a recall that leaves a margin.
Lists are cut into blocks of limited size, which are dealt out over groups of blocks, so that a
list with a third of all vectors is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship, tidy

SAMPLE, SAMPLE_BYTES, GROUP, TARGET, SEED = 20_000, 128 << 20, 4096, 0.95, 7
_A_LIST, _MOST_LISTS, _CODES, _DIRECT, _TOPS = 32, 16_384, 256, 1024, 6


@dataclass
class Quantizer:
    centroids: np.ndarray  # lists x dimension
    books: np.ndarray  # parts x codes x dimension of a part
    probes: int
    rerank: int
    tops: np.ndarray | None = None  # centroids of the upper level, where there are many
    below: np.ndarray | None = None  # the first list under each of them, and the number of lists

    @property
    def cut(self) -> int:
        return self.books.shape[2]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: that of the nearest centroid, sought under the nearest of the upper level."""
        if self.tops is None:
            return nearest(x, self.centroids)
        out, found = np.zeros(len(x), np.int64), np.full(len(x), -np.inf, np.float32)
        score = x @ self.tops.T - (self.tops * self.tops).sum(1) / 2
        some = min(_TOPS, len(self.tops))
        best = np.argpartition(-score, some - 1, axis=1)[:, :some]
        rows, tops = np.repeat(np.arange(len(x)), some), best.ravel()
        order = np.argsort(tops, kind="stable")
        rows, edges = rows[order], np.searchsorted(tops[order], np.arange(len(self.tops) + 1))
        for t in np.unique(tops):
            at, own = rows[edges[t] : edges[t + 1]], self.centroids[self.below[t] : self.below[t + 1]]
            near = x[at] @ own.T - (own * own).sum(1) / 2
            pick = near.argmax(1)
            value = near[np.arange(len(at)), pick]
            better = value > found[at]
            out[at[better]], found[at[better]] = pick[better] + self.below[t], value[better]
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = padded(x - self.centroids[lists], self.cut)
        parts = [nearest(rest[:, i * self.cut : (i + 1) * self.cut], book) for i, book in enumerate(self.books)]
        return np.stack(parts, 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's parts with every code: parts x codes."""
        return np.einsum("pcd,pd->pc", self.books, padded(q[None], self.cut).reshape(len(self.books), self.cut))

    def visited(self, q: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query visits, best centroid first: ``probes``, and more until ``least`` vectors are held."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        enough = (np.cumsum(held[order], axis=1) < least).sum(1) + 1
        return [o[: max(self.probes, n)] for o, n in zip(order, enough.tolist())]


def padded(x: np.ndarray, cut: int) -> np.ndarray:
    more = -x.shape[1] % cut
    return np.pad(x, ((0, 0), (0, more))) if more else x


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    norm = (to * to).sum(1) / 2
    out = [np.argmax(x[i : i + 4096] @ to.T - norm, axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(centers))
        filled = np.flatnonzero(counts)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        centers[filled] = np.add.reduceat(x[order], starts[filled], axis=0) / counts[filled, None]
    return centers


def lists_for(total: int, sample: int) -> int:
    """The number of lists: about the square root of the number of vectors, as far as the sample can tell them apart."""
    return int(max(1, min(_MOST_LISTS, sample // 20, total // 40, round(total**0.5))))


def coarse(x: np.ndarray, lists: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Centroids; where there are many, under an upper level of about the square root of their number."""
    if lists <= _DIRECT:
        return kmeans(x, lists, 10, rng), None, None
    tops = kmeans(x, round(lists**0.5), 10, rng)
    own = nearest(x, tops)
    parts = [x[own == t] for t in range(len(tops))]
    made = [kmeans(p, max(1, round(lists * len(p) / len(x))), 10, rng) if len(p) else tops[t : t + 1] for t, p in enumerate(parts)]
    return np.concatenate(made), tops, np.concatenate(([0], np.cumsum([len(m) for m in made])))


def fit(sample: np.ndarray, total: int, k: int, target: float = TARGET, cut: int = 4) -> Quantizer:
    """Fit on ``sample`` for an index of ``total`` vectors and searches for ``k`` neighbours.

    The number of visited lists is the least that holds ``target`` of the true neighbours of
    sampled queries within the sample; where that is a share of all vectors, twice
    the same share of ``k`` (half of ``k`` at least) stands for the nearest ``k`` of all.
    """
    rng = np.random.default_rng(SEED)
    x = sample.astype(np.float32)
    centroids, tops, below = coarse(x, lists_for(total, len(x)), rng)
    shape = Quantizer(centroids, np.zeros((1, 1, cut), np.float32), len(centroids), 20 * k, tops, below)
    own = shape.lists(x)
    rest = padded(x - centroids[own], cut)
    some = rest[np.sort(rng.choice(len(rest), min(len(rest), SAMPLE), replace=False))]
    books = [kmeans(some[:, i : i + cut], _CODES, 8, rng) for i in range(0, rest.shape[1], cut)]
    shape.books = np.stack([np.pad(b, ((0, _CODES - len(b)), (0, 0)), mode="edge") for b in books])
    asked = rng.choice(len(x), min(256, len(x)), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = min(len(x) - 1, k, max(-(-k // 2), -(-2 * k * len(x) // max(1, total))))
    best = np.argsort(-scores, axis=1)[:, :near]
    rank = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], 1).ravel())
    shape.probes = int(needed[min(len(needed) - 1, int(target * len(needed)))]) + 1 if len(needed) else len(centroids)
    return shape


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that take part, in their own type: without null or non-finite components, not zero."""
    wide = "double" in dict(rows.dtypes)[vector_col]
    v = F.transform(F.col(vector_col), lambda x: x.cast("double" if wide else "float"))
    plain = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return plain.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, its ``k`` nearest others.

    Nearest by inner product, in double precision on the original vectors; equal scores by the
    smaller id. Vectors that are null, zero, of another length than most, or that hold null or
    non-finite components take no part, nor do rows with a null id; a query's own id never
    matches. Of repeated ids, every row is searched. Empty tables give no rows. Queries get all
    candidates if there are fewer than ``k``. Fitting looks at about ``sample`` rows, or at 32 a
    list where that is more, within ``SAMPLE_BYTES``; every row is indexed. Scores are those of the
    original vectors, double components included; other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(rows, id_col, vector_col)
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0]["size"], sizes[0]["count"]
    good = good.where(F.size("v") == dim)
    number = np.dtype("<f8" if "double" in dict(good.dtypes)["v"] else "<f4")
    wanted = min(max(sample, _A_LIST * lists_for(total, total)), max(2, SAMPLE_BYTES // (4 * dim)))
    chosen = good.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, wanted / total) * (1 << 30)))
    drawn = np.array([small(np.array(r[0])) for r in chosen.limit(2 * wanted).orderBy("id", "v").select("v").toLocalIterator()], np.float32)
    if len(drawn) < 2:
        drawn = np.array([small(np.array(r[0])) for r in good.limit(1000).select("v").collect()], np.float32)
    shape = spark.sparkContext.broadcast(fit(drawn, total, k))  # size bounded by the list, code and dimension bounds
    flat = "id long, list int, codes binary, raw binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = matrix(batch.column(1), dim, number)
            x = small(full)
            own = shape.value.lists(x)
            codes = shape.value.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in full], pa.binary())],
                names=["id", "list", "codes", "raw"],
            )

    stored = materialize(good.mapInArrow(tidy(index), flat), "index")
    groups = -(-total // GROUP)
    held = np.zeros(len(shape.value.centroids), np.int64)
    for x, n in stored.groupBy("list").count().collect():  # a row per list: bounded
        held[x] = n
    blocks = spark.createDataFrame([(x, int(-(-n // GROUP))) for x, n in enumerate(held.tolist()) if n], "list int, blocks int")  # a row per list
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = stored.join(F.broadcast(blocks), "list").select(_group(F.col("list"), block, groups).alias("g"), F.lit(0).alias("kind"), "id", "codes", "raw", F.array("list").alias("lists"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = matrix(batch.column(1), dim, number)
            seen = [[x for x in v.tolist() if held[x]] for v in shape.value.visited(small(full), held, k + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen, pa.list_(pa.int32())), pa.array([r.tobytes() for r in full], pa.binary())], names=["id", "lists", "raw"])

    asked = good.where(F.col("id") % every == 0).mapInArrow(tidy(route), "id long, lists array<int>, raw binary")
    each = asked.select("id", "raw", F.explode("lists").alias("list")).join(F.broadcast(blocks), "list")
    each = each.select("id", "raw", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sent = each.groupBy(_group(F.col("list"), F.col("block"), groups).alias("g"), "id", "raw").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    both = placed.unionByName(sent.select("g", F.lit(1).alias("kind"), "id", F.lit(None).cast("binary").alias("codes"), "raw", "lists"))
    dealt = both.repartitionById(groups, "g").sortWithinPartitions("kind")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, codes, raws = [], [], [], []
        block_ = None
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            rows_, asks = batch.filter(pa.array(kind == 0)), batch.filter(pa.array(kind == 1))
            if rows_.num_rows:
                ids.append(rows_.column("id").to_numpy())
                lists.append(rows_.column("lists").flatten().to_numpy(zero_copy_only=False))
                codes += rows_.column("codes").to_pylist()
                raws += rows_.column("raw").to_pylist()
            if not asks.num_rows or not ids:
                continue
            if block_ is None:
                block_ = Block(shape.value, np.concatenate(ids), np.concatenate(lists), codes, raws, dim, number)
            found = [block_.best(q, np.frombuffer(r, number), np.asarray(s), k) for q, r, s in zip(*(asks.column(c).to_pylist() for c in ("id", "raw", "lists")))]
            if any(len(x[0]) for x in found):
                who = np.repeat(asks.column("id").to_numpy(), [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(who), *(pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1))], names=["query_id", "vec_id", "score"])

    hits = dealt.mapInArrow(tidy(look), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _group(list_, block, groups: int) -> F.Column:
    return F.pmod(F.xxhash64(list_, block), F.lit(groups)).cast("int")


def matrix(column: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def small(x: np.ndarray) -> np.ndarray:
    """As single-precision numbers, which the index is made of; larger ones become the largest."""
    most = np.finfo(np.float32).max / 1e20  # products of two still fit
    return np.clip(x, -most, most).astype(np.float32)


class Block:
    """The vectors of a group of list blocks, sorted by list."""

    def __init__(self, shape: Quantizer, ids, lists, codes, raws, dim: int, kind: np.dtype):
        order = np.lexsort((ids, lists))
        self.shape, self.ids, lists = shape, ids[order], lists[order]
        self.codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), -1)[order].astype(np.int64)
        self.codes += np.arange(self.codes.shape[1]) * _CODES
        self.raw = np.frombuffer(b"".join(raws), kind).reshape(-1, dim)[order]
        self.first = np.searchsorted(lists, np.arange(len(shape.centroids) + 1))

    def best(self, own: int, q: np.ndarray, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best in the given lists, the query's own id left out."""
        spans = [(self.first[x], self.first[x + 1]) for x in lists]
        at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        at = at[self.ids[at] != own]
        if len(at) > self.shape.rerank:
            single = small(q)
            coarse = np.concatenate([np.full(b - a, single @ self.shape.centroids[x]) for x, (a, b) in zip(lists, spans)])
            coarse = coarse[self.ids[np.concatenate([np.arange(a, b) for a, b in spans])] != own]
            rough = coarse + self.shape.tables(single).ravel()[self.codes[at]].sum(1)
            least = np.partition(rough, len(rough) - self.shape.rerank)[len(rough) - self.shape.rerank]
            at = at[rough >= least]  # all that equal the last one stay, so copies aren't told apart here
        score = (self.raw[at].astype(np.float64) * q.astype(np.float64)).sum(1)
        top = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][top], score[top]
