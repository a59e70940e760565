"""Vector search over batches of questions, fusion, reranking and diversity; keyword search is in ``keywords``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.arrow import arrow_schema, batch_of
from folioscope.operators import seams
from folioscope.operators.keywords import KeywordIndex, build_index, open_index, small  # noqa: F401
from folioscope.operators.scopes import META, SCOPE, best, bundle_condition, conjunction, scope_condition  # noqa: F401
from folioscope.sources.work import kept

ROUTES = ["vector", "keyword"]
_BLOCK_BYTES = 8 << 20


# vector search


def vector_search(questions: DataFrame, vectors: DataFrame, limit: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score, rank): exact search; score is the cosine, or minus the squared distance.

    Questions (query_id, embedding, and any scope columns, see ``scope_condition``) go to the
    vectors in blocks of limited size; a task keeps its best ``limit`` of each question. Scores
    are in double precision, to nine digits; ties go to the smaller chunk_id. Null vectors, zero
    ones (by cosine) and those of another length than the question take no part.
    """
    if limit <= 0:
        raise ValueError("a limit must be positive")
    scope = [c for c in SCOPE if c in questions.columns]
    meta = [c for c in META if c in vectors.columns] if scope else []
    kinds = dict(vectors.dtypes)
    schema = f"query_id {dict(questions.dtypes)['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    rows = vectors.where("embedding is not null").select("chunk_id", "embedding", *meta)
    parts = [rows.mapInArrow(_nearest(block, limit, metric, schema), schema) for block in _blocks(questions, scope)]
    found = reduce(DataFrame.unionAll, parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return best(found, limit)


def _blocks(questions: DataFrame, scope: list[str]) -> Iterator[list[tuple]]:
    """Questions as (id, vector, papers, versions, references) in blocks of limited size."""
    held, size = [], 0
    for r in questions.where("embedding is not null").select("query_id", "embedding", *scope).toLocalIterator():
        got = r.asDict()
        lists = [frozenset(got[c]) if got.get(c) else None for c in SCOPE[:2]]
        held.append((r.query_id, np.array(r.embedding, float), *lists, "include_references" not in scope or bool(got["include_references"])))
        size += 8 * len(r.embedding)
        if size >= _BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _nearest(block: list[tuple], limit: int, metric: str, schema: str | pa.Schema):
    out = arrow_schema(schema) if isinstance(schema, str) else schema  # a DDL needs the session

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in block]
        by_size: dict[int, list[int]] = {}
        for i, q in enumerate(block):
            by_size.setdefault(len(q[1]), []).append(i)
        sides = {n: np.stack([block[i][1] for i in own]) for n, own in by_size.items()}
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for n, own in by_size.items():
                some = batch.filter(pa.array(sizes == n))
                if not some.num_rows or not n:
                    continue
                v = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                ids = np.array(some.column("chunk_id").to_pylist(), object)
                score = _scores(sides[n], v, metric)
                open_ = _allowed(some, [block[i] for i in own])
                for row, i in enumerate(own):
                    s = score[row] if open_ is None else np.where(open_[row], score[row], np.nan)
                    at = np.flatnonzero(~np.isnan(s))
                    if len(at) > limit:  # all that equal the last one stay: the smaller ids win below
                        at = at[s[at] >= np.partition(s[at], len(at) - limit)[len(at) - limit]]
                    held[i] = sorted([*held[i], *zip((-s[at]).tolist(), ids[at].tolist())])[:limit]
        found = [(block[i][0], chunk, -s) for i, own in enumerate(held) for s, chunk in own]
        yield batch_of(found, out)

    return run


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (q @ v.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None])
    else:
        s = -((q * q).sum(1)[:, None] - 2 * (q @ v.T) + (v * v).sum(1)[None])
    return np.round(s, 9) + 0.0


def _allowed(rows: pa.RecordBatch, asked: list[tuple]) -> np.ndarray | None:
    """Questions x rows: what the scopes allow."""
    if "paper_id" not in rows.schema.names and "content_type" not in rows.schema.names and "version_id" not in rows.schema.names:
        return None
    own = {c: rows.column(c).to_pylist() if c in rows.schema.names else [None] * rows.num_rows for c in META}
    out = np.ones((len(asked), rows.num_rows), bool)
    plain = np.array([c != "reference" for c in own["content_type"]])
    for row, (_, _, papers, versions, references) in enumerate(asked):
        for ids, column in ((papers, "paper_id"), (versions, "version_id")):
            if ids is not None:
                out[row] &= np.fromiter((x in ids for x in own[column]), bool, rows.num_rows)
        if not references:
            out[row] &= plain
    return out


# fusion and reranking


def recall_queries(plans: DataFrame) -> DataFrame:
    """Plans (query_id, question, subqueries, paper_ids, clarification, include_references) to what each asks the routes.

    (query_id, qord, text, paper_ids, include_references): the question and its sub-questions, distinct,
    in order. Plans that need clarification or have no papers ask nothing.
    """
    ready = plans.where(F.col("clarification").isNull() & (F.coalesce(F.size("paper_ids"), F.lit(0)) > 0))
    texts = F.array_distinct(F.concat(F.array("question"), F.coalesce("subqueries", F.array().cast("array<string>"))))
    return ready.select("query_id", F.posexplode(texts).alias("qord", "text"), "paper_ids", "include_references")


def recall(queries: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Hits (query_id, qord, query, route, chunk_id, rank) of ``queries`` (see ``recall_queries``) by every route.

    A route takes (query_id, text, ...), with one id for each question and sub-question, to
    (query_id, chunk_id, rank).
    """
    return reduce(DataFrame.unionByName, [_routed(queries, name, route) for name, route in routes.items()])


def _routed(queries: DataFrame, name: str, route: Callable[[DataFrame], DataFrame]) -> DataFrame:
    keyed = queries.withColumn("own", F.struct("query_id", "qord")).withColumn("query_id", F.to_json("own"))
    hits = route(keyed).select(F.col("query_id").alias("key"), "chunk_id", "rank")
    named = keyed.select(F.col("query_id").alias("key"), "own.query_id", "own.qord", F.col("text").alias("query"))
    return hits.join(named, "key").drop("key").withColumn("route", F.lit(name))


def recalled(queries: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """``recall``, with what became of it: (hits, attempts). A route that fails is left out.

    Every route is run on its own and its hits are written, so that a failure is the route's and
    shows now. Attempts (query_id, route, failed) have a row for each question and route (see
    ``route_health``). Hits are None where every route failed.
    """
    hits, attempts = [], []
    asked = queries.select("query_id").distinct()
    for name, route in routes.items():
        try:
            hits.append(kept(_routed(queries, name, route), f"hits-{name}"))
            failed = False
        except Exception:  # a route's own: a service that is away, an index that isn't there
            failed = True
        attempts.append(asked.withColumn("route", F.lit(name)).withColumn("failed", F.lit(failed)))
    return reduce(DataFrame.unionByName, hits) if hits else None, reduce(DataFrame.unionByName, attempts)


def fuse(hits: DataFrame, k: int = 60, limit: int = 50) -> DataFrame:
    """Reciprocal rank fusion of hits (query_id, route, chunk_id, rank, paper_id, and content or content_key; qord and query where there are several).

    Candidates are ordered by fused score, then chunk_id; of one paper's equal contents the first
    stays; then the limit holds. Paper and content are those of the first hit by question, route
    and rank. Returns query_id, chunk_id, paper_id, rrf, traces (qord, place of the route, route,
    query, rank, in that order), rank.
    """
    if "content_key" not in hits.columns:
        hits = hits.withColumn("content_key", tx.content_key(F.col("content")))
    if "qord" not in hits.columns:
        hits = hits.withColumn("qord", F.lit(0)).withColumn("query", F.lit(None).cast("string"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route")), F.lit(0))
    trace = F.struct("qord", F.when(place > 0, place).otherwise(len(ROUTES) + 1).alias("place"), "route", "query", "rank")
    fused = hits.withColumn("trace", trace).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"), F.min_by("paper_id", "trace").alias("paper_id"),
        F.min_by("content_key", "trace").alias("content_key"), F.sort_array(F.collect_list("trace")).alias("traces"),
    )
    order = [F.desc("rrf"), F.asc("chunk_id")]
    same = Window.partitionBy("query_id", "paper_id", "content_key").orderBy(*order)
    single = fused.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    return best(single, limit, order).select("query_id", "chunk_id", "paper_id", "rrf", "traces", "rank")


def rerank(candidates: DataFrame, min_score: float = 0.1, limit: int = 12, by_paper: bool = False, scorer: seams.PairScorer = seams.lexical_score) -> DataFrame:
    """Candidates (query_id, chunk_id, paper_id, query, text, rrf; qord, paper_ids, intent) by best score over their queries.

    Those from ``min_score`` on stay, by score, fused score and chunk_id. Comparisons (``by_paper``,
    or intent comparison) put each paper's best first, in the order of ``paper_ids`` (of the papers'
    ids, where there is none). ``matched`` has the queries that reached ``min_score``, in order.
    Candidates of a question for which the scorer gives a null come in their fused order instead,
    ``degraded``, with their fused score.
    """
    for name, default in (("qord", F.lit(0)), ("paper_ids", F.lit(None).cast(f"array<{dict(candidates.dtypes)['paper_id']}>")), ("intent", F.lit(None).cast("string"))):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, default)
    scored = scorer(candidates, "query", "text").withColumn("score", F.round("score", 9))
    passed = F.when(F.col("score") >= min_score, F.struct("qord", "query"))
    found = scored.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.max("rrf").alias("rrf"), F.first("paper_id").alias("paper_id"),
        F.transform(F.sort_array(F.collect_set(passed)), lambda x: x["query"]).alias("matched"),
        F.bool_or(F.col("score").isNull()).alias("failed"), F.first("paper_ids").alias("paper_ids"), F.first("intent").alias("intent"),
    )
    failed = F.bool_or("failed").over(Window.partitionBy("query_id"))
    placed = found.withColumn("degraded", failed).where(F.col("degraded") | (F.col("score") >= min_score))
    placed = placed.withColumn("score", F.when(F.col("degraded"), F.col("rrf")).otherwise(F.col("score")))
    placed = placed.withColumn("matched", F.when(F.col("degraded"), F.array().cast("array<string>")).otherwise(F.col("matched")))
    order = [F.desc("score"), F.desc("rrf"), F.asc("chunk_id")]
    lead = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy(*order)) == 1
    compares = (F.lit(by_paper) | (F.coalesce("intent", F.lit("")) == "comparison")) & ~F.col("degraded")
    listed = F.array_position("paper_ids", F.col("paper_id"))
    turn = F.when(F.col("paper_ids").isNull(), F.dense_rank().over(Window.partitionBy("query_id").orderBy("paper_id"))).when(listed > 0, listed)
    ranked = best(placed.withColumn("first", F.when(lead & compares, turn)), limit, [F.col("first").asc_nulls_last(), *order])
    return ranked.select("query_id", "chunk_id", "score", "rrf", "paper_id", "matched", "degraded", "rank")


def diverse(hits: DataFrame, k: int = 4, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance of hits (query_id, chunk_id, q, v): k of each question, chosen one after the other.

    The hits of a question are few (the retrieval limit bounds them).
    """

    def choose(rows):
        rows = rows.sort_values("chunk_id").reset_index(drop=True)
        v, q = np.array(rows["v"].tolist(), float), np.array(rows["q"].iloc[0], float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        near, picked = v @ (q / np.linalg.norm(q)), []
        while len(picked) < min(k, len(rows)):
            worst = (v @ v[picked].T).max(1) if picked else np.zeros(len(rows))
            gain = np.round(weight * near - (1 - weight) * worst, 9) if picked else np.round(near, 9)
            gain[picked] = -np.inf
            picked.append(int(gain.argmax()))
        return rows.loc[picked, ["query_id", "chunk_id"]].assign(rank=range(1, len(picked) + 1))

    return hits.groupBy("query_id").applyInPandas(choose, "query_id long, chunk_id long, rank int")


def of_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks, by chunk_id. Hits are written; if they are few, they go to the chunks, which aren't moved."""
    return chunks.join(small(kept(hits, "hits")), "chunk_id")


def two_stage(hits: DataFrame, questions: DataFrame, chunks: DataFrame, limit: int = 3, scorer: seams.PairScorer = seams.lexical_score) -> DataFrame:
    """Recalled hits (query_id, chunk_id), scored as pairs of question and text: the best ``limit`` of each question."""
    pairs = of_chunks(hits.select("query_id", "chunk_id"), chunks.select("chunk_id", "text")).join(questions.select("query_id", F.col("text").alias("query")), "query_id")
    scored = scorer(pairs, "query", "text").select("query_id", "chunk_id", F.round("score", 9).alias("score"))
    return best(scored, limit)


def route_health(attempts: DataFrame, routes: int = 2) -> DataFrame:
    """Attempts (query_id, route, failed): degraded when any failed or one of the routes never succeeded."""
    good = F.count_distinct(F.when(~F.col("failed"), F.col("route")))
    counts = attempts.groupBy("query_id").agg(F.count_if("failed").alias("failures"), good.alias("succeeded"))
    return counts.select("query_id", "failures", ((F.col("failures") > 0) | (F.col("succeeded") < routes)).alias("degraded"))


# facets

#: What is asked of each paper for an analysis, and the section titles that are looked for.
FACETS = {
    "summary": [
        "abstract overview contributions", "introduction motivation problem", "method architecture workflow",
        "experiments datasets baselines results", "conclusion findings", "limitations failure cases future work",
    ],
    "method": [
        "method objective task", "method inputs outputs", "method assumptions", "architecture modules components", "method workflow algorithm steps",
        "training objective loss function", "datasets data construction", "parameters implementation settings", "evaluation metrics experiments",
    ],
    "innovation": ["author stated contributions", "novel innovation proposed method", "comparison baselines improvements", "limitations future work"],
}
HINTS = {
    "summary": [["abstract"], ["introduction"], ["method", "methodology"], ["experiment"], ["result"], ["conclusion"], ["limitation"]],
    "method": [["method", "methodology"], ["2.1"], ["2.2"], ["2.3"], ["architecture", "framework"], ["experiment setup"], ["evaluation"]],
    "innovation": [["abstract"], ["introduction"], ["conclusion"], ["limitation"]],
}
_INPUTS = 24


def facet_queries(intent: str) -> list[str]:
    return FACETS.get(intent, [intent])


def facet_share(intent: str, inputs: int = _INPUTS) -> int:
    """Candidates of each canned query that go to the reranker."""
    return max(1, inputs // len(facet_queries(intent)))


def hinted_section(section_path, hints: list[str]) -> Column:
    """Whether a section's path holds one of the hints, case aside."""
    path = tx.casefold(F.array_join(section_path, " > "))
    return reduce(Column.__or__, [F.contains(path, F.lit(h.casefold())) for h in hints])


def section_candidates(chunks: DataFrame, intent: str) -> DataFrame:
    """Of each paper's chunks (paper_id, chunk_id, text, section_path, page_start, page_end, quality_score), one for each hint.

    (paper_id, chunk_id, score, rrf, facet): the longest that fits and isn't of low quality; equal
    ones by page_start, page_end and chunk_id. The score falls with the hint's place.
    """
    good = chunks.where(F.col("quality_score").isNull() | (F.col("quality_score") >= 0.5))
    order = [F.desc(F.length("text")), "page_start", "page_end", "chunk_id"]
    parts = []
    for place, hints in enumerate(HINTS.get(intent, [])):
        own = good.where(F.coalesce(hinted_section(F.col("section_path"), hints), F.lit(False)))
        top = own.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).where("n = 1")
        parts.append(top.select("paper_id", "chunk_id", F.lit(2.0 - place * 0.01).alias("score"), F.lit(1.0).alias("rrf"), F.lit(f"section:{hints[0]}").alias("facet")))
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}
    empty = chunks.sparkSession.createDataFrame([], f"paper_id {kind['paper_id']}, chunk_id {kind['chunk_id']}, score double, rrf double, facet string")
    return reduce(DataFrame.unionAll, parts) if parts else empty


def facet_selection(reranked: DataFrame, sections: DataFrame, limit: int = 12) -> DataFrame:
    """Per paper, reranked hits of its canned queries (paper_id, chunk_id, score, rrf, facet) and section candidates, spread over facets.

    (paper_id, place, chunk_id); by score, fused score and chunk_id, the best of each facet first.
    """
    both = reranked.unionByName(sections)
    line = Window.partitionBy("paper_id").orderBy(F.desc("score"), F.desc("rrf"), "chunk_id", "facet")
    ranked = both.withColumn("rank", F.row_number().over(line)).withColumnRenamed("paper_id", "query_id")
    return spread_over_facets(ranked, limit).withColumnRenamed("query_id", "paper_id")


def spread_over_facets(ranked: DataFrame, limit: int = 12) -> DataFrame:
    """Ranked hits (query_id, rank, chunk_id, facet): the best unseen chunk of each facet first, then the others by rank.

    A chunk counts once; a facet whose best chunk another facet has taken gives its next one. A null
    or empty facet only takes part in filling up. A fold over each question's hits, whose number
    the retrieval limits bound.
    """
    kind = dict(ranked.dtypes)["chunk_id"]
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("facet", F.lit("")).alias("facet")))).alias("hits"))
    first = f"""aggregate(hits, named_struct('ids', cast(array() as array<{kind}>), 'facets', cast(array() as array<string>)), (a, x) ->
      if(x.facet = '' or array_contains(a.facets, x.facet) or array_contains(a.ids, x.chunk_id), a,
        named_struct('ids', array_append(a.ids, x.chunk_id), 'facets', array_append(a.facets, x.facet)))).ids"""
    led = listed.withColumn("led", F.expr(first))
    every = F.array_distinct(F.concat("led", F.transform("hits", lambda x: x["chunk_id"])))
    return led.select("query_id", F.posexplode(F.slice(every, 1, limit)).alias("place", "chunk_id")).withColumn("place", F.col("place") + 1)
