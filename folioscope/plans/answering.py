"""Whole chains over batches: from documents to indexes, and from questions to verified answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import chunking, grounding, lifecycle, normalize, planner, retrieval, seams
from folioscope.sources.sinks import KeywordStore, VectorStore
from folioscope.sources.work import kept, parts_for

Route = Callable[[DataFrame], DataFrame]


@dataclass
class Ingested:
    """What one run of ``ingest`` made; all tables are lazy."""

    pages: DataFrame
    blocks: DataFrame
    reports: DataFrame
    chunks: DataFrame
    versions: DataFrame
    papers: DataFrame


def ingest(
    items: DataFrame, pages: DataFrame, versions: DataFrame, papers: DataFrame, ocr_pages: DataFrame | None = None, ocr_lines: DataFrame | None = None,
    settings: chunking.ChunkSettings = chunking.ChunkSettings(), tokenizer: seams.Tokenizer | None = None,
) -> Ingested:
    """Parser items of versions to pages, blocks, quality reports, chunks and states.

    ``pages``: version_id, page_no, garbled (and coverage); ``versions``: version_id, paper_id,
    parse_status; ``papers``: paper_id, active_version_id, status, quality_level. A version that was
    ingested becomes its paper's active one; versions whose quality failed give no chunks.
    """
    parts = parts_for(items, "text")
    page_rows, blocks = normalize.document(items, pages, ocr_pages, ocr_lines, parts)
    covered = normalize.covered_pages(pages, blocks)
    if ocr_pages is not None:
        read = ocr_pages.select("version_id", "page_no", F.col("status").alias("ocr_status"), "confidence")
        covered = covered.join(read, ["version_id", "page_no"], "left")
    else:
        covered = covered.withColumn("ocr_status", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    reports = normalize.quality(covered, normalize.kind_counts(blocks))
    usable = blocks.join(reports.where("level <> 'failed'").select("version_id"), "version_id", "left_semi")
    chunks = chunking.build(usable, settings, tokenizer, parts)
    named = chunks.join(versions.select(F.col("version_id").cast("string").alias("version_id"), "paper_id"), "version_id", "left")
    newest = versions.join(reports.select("version_id"), "version_id", "left_semi").groupBy("paper_id").agg(F.max("version_id").alias("_version"))
    current = papers.join(newest, "paper_id", "left").withColumn("active_version_id", F.coalesce("_version", "active_version_id")).drop("_version")
    parsed, stated = normalize.propagated(versions, current, reports)
    return Ingested(page_rows, blocks, reports, named, parsed, stated)


def index_records(chunks: DataFrame) -> DataFrame:
    """Chunks, parents and children alike, as the records of both indexes."""
    return chunks.select("chunk_id", "text", "paper_id", "version_id", "content_type", "parent_chunk_id", "page_start", "page_end", "section_path", "quality_score")


def store(chunks: DataFrame, keyword: KeywordStore, vector: VectorStore) -> None:
    """Both indexes take all chunks; repeating it changes nothing."""
    records = index_records(chunks)
    keyword.upsert(records)
    vector.upsert(records)


@dataclass
class Answering:
    """Questions to answers over chunks (see ``chunking.CHUNKS``, with paper_id) and papers (paper_id, title).

    Routes take (query_id, text, paper_ids, include_references) to ranked hits. The scorer, judge
    and generator are seams; without a generator, questions with evidence get no answer.
    """

    chunks: DataFrame
    papers: DataFrame
    routes: dict[str, Route]
    scorer: seams.PairScorer = seams.lexical_score
    judge: seams.Judge = seams.direct_judge
    generator: seams.Generator = seams.no_answer
    window: int = 16384
    ratio: float = 0.5
    route_limit: int = 50
    candidate_limit: int = 50
    rerank_inputs: int = 24
    rerank_limit: int = 12
    tokens: Callable = field(default=F.length)

    def plans(self, questions: DataFrame) -> DataFrame:
        """Questions (query_id, question, paper_ids, scope_mode, previous) with their plans; those that are turned away have an ``error``."""
        found = planner.plan(questions)
        return found.withColumn("error", F.coalesce("error", lifecycle.question_problem(F.col("question"))))

    def candidates(self, plans: DataFrame) -> DataFrame:
        """What all routes recall for the question and its sub-questions, fused."""
        return self.recall(plans)[0]

    def recall(self, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``candidates``, and the health of the recall (query_id, failures, degraded): a route that fails is left out."""
        queries = kept(retrieval.recall_queries(plans.where("error is null")), "queries")
        found, attempts = retrieval.recalled(queries, self.routes)
        health = retrieval.route_health(attempts, len(self.routes))
        if found is None:
            ids = dict(self.chunks.dtypes)["chunk_id"]
            found = queries.where("false").select("query_id", "qord", F.col("text").alias("query"), F.lit(None).cast(ids).alias("chunk_id"), F.lit(0).alias("rank"), F.lit("").alias("route"))
        known = self.chunks.join(retrieval.small(found.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "paper_id", F.md5(tx.content_key(F.col("text"))).alias("content_key"))
        return retrieval.fuse(found.join(kept(known, "known"), "chunk_id"), limit=self.candidate_limit), health

    def ranked(self, plans: DataFrame, candidates: DataFrame) -> DataFrame:
        """The best candidates by the scorer, over all queries of their plan."""
        queries = retrieval.recall_queries(plans).select("query_id", "qord", F.col("text").alias("query"))
        asked = plans.select("query_id", "paper_ids", "intent")
        some = candidates.where(F.col("rank") <= self.rerank_inputs).drop("rank", "traces")
        pairs = retrieval.of_chunks(some, self.chunks.select("chunk_id", "text")).join(queries, "query_id").join(asked, "query_id")
        return retrieval.rerank(pairs, limit=self.rerank_limit, scorer=self.scorer)

    def evidence(self, ranked: DataFrame) -> DataFrame:
        """Ranked chunks and their parents within the token budget, as evidence."""
        own = self.chunks.join(retrieval.small(ranked.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", F.col("parent_chunk_id").alias("parent_id"))
        none = F.lit(None).cast("string")
        links = own.withColumn("previous_id", none).withColumn("next_id", none).withColumn("related", F.array().cast("array<string>"))
        seeds = ranked.select(F.col("query_id").alias("question_id"), F.col("rank").alias("ord"), "chunk_id", "paper_id")
        offered = kept(grounding.expanded(seeds.drop("paper_id"), links), "offered")
        near = kept(self.chunks.join(retrieval.small(offered.select("chunk_id").distinct()), "chunk_id", "left_semi"), "near")  # few of all chunks
        papers = seeds.select("question_id", F.col("chunk_id").alias("seed"), "paper_id")
        known = near.select("chunk_id", "text", "quality_score", F.lit(True).alias("known"))
        rows = offered.join(papers, ["question_id", "seed"]).join(known, "chunk_id", "left").select(
            "question_id", (F.col("ord") * 1000 + F.col("step")).alias("ord"), F.col("chunk_id").alias("item_id"), F.coalesce(self.tokens(F.col("text")), F.lit(0)).alias("tokens"),
            F.col("quality_score").alias("quality"), F.col("text").alias("content"), "paper_id", F.coalesce("known", F.lit(False)).alias("known"),
        )
        within = grounding.budgeted(rows, grounding.evidence_budget(self.window, self.ratio)).select("question_id", F.posexplode("items").alias("ord", "chunk_id"))
        paper = rows.groupBy("question_id", F.col("item_id").alias("chunk_id")).agg(F.min_by("paper_id", "ord").alias("paper_id"))
        context = within.join(paper, ["question_id", "chunk_id"]).join(near.drop("paper_id"), "chunk_id").withColumnRenamed("quality_score", "quality")
        return grounding.registry(context, self.papers)

    def sufficiency(self, plans: DataFrame, evidence: DataFrame) -> DataFrame:
        """Each question's status and unanswered parts, by the judge's levels of all its evidence; parts without evidence are insufficient."""
        parts = plans.select(F.col("query_id").alias("question_id"), F.posexplode(F.when(F.size("subqueries") > 0, F.col("subqueries")).otherwise(F.array("resolved"))).alias("ord", "part"))
        pairs = parts.join(evidence.select("question_id", "evidence_id", "text", "quality"), "question_id", "left")
        judged = self.judge(pairs).withColumn("level", F.when(F.col("evidence_id").isNotNull(), F.col("level")))
        return grounding.sufficiency(judged)

    def answers(self, questions: DataFrame) -> DataFrame:
        """One row per question: (query_id, answer_status, concise_answer, claims, evidence_ids, citations, unanswered_items, warnings, refusal_reason, degraded).

        Plans that need clarification are out of scope; without sufficient evidence nothing is
        generated. A generator's answer that isn't valid is refused, with the reason. Claims are
        verified against the question's own evidence. Questions with an error come back with it. The
        tables between the steps are written, so that a model answers each prompt once.
        """
        plans = kept(self.plans(questions), "plans")
        ready = plans.where("error is null and clarification is null")
        candidates, health = self.recall(ready)
        ranked = kept(self.ranked(ready, kept(candidates, "candidates")), "ranked")
        evidence = kept(self.evidence(ranked), "evidence")
        status = kept(self.sufficiency(ready, evidence), "sufficiency")
        supported = ready.join(status.withColumnRenamed("question_id", "query_id"), "query_id")
        listed = evidence.groupBy(F.col("question_id").alias("query_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", "evidence_id", "label", "text")))).alias("evidence"))
        asked = supported.where("status <> 'insufficient_evidence'").join(listed, "query_id")
        prompt = F.to_json(grounding.messages("answer", F.concat(F.lit("Question: "), "resolved"), F.col("evidence")))
        parsed = kept(grounding.parsed_answers(self.generator(asked.withColumn("prompt", prompt).drop("error"))), "responses")
        given = parsed.where("error is null").select(F.col("query_id").alias("answer_id"), "answer.*", F.col("unanswered_items").alias("plan_unanswered"))
        claims = given.select("answer_id", F.posexplode("claims").alias("claim", "c")).select("answer_id", "claim", "c.*")
        own = evidence.select(F.col("question_id").alias("answer_id"), "evidence_id")
        checked = grounding.verify_answers(given.drop("claims"), self.judge(claims), own)
        none = F.array().cast("array<string>")
        refuse = lambda rows, state, why: rows.select(
            F.col("query_id").alias("answer_id"), F.lit(state).alias("answer_status"), F.lit(grounding.UNKNOWN).alias("concise_answer"), none.alias("unanswered_items"), none.alias("warnings"), why.alias("refusal_reason"),
        )
        out = checked.select("answer_id", "answer_status", "concise_answer", "claims", "unanswered_items", "warnings", "refusal_reason")
        for rows in (
            refuse(plans.where("error is not null"), "out_of_scope", F.col("error")),
            refuse(plans.where("error is null and clarification is not null"), "out_of_scope", F.col("clarification")),
            refuse(supported.where("status = 'insufficient_evidence'"), "insufficient_evidence", F.lit(grounding.UNSUPPORTED)),
            refuse(parsed.where("error is not null"), "insufficient_evidence", F.col("error")),
        ):
            out = out.unionByName(rows, allowMissingColumns=True)
        ids = F.array_distinct(F.flatten(F.transform(F.coalesce("claims", F.array()), lambda c: c["evidence_ids"])))
        out = kept(out.withColumn("evidence_ids", F.coalesce(ids, none)), "answers")
        allowed = plans.select(F.col("query_id").alias("question_id"), "paper_ids")
        cited = grounding.resolved(out.select(F.col("answer_id").alias("question_id"), "evidence_ids"), evidence, allowed)
        labels = cited.groupBy(F.col("question_id").alias("answer_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda r: r["label"]).alias("citations"))
        either = ranked.select("query_id", "degraded").unionByName(health.select("query_id", "degraded"))  # of the scorer, or of a route
        weak = either.groupBy(F.col("query_id").alias("answer_id")).agg(F.bool_or("degraded").alias("degraded"))
        joined = out.join(labels, "answer_id", "left").join(weak, "answer_id", "left").withColumn("degraded", F.coalesce("degraded", F.lit(False)))
        return joined.withColumn("citations", F.coalesce("citations", none)).withColumnRenamed("answer_id", "query_id")

    def messages(self, questions: DataFrame, answers: DataFrame, now) -> DataFrame:
        """The pairs of messages that a batch of answers leaves in its conversations (conversation_id)."""
        key = F.col("query_id").cast("string")
        asked = questions.select(key.alias("pair_id"), "conversation_id", F.col("question").alias("content"), "paper_ids")
        told = answers.select(key.alias("pair_id"), F.col("concise_answer").alias("content"), "answer_status", "evidence_ids")
        own = questions.select(key.alias("pair_id"), "conversation_id", "paper_ids")
        return lifecycle.paired(asked, told.join(own, "pair_id")).withColumn("created_at", now)


def facet_hits(papers: DataFrame, intent: str, routes: dict[str, Route], chunks: DataFrame, scorer: seams.PairScorer = seams.lexical_score, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The intent's canned queries on every paper (paper_id): (hits, attempts).

    Each query is recalled by all routes within its paper, fused, and the best
    ``retrieval.facet_share`` candidates are scored: (paper_id, facet, chunk_id, score, rrf) of those
    that the reranking keeps. Attempts are those of ``retrieval.recalled``, by paper.
    """
    facets = F.array(*[F.lit(q) for q in retrieval.facet_queries(intent)])
    queries = papers.select(F.col("paper_id").alias("query_id"), F.posexplode(facets).alias("qord", "text"), F.array("paper_id").alias("paper_ids"), F.lit(False).alias("include_references"))
    found, attempts = retrieval.recalled(kept(queries, "facets"), routes)
    kinds = dict(chunks.dtypes)
    if found is None:
        return chunks.sparkSession.createDataFrame([], f"paper_id {kinds['paper_id']}, facet string, chunk_id {kinds['chunk_id']}, score double, rrf double"), attempts
    known = chunks.select("chunk_id", "paper_id", F.md5(tx.content_key(F.col("text"))).alias("content_key"))
    own = found.withColumn("query_id", F.to_json(F.struct("query_id", "qord"))).select("query_id", "query", "route", "chunk_id", "rank").join(known, "chunk_id")
    share = retrieval.facet_share(intent)
    fused = kept(retrieval.fuse(own.drop("query"), limit=limit).where(F.col("rank") <= share), "facet-candidates")
    texts = own.select("query_id", "query").distinct()
    pairs = retrieval.of_chunks(fused.select("query_id", "chunk_id", "paper_id", "rrf"), chunks.select("chunk_id", "text")).join(texts, "query_id")
    ranked = retrieval.rerank(pairs, limit=share, scorer=scorer)
    return ranked.join(texts, "query_id").select("paper_id", F.col("query").alias("facet"), "chunk_id", "score", "rrf"), attempts


def facet_registries(paper_hits: DataFrame, chunks: DataFrame, papers: DataFrame, intent: str, limit: int = 12) -> DataFrame:
    """Evidence of each paper for an analysis: reranked hits of its canned queries (paper_id, facet, chunk_id, score, rrf), section candidates, one of each facet first.

    Per query the hits are those of ``retrieval.facet_share``; the best ``limit`` chunks of a paper become its evidence.
    """
    share = Window.partitionBy("paper_id", "facet").orderBy(F.desc("score"), F.desc("rrf"), "chunk_id")
    some = paper_hits.withColumn("n", F.row_number().over(share)).where(F.col("n") <= retrieval.facet_share(intent)).drop("n")
    picked = retrieval.facet_selection(some.select("paper_id", "chunk_id", "score", "rrf", "facet"), retrieval.section_candidates(chunks, intent), limit)
    context = picked.join(chunks.drop("paper_id"), "chunk_id").select("*", F.col("paper_id").alias("question_id"), F.col("place").alias("ord")).withColumnRenamed("quality_score", "quality")
    return grounding.registry(context, papers)
