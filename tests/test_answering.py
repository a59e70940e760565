"""Whole chains: documents into both stores, questions to messages."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import grounding, lifecycle, retrieval, seams
from folioscope.plans import answering
from folioscope.sources.sinks import KeywordStore, VectorStore


def ingested(spark):
    lines = [("v1", "title", "Whales"), ("v1", "text", "Blue whales sing low songs."), ("v1", "text", "They dive deep."), ("v2", "title", "Foxes"), ("v2", "text", "Red foxes hunt mice at dusk."), ("v3", "text", "unread")]
    items = spark.createDataFrame([(v, 1, i, k, t) for i, (v, k, t) in enumerate(lines)], "version_id string, page_no int, pos int, label string, text string")
    pages = spark.createDataFrame([("v1", 1, 0.0), ("v2", 1, 0.0), *[("v3", n, 0.0) for n in range(1, 5)]], "version_id string, page_no int, garbled double")
    versions = spark.createDataFrame([("v1", "p1", "parsing"), ("v2", "p2", "parsing"), ("v3", "p3", "parsing")], "version_id string, paper_id string, parse_status string")
    papers = spark.createDataFrame([(f"p{i}", None, "parsing", None, f"Paper {i}") for i in (1, 2, 3)], "paper_id string, active_version_id string, status string, quality_level string, title string")
    return answering.ingest(items, pages, versions, papers)


def test_documents_are_stored_and_found(spark, tmp_path):
    made = ingested(spark)
    assert {(r.paper_id, r.status) for r in made.papers.collect()} == {("p1", "ready"), ("p2", "ready"), ("p3", "failed")}
    assert {r.version_id for r in made.chunks.collect()} == {"v1", "v2"}
    assert {(r.version_id, r.level, "No section structure was detected" in r.warnings) for r in made.reports.collect()} == {("v1", "ready", False), ("v2", "ready", False), ("v3", "failed", True)}
    keyword, vector = KeywordStore(spark, f"file://{tmp_path}/k", {}), VectorStore(spark, f"file://{tmp_path}/v", {"dimension": 64}, seams.hashed_embedding(64))
    for _ in range(2):  # the same again changes nothing
        answering.store(made.chunks, keyword, vector)
    asked = spark.createDataFrame([(1, "foxes at dusk", ["p1", "p2"], False), (2, "foxes at dusk", ["p1"], False)], "query_id long, text string, paper_ids array<string>, include_references boolean")
    papers = {r.chunk_id: r.paper_id for r in made.chunks.collect()}
    assert keyword.read().count() == vector.read().count() == len(papers) == 4
    for store in (keyword, vector):
        hits = store.search(asked).collect()
        assert papers[min((r["rank"], r.chunk_id) for r in hits if r.query_id == 1)[1]] == "p2" and {papers[r.chunk_id] for r in hits if r.query_id == 2} <= {"p1"}


def test_questions_become_messages(spark, tmp_path):
    made = ingested(spark)
    keyword = KeywordStore(spark, f"file://{tmp_path}/k", {})
    keyword.upsert(answering.index_records(made.chunks))

    def reply(rows):
        claims = F.concat(F.lit('[{"text": "t", "support": "direct", "evidence_ids": ["'), F.get_json_object("evidence", "$[0].evidence_id"), F.lit('"]}]'))
        return rows.withColumn("response", F.concat(F.lit('{"answer_status": "answered", "concise_answer": "At dusk.", "uncertainty": [], "conflicts": [], "unanswered_items": [], "refusal_reason": null, "claims": '), claims, F.lit("}")))

    chain = answering.Answering(made.chunks, made.papers.select("paper_id", "title"), {"keyword": keyword.search}, generator=reply)
    questions = spark.createDataFrame(
        [(1, "c", "When do red foxes hunt?", ["p2"], "selected", None), (2, "c", "zebra", ["p2"], "selected", None), (3, "c", "x", [], "selected", None), (4, "c", "y" * 8001, ["p1"], "selected", None)],
        "query_id long, conversation_id string, question string, paper_ids array<string>, scope_mode string, previous string",
    )
    got = {r.query_id: r for r in chain.answers(questions).collect()}
    assert [got[i].answer_status for i in (1, 2, 3, 4)] == ["answered", "insufficient_evidence", "out_of_scope", "out_of_scope"]
    assert got[1].citations == ["Paper 2 (v2), p. 1, Foxes"] and got[2].concise_answer == grounding.UNKNOWN and got[4].refusal_reason == "too_long"
    talk = chain.messages(questions, chain.answers(questions), F.lit("now")).collect()
    assert sorted((r.pair_id, r.role) for r in talk) == [(str(i), role) for i in (1, 2, 3, 4) for role in ("assistant", "user")]
    silent = answering.Answering(made.chunks, made.papers.select("paper_id", "title"), {"keyword": keyword.search})
    assert silent.answers(questions.where("query_id = 1")).first().refusal_reason == "empty response"


def test_a_route_that_fails_is_left_out(spark, tmp_path):
    made = ingested(spark)
    keyword = KeywordStore(spark, f"file://{tmp_path}/k", {})
    keyword.upsert(answering.index_records(made.chunks))
    late = lambda q: keyword.search(q).withColumn("rank", F.raise_error(F.lit("gone")).cast("int"))  # noqa: E731  fails while it runs
    chain = answering.Answering(made.chunks, made.papers.select("paper_id", "title"), {"keyword": keyword.search, "vector": late})
    questions = spark.createDataFrame([(1, "c", "When do red foxes hunt?", ["p2"], "selected", None)], "query_id long, conversation_id string, question string, paper_ids array<string>, scope_mode string, previous string")
    plans = chain.plans(questions)
    candidates, health = chain.recall(plans)
    assert {r.paper_id for r in candidates.collect()} == {"p2"}
    assert [(r.query_id, r.failures, r.degraded) for r in health.collect()] == [(1, 1, True)]
    assert chain.answers(questions).first().degraded
    dead = answering.Answering(made.chunks, made.papers.select("paper_id", "title"), {"vector": late})
    assert dead.candidates(plans).count() == 0


def test_facets_are_recalled_query_by_query(spark, tmp_path):
    texts = [
        ("a", "p1", "Our novel method is an innovation we proposed."), ("b", "p1", "Against baselines we see improvements by comparison."), ("c", "p1", "The limitations lead to future work."),
        ("d", "p2", "A proposed method of another paper, novel innovation."), ("e", "p1", "Nothing to be seen."),
    ]
    rows = [(c, p, "v", "text", t, 1, 1, [], None, None) for c, p, t in texts]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, version_id string, content_type string, text string, page_start int, page_end int, section_path array<string>, quality_score double, parent_chunk_id string")
    keyword = KeywordStore(spark, f"file://{tmp_path}/k", {})
    keyword.upsert(chunks)
    papers = spark.createDataFrame([("p1", "One"), ("p2", "Two")], "paper_id string, title string")
    hits, attempts = answering.facet_hits(papers, "innovation", {"keyword": keyword.search}, chunks)
    got = {(r.paper_id, r.facet, r.chunk_id): r.score for r in hits.collect()}
    assert {k[2] for k in got if k[1] == "novel innovation proposed method" and k[0] == "p1"} == {"a"} and {k[2] for k in got if k[0] == "p2"} == {"d"}
    assert ("p1", "comparison baselines improvements", "b") in got and ("p1", "limitations future work", "c") in got and not any(k[2] == "e" for k in got)
    assert attempts.where("failed").count() == 0
    found = answering.facet_registries(hits, chunks, papers, "innovation")
    assert {r.chunk_id for r in found.where("question_id = 'p1'").collect()} == {"a", "b", "c"}


def test_a_failed_build_marks_its_version(spark):
    versions = spark.createDataFrame([(1, "ready"), (2, "parsing"), (3, "parsing")], "version_id long, parse_status string")
    builds = spark.createDataFrame([("p", 2), ("q", 3)], "paper_id string, version_id long")
    outcome = spark.createDataFrame([("p", "broken"), ("q", None)], "paper_id string, error string")
    assert sorted(map(tuple, lifecycle.marked_builds(versions, builds, outcome).collect())) == [(1, "ready"), (2, "failed"), (3, "parsing")]


def test_lists_labels_and_instructions(spark):
    rows = spark.createDataFrame([("a", 2, "ready"), ("b", 1, "failed"), ("c", 2, "other")], "paper_id string, created_at int, status string")
    assert [r.paper_id for r in lifecycle.listed(rows, "papers").collect()] == ["a", "c", "b"] and [r.paper_id for r in lifecycle.available(rows).collect()] == ["a"]
    assert [r[0] for r in rows.select(lifecycle.label_of(lifecycle.PAPER_LABELS, F.col("status"))).collect()] == ["可用", "处理失败", ""]
    steps = spark.createDataFrame([(1,), (2,), (3,)], "version int")
    assert [r.version for r in lifecycle.pending(steps, steps.where("version = 2")).orderBy("version").collect()] == [1, 3]
    assert retrieval.facet_share("summary") == 4 and retrieval.facet_share("method") == 2 and retrieval.facet_share("other") == 24 and retrieval.facet_queries("other") == ["other"]
    said = spark.range(1).select(grounding.messages("answer", F.lit("Q"), F.lit("[]")).alias("m")).first().m
    assert [m.role for m in said] == ["system", "user"] and said[1].content == "Q\n\nEvidence: []"
    with pytest.raises(KeyError):
        grounding.instruction("answer", "v9")
