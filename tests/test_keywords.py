"""The segmented keyword index: changes against a rebuild, what changes write, what searches pass over, writers at the same time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import keywords, retrieval
from folioscope.sources import sinks
from folioscope.sources import sinks
from folioscope.sources.sinks import Conflict, IndexTable, KeywordStore

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "chunk_id long, text string, paper_id string, version_id string, content_type string"


def chunk(rng, i, size=None):
    text = " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=size or rng.randint(3, 40)))
    return (i, text, f"p{i % 5}", f"v{i % 3}", "reference" if i % 7 == 0 else "text")


def hits(index, questions, limit=10):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in index.search(questions, limit).collect())


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, " ".join(rng.sample(WORDS, rng.randint(1, 6)))) for i in range(6)] + [(90, "w1-w2"), (91, "w0-w1-w0"), (92, None)], "query_id long, text string").cache()


def test_changes_equal_a_rebuild(spark, tmp_path, questions):
    rng = random.Random(1)
    store = KeywordStore(spark, f"file://{tmp_path}/k", {}, tier=2)
    rows = {}
    for step in range(4):
        new = {i: chunk(rng, i) for i in rng.sample(range(80), [60, 10, 8, 12][step])}
        store.upsert(spark.createDataFrame(list(new.values()), SCHEMA))
        rows |= new
        if step == 2:
            store.delete(papers=["p1"])
            rows = {i: r for i, r in rows.items() if r[2] != "p1"}
        if step == 1:
            store.delete(versions=["v2"])
            rows = {i: r for i, r in rows.items() if r[3] != "v2"}
    assert len(store.pointer()["segments"]) < 4 and store.pointer()["number"] == 6
    assert sorted(map(tuple, store.read().select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())) == sorted(rows.values())
    fresh = retrieval.build_index(spark.createDataFrame(list(rows.values()), SCHEMA), f"file://{tmp_path}/fresh")
    changed = store.index()
    assert (changed.n_docs, changed.avgdl) == (fresh.n_docs, fresh.avgdl)
    assert sorted(changed.terms.collect()) == sorted(fresh.terms.collect())
    assert sorted(changed.occurrences_of_terms().collect()) == sorted(fresh.occurrences_of_terms().collect())
    assert hits(changed, questions) == hits(fresh, questions)
    store.vacuum()
    assert hits(store.index(), questions) == hits(fresh, questions)
    store.delete(papers=[f"p{i}" for i in range(5)])
    with pytest.raises(ValueError):
        store.index()


def size_of(tmp_path, name):
    return sum(p.stat().st_size for p in (tmp_path / "k" / name).rglob("*.parquet"))


def test_a_small_change_writes_little(spark, tmp_path):
    rng = random.Random(2)
    store = KeywordStore(spark, f"file://{tmp_path}/k", {})
    store.upsert(spark.createDataFrame([chunk(rng, i, 60) for i in range(3000)], SCHEMA))
    (first,) = store.pointer()["segments"]
    store.upsert(spark.createDataFrame([chunk(rng, i, 60) for i in range(0, 3000, 100)], SCHEMA))
    pointer = store.pointer()
    new = [s for s in pointer["segments"] if s != first]
    assert first in pointer["segments"] and len(new) == 1 and pointer["segments"][new[0]]["n"] == 30
    entries = lambda s: spark.read.parquet(f"file://{tmp_path}/k/{s}/postings").agg(F.sum(F.size("chunk_ids"))).first()[0]
    assert entries(new[0]) < 0.015 * entries(first)
    assert size_of(tmp_path, pointer["changes"][0]) < 0.05 * size_of(tmp_path, first)


def test_bundles_that_cannot_win_are_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "BUNDLE", 16)
    rng = random.Random(3)
    rows = [(i, f"common {'rare ' * 3 if i < 24 else ''}{' '.join(rng.choices(WORDS, k=8))}", f"p{i // 24}", "v", "text") for i in range(24 * 40)]
    index = retrieval.build_index(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "common rare"), (2, "w3 rare")], "query_id long, text string")
    scored = []
    whole = keywords.KeywordIndex._scores
    monkeypatch.setattr(keywords.KeywordIndex, "_scores", lambda self, bundles, *rest: (scored.append(bundles.count()), whole(self, bundles, *rest))[1])
    got = hits(index, asked, 5)
    passed = sum(scored)
    monkeypatch.setattr(keywords, "_SLACK", 1e9)  # nothing is passed over
    scored.clear()
    assert hits(index, asked, 5) == got and {c for _, _, c, _ in got} <= set(range(24))
    assert passed < 0.3 * sum(scored)


def test_scopes_prune_before_scores_are_summed(spark, tmp_path):
    rng = random.Random(4)
    index = retrieval.build_index(spark.createDataFrame([chunk(rng, i) for i in range(200)], SCHEMA), f"file://{tmp_path}/index")
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "query_id long, text string").withColumn("paper_ids", ids("p1", "p4")).withColumn("version_ids", ids("v0")).withColumn("include_references", F.lit(False))
    meta = {r[0]: r[2:] for r in [chunk(random.Random(4), i) for i in range(200)]}
    free = {c: s for _, _, c, s in hits(index, asked.select("query_id", "text"), 200)}
    want = sorted(((-s, c) for c, s in free.items() if meta[c][0] in ("p1", "p4") and meta[c][1] == "v0" and meta[c][2] == "text"))[:10]
    assert [(-s, c) for _, _, c, s in hits(index, asked)] == want
    weighted, postings, few = index._weighted(asked)
    scopes = asked.drop("text")
    plan = index._scores(index._bounds(weighted, postings, scopes, few).select("query_id", "segment", "bundle"), weighted, postings, scopes, None)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("round(sum(") < text.index("filter(arrays_zip")  # a plan is printed from its end


def test_phrases_meet_by_positions(spark, tmp_path):
    texts = ["a b c a b", "c b a", "a b x c", "b c a b c", None]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["a", "b", "c"],), (["b", "c", "a", "b", "c"],), (["a", "a"],), (["x", "a"],)], "phrase array<string>")
    found = index.occurrences(asked)
    assert "tokens:array" not in found._jdf.queryExecution().executedPlan().toString()
    got = {("".join(r.phrase), r.chunk_id): (r.tf, r.df) for r in found.collect()}
    assert got == {("ab", 0): (2, 3), ("ab", 2): (1, 3), ("ab", 3): (1, 3), ("bc", 0): (1, 2), ("bc", 3): (2, 2), ("abc", 0): (1, 2), ("abc", 3): (1, 2), ("bcabc", 3): (1, 1)}


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i, "x", "p", "v", "text") for i in ids], SCHEMA)
    for kind in (IndexTable, KeywordStore):
        one, two = (kind(spark, f"file://{tmp_path}/{kind.__name__}", {}) for _ in range(2))
        one.upsert(rows(1))
        real, times = sinks.write_json, []

        def meanwhile(*args, **more):
            times.append(1)
            if len(times) == 1:
                monkeypatch.setattr(sinks, "write_json", real)
                two.upsert(rows(2))  # publishes first
            return real(*args, **more)

        monkeypatch.setattr(sinks, "write_json", meanwhile)
        one.upsert(rows(3))
        assert {r.chunk_id for r in one.read().collect()} == {1, 2, 3}
        assert one.pointer()["number"] == 3
    sinks.write_json(spark, f"file://{tmp_path}", "once", 1, replace=False)
    with pytest.raises(Conflict):
        sinks.write_json(spark, f"file://{tmp_path}", "once", 2, replace=False)
    assert json.loads((tmp_path / "once.json").read_text()) == 1 and not list(tmp_path.glob("*.tmp"))


def test_searches_move_posting_rows_once_and_sum_where_they_are(spark, tmp_path):
    rng = random.Random(8)
    index = retrieval.build_index(spark.createDataFrame([chunk(rng, i) for i in range(120)], SCHEMA), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w2 w3")], "query_id long, text string")
    weighted, postings, few = index._weighted(asked)
    bundles = index._bounds(weighted, postings, None, few).select("query_id", "segment", "bundle")
    plan = index._scores(bundles, weighted, postings, None, None)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "chunk_id" in line.split("hashpartitioning")[1]]
    assert few and not moved and "SortMergeJoin" not in plan
    hits = index.search(asked, 5)
    assert "SortMergeJoin" not in retrieval.of_chunks(hits, index.docs.select("chunk_id", "tokens"))._jdf.queryExecution().executedPlan().toString()


def test_term_counts_without_taking_chunks_out(spark, tmp_path):
    store = KeywordStore(spark, f"file://{tmp_path}/k", {}, tier=8)
    store.upsert(spark.createDataFrame([(i, "a b a" if i % 2 else "b c", "p", "v", "text") for i in range(6)], SCHEMA))
    store.upsert(spark.createDataFrame([(1, "c", "p", "v", "text")], SCHEMA))
    index = store.index()
    assert index.gone is not None
    assert sorted(map(tuple, index.term_counts().collect())) == [("a", 4, 2), ("b", 5, 5), ("c", 4, 4)]
    got = index.search(spark.createDataFrame([(1, "a")], "query_id long, text string"))
    assert sorted(r.chunk_id for r in got.collect()) == [3, 5]


def test_an_upsert_writes_new_chunks_once(spark, tmp_path, monkeypatch):
    """rows were moved to look for repeats, and their tokens written twice."""
    labels = []
    for module in (sinks, keywords):
        monkeypatch.setattr(module, "kept", lambda rows, label, f=module.kept: labels.append(label) or f(rows, label))
    rng = random.Random(8)
    store = KeywordStore(spark, f"file://{tmp_path}/k", {})
    rows = [chunk(rng, i) for i in range(12)]
    store.upsert(spark.createDataFrame(rows, SCHEMA))
    assert "rows" in labels and "new-chunks" not in labels
    again = [chunk(rng, i) for i in (3, 3, 3, 40)]
    store.upsert(spark.createDataFrame(again, SCHEMA))
    held = {r[0]: r for r in map(tuple, store.read().select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())}
    assert store.index().n_docs == len(held) == 13 and held[3] in again and held[40] == again[3]
    assert all(held[i] == rows[i] for i in range(12) if i != 3)


def test_posting_rows_are_sorted_in_bounded_runs(spark, tmp_path, monkeypatch, questions):
    """a task sorted all posting rows of the docs that it read, and spilled on larger tables."""
    rng = random.Random(9)
    frame = spark.createDataFrame([chunk(rng, i, 20) for i in range(60)], SCHEMA).coalesce(1)
    whole = retrieval.build_index(frame, f"file://{tmp_path}/whole")
    monkeypatch.setattr(keywords, "BUNDLE", 4)
    monkeypatch.setattr(keywords, "_RUN", 1)
    cut = retrieval.build_index(frame, f"file://{tmp_path}/cut")
    runs = {}
    for part, bundle, term in spark.read.parquet(f"file://{tmp_path}/cut/postings").select(F.input_file_name(), "bundle", "term").collect():
        runs.setdefault((part, bundle), []).append(term)
    assert len(runs) >= 15 and all(r[-1] is None and r[:-1] == sorted(r[:-1]) for r in runs.values())
    assert hits(cut, questions) == hits(whole, questions)
