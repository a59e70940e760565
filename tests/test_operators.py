import math
import sys
from functools import reduce

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import agents, chunking, grounding, keywords, lifecycle, normalize, planner, retrieval, seams
from folioscope.sources import work

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_fusion_scores_order_and_traces(spark):
    hits = spark.createDataFrame(
        [(1, 0, "q", "keyword", "x", 1, 1, "tx"), (1, 0, "q", "vector", "x", 3, 1, "tx"), (1, 1, "r", "vector", "y", 1, 1, "ty"), (1, 1, "r", "keyword", "z", 4, 1, "tz"), (1, 1, "r", "vector", "z", 9, 1, "other")],
        "query_id long, qord int, query string, route string, chunk_id string, rank int, paper_id long, content string",
    )
    got = retrieval.fuse(hits).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "z", "y"]
    assert math.isclose(got[0].rrf, 1 / 61 + 1 / 63, abs_tol=1e-11)
    assert [(t.route, t.query, t["rank"]) for t in got[1].traces] == [("vector", "r", 9), ("keyword", "r", 4)]


def test_equal_contents_of_a_paper_count_once(spark):
    rows = [(1, "v", f"c{i}", i, p, t) for i, p, t in ((1, 1, "Straße  1"), (2, 1, " STRASSE 1 "), (3, 2, "strasse 1"), (4, 1, "ΣΑΣ"), (5, 1, "σας"))]
    hits = spark.createDataFrame(rows, "query_id long, route string, chunk_id string, rank int, paper_id long, content string")
    assert [r.chunk_id for r in retrieval.fuse(hits).orderBy("rank").collect()] == ["c1", "c3", "c4"]


def index_of(spark, tmp_path, texts, **more):
    rows = [(i, t, *[more[k][i] for k in more]) for i, t in enumerate(texts)]
    return retrieval.build_index(spark.createDataFrame(rows, ", ".join(["chunk_id long", "text string", *[f"{k} string" for k in more]])), f"file://{tmp_path}/index")


def asked(index, spark, text, **more):
    rows = spark.createDataFrame([(1, text)], "query_id long, text string")
    for name, value in more.items():
        rows = rows.withColumn(name, value)
    return [(r.chunk_id, r.score) for r in index.search(rows).orderBy("rank").collect()]


def test_bm25_by_its_formula(spark, tmp_path):
    texts = ["river bank river", "bank note", "note pad pad pad", None, "", "bank of a river side"]
    index = index_of(spark, tmp_path, texts)
    sizes = [len((t or "").split()) for t in texts]
    mean = sum(sizes) / len(sizes)

    def part(term, i):
        n, tf = sum(term in (t or "").split() for t in texts), (texts[i] or "").split().count(term)
        idf = math.log((6 - n + 0.5) / (n + 0.5))
        return (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[i] / mean))

    want = sorted(((-round(sum(part(t, i) for t in ("river", "bank")), 9), i) for i in (0, 1, 5)))
    assert asked(index, spark, "River bank river") == [(i, -s) for s, i in want]
    assert asked(index, spark, "nothing here") == [] and asked(index, spark, None) == [] and asked(index, spark, " . ") == []
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([(1, "x")], "query_id long, text string"), limit=0)


def test_identifiers_are_phrases_and_marks_fold(spark, tmp_path):
    texts = ["we use net-v2.5 here", "net v2 5 side by side", "v2 then net and 5", "Ｎｅｔ café №7", "naïve Ωmega ﬁne", "研究方法", "a_b c"]
    index = index_of(spark, tmp_path, texts)
    found = lambda q: {i for i, _ in asked(index, spark, q)}
    whole = index.occurrences(spark.createDataFrame([(1, ["net", "v2", "5"])], "query_id long, phrase array<string>")).collect()
    assert {(r.chunk_id, r.df) for r in whole} == {(0, 2), (1, 2)}
    assert found("net-v2.5") == {0, 1, 2, 3} and found("CAFÉ") == {3} == found("café") and found("naive") == {4} and found("fine") == {4} and found("ωmega") == {4}
    assert found("方法") == {5} and found("a b") == {6} and found("a-b") == {6} and found("b-a") == {6} and found("b_a") == {6}
    apart = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "b"])], "query_id long, phrase array<string>")
    assert sorted((r.phrase, r.tf) for r in index.occurrences(apart).collect()) == [(["a", "b"], 3), (["b", "a"], 1)]  # its parts stand twice behind the text


def test_many_asked_terms_are_met_by_salted_joins(spark, tmp_path, monkeypatch):
    index = index_of(spark, tmp_path, [f"common w{i} w{i + 1}" for i in range(40)])
    questions = spark.createDataFrame([(i, f"common w{i}") for i in range(10)], "query_id long, text string")
    want = index.search(questions, 3).collect()
    monkeypatch.setattr(keywords, "_FEW", 0)
    assert sorted(index.search(questions, 3).collect()) == sorted(want)


def test_scopes_filter_without_touching_the_statistics(spark, tmp_path):
    index = index_of(spark, tmp_path, ["ant bee", "ant cow", "ant dog", "eel"], paper_id=["p", "p", "q", "q"], version_id=["1", "2", "3", "3"], content_type=["text", "reference", "text", "text"])
    free = dict(asked(index, spark, "ant"))
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    no = F.lit(False)
    assert asked(index, spark, "ant", paper_ids=ids("p"), include_references=no) == [(0, free[0])]
    assert asked(index, spark, "ant", paper_ids=ids("p"), include_references=F.lit(True)) == [(0, free[0]), (1, free[1])]
    assert asked(index, spark, "ant", version_ids=ids("2", "3")) == [(1, free[1]), (2, free[2])]
    assert len(asked(index, spark, "ant", paper_ids=F.array().cast("array<string>"))) == 3
    assert retrieval.conjunction([]) is None


def test_vector_search_ties_scopes_and_bad_vectors(spark):
    v = [("a", [1.0, 0.0], "p"), ("b", [2.0, 0.0], "p"), ("c", [0.0, 1.0], "q"), ("d", None, "q"), ("e", [0.0, 0.0], "q"), ("f", [1.0], "q"), ("g", [1.0, 1.0], "q")]
    vectors = spark.createDataFrame(v, "chunk_id string, embedding array<double>, paper_id string").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], ["q"]), (3, None, None)], "query_id long, embedding array<double>, paper_ids array<string>")
    got = retrieval.vector_search(q, vectors, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "a"), (1, "b"), (1, "g"), (2, "g"), (2, "c")]
    near = retrieval.vector_search(q.where("query_id = 1").drop("paper_ids"), vectors, 2, "squared").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in near] == [("a", 0.0), ("b", -1.0)]


def test_rerank_order_matches_and_fallback(spark):
    rows = [(1, c, p, q, o, t, r, ["z", "x", "y"], "comparison") for q, o in (("alpha beta", 1), ("gamma", 0)) for c, p, t, r in (("c1", "x", "alpha beta", 0.3), ("c2", "x", "gamma alpha", 0.2), ("c3", "y", "beta", 0.1), ("c4", "z", "none", 0.4), ("c5", "z", "alpha", 0.1))]
    found = spark.createDataFrame(rows, "query_id long, chunk_id string, paper_id string, query string, qord int, text string, rrf double, paper_ids array<string>, intent string")
    got = retrieval.rerank(found).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.matched) for r in got] == [("c5", 0.5, ["alpha beta"]), ("c1", 1.0, ["alpha beta"]), ("c3", 0.5, ["alpha beta"]), ("c2", 1.0, ["gamma", "alpha beta"])]
    broken = seams.model_score(lambda q, t: 1 / 0)
    back = retrieval.rerank(found, limit=2, scorer=broken).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.matched, r.degraded) for r in back] == [("c4", 0.4, [], True), ("c1", 0.3, [], True)]
    logits = seams.model_score(lambda q, t: [float(len(x)) - 5 for x in t])
    assert retrieval.rerank(found, scorer=logits).where("chunk_id = 'c1'").first().score == round(1 / (1 + math.exp(-5)), 9)


def test_forced_split_keeps_no_tail_within_the_overlap(spark):
    rows = spark.createDataFrame([(1, "0123456789" * 2 + "\U0001f600bcde"), (2, ""), (3, None), (4, "ab")], "id long, text string")
    got = chunking.forced_split(rows, 8, 0.25).orderBy("id", "part").collect()
    assert [r.piece for r in got] == ["01234567", "67890123", "23456789", "89\U0001f600bcde", "ab"]
    with pytest.raises(ValueError):
        tx.windows(F.lit("x"), 5, 5)
    wide = spark.range(1).select(tx.windows(F.lit("abcdefghij"), 7, 5).alias("w")).first().w
    assert wide == ["abcdefg", "cdefghi", "efghij", "ghij", "ij"]


class Words:
    def encode(self, text):
        return text.split()

    def decode(self, tokens):
        return " ".join(tokens)


def test_chunks_of_words(spark):
    b = lambda i, text, kind="text", section=("s",), quality=None, page=1, v="v": (v, i, page, list(section), kind, text, f"b{i}", quality)
    rows = [b(0, "T", "heading"), b(1, "a b", quality=0.5), b(2, "c d e", quality=1.0, page=2), b(3, "x y", "table"), b(4, "one two three four five six seven eight", page=3), b(5, "f", section=("t",)), b(6, "g h"), b(0, "z", v="w")]
    blocks = spark.createDataFrame(rows, "version_id string, position int, page_no int, section_path array<string>, kind string, text string, block_id string, quality double")
    settings = chunking.ChunkSettings(child_max=5, parent_max=9, overlap_ratio=0.2)
    got = chunking.build(blocks, settings, Words())
    kids = chunking.children(got).where("version_id = 'v'").orderBy("seq").collect()
    assert [(r.text, r.token_count, r.content_type, r.block_ids, r.quality_score, r.page_start, r.page_end) for r in kids] == [
        ("T\n\na b", 3, "text", ["b0", "b1"], 0.5, 1, 1), ("c d e", 3, "text", ["b2"], 1.0, 2, 2), ("x y", 2, "table", ["b3"], None, 1, 1), ("one two three four five", 5, "text", ["b4"], None, 3, 3), ("five six seven eight", 4, "text", ["b4"], None, 3, 3),
        ("f", 1, "text", ["b5"], None, 1, 1), ("g h", 2, "text", ["b6"], None, 1, 1),
    ]
    assert [(r.previous_id, r.next_id) for r in kids] == list(zip([None] + [r.chunk_id for r in kids][:-1], [r.chunk_id for r in kids][1:] + [None]))
    up = chunking.parents(got).where("version_id = 'v'").orderBy("seq").collect()
    assert [(r.text.replace("\n\n", "|"), r.block_ids) for r in up] == [("T|a b|c d e", ["b0", "b1", "b2"]), ("x y", ["b3"]), ("one two three four five|five six seven eight", ["b4"]), ("f", ["b5"]), ("g h", ["b6"])]
    assert up[0].quality_score == 0.75 and [k.parent_chunk_id for k in kids] == [up[i].chunk_id for i in (0, 0, 1, 2, 2, 3, 4)]
    assert chunking.block_links(got).where(F.col("chunk_id") == up[0].chunk_id).count() == 3
    assert chunking.build(blocks.limit(0)).count() == 0 and settings.parameters()["child_min"] == 300
    assert got.where("version_id = 'w'").count() == 2


def test_chunks_equal_a_plain_loop(spark):
    kids = [(i, "s" if i < 6 else "t", "table" if i == 3 else "text", "x" * (30 + 7 * i % 50)) for i in range(12)]
    rows = spark.createDataFrame([("v", i, 1, [s], k, t, str(i)) for i, s, k, t in kids], "version_id string, position int, page_no int, section_path array<string>, kind string, text string, block_id string")

    def add(out, kid):
        i, section, kind, text = kid
        fits = out and kind == out[-1][1] == "text" and out[-1][2] == section and len(out[-1][3]) + 2 + len(text) <= 120
        return [*out[:-1], ([*out[-1][0], str(i)], kind, section, f"{out[-1][3]}\n\n{text}")] if fits else [*out, ([str(i)], kind, section, text)]

    want = [(ids, kind, len(text)) for ids, kind, _, text in reduce(add, kids, [])]
    got = chunking.children(chunking.build(rows, chunking.ChunkSettings(child_max=120))).orderBy("seq").collect()
    assert [(r.block_ids, r.content_type, r.token_count) for r in got] == want


def test_quality_bounds_and_warnings(spark):
    def report(covered, total, blocks=1, headings=1, **more):
        page = dict(garbled=0.0, ocr_status="skipped", confidence=None) | more
        rows = [(1, i, i <= covered, page["garbled"], page["ocr_status"], page["confidence"]) for i in range(1, total + 1)]
        counts = spark.createDataFrame([(1, blocks, headings)], "version_id long, blocks long, headings long")
        return normalize.quality(spark.createDataFrame(rows, "version_id long, page_no int, covered boolean, garbled double, ocr_status string, confidence double"), counts).first()

    assert [report(n, 20).level for n in (20, 18, 17, 10, 9)] == ["ready", "ready", "partially_ready", "partially_ready", "failed"]
    assert report(4, 4, ocr_status="failed").warnings == ["OCR failed on PDF pages: 1, 2, 3, 4"] and report(4, 4, garbled=0.1).level == "ready"
    got = report(2, 4, headings=0, garbled=0.25, ocr_status="success", confidence=0.5)
    assert got.warnings == ["Missing text on PDF pages: 3, 4", "Garbled character ratio is high: 0.250", "OCR confidence is low: 0.500", "No section structure was detected"]


def test_budget_bounds():
    assert grounding.evidence_budget(16385, 0.5) == 8192
    for window, ratio in ((100, 0.3), (100, 0.7), (1, 0.5)):
        with pytest.raises(ValueError):
            grounding.evidence_budget(window, ratio)


def test_unanswered_part_outweighs_conflict_and_poor_evidence_does_not_count(spark):
    rows = spark.createDataFrame([(1, 1, "conflict", 0.9), (1, 2, None, 0.9), (2, 1, "conflict", None), (2, 2, "direct", 0.5), (3, 1, "direct", 0.4)], "question_id long, part int, level string, quality double")
    got = {r.question_id: (r.status, r.unanswered_items) for r in grounding.sufficiency(rows).collect()}
    assert got == {1: ("partially_answered", [2]), 2: ("conflicted", []), 3: ("insufficient_evidence", [1])}


def test_plan_subquestions(spark):
    rows = spark.createDataFrame([("one; two and also three", ["p1"], None), ("Ａ", ["p1"], None)], "question string, paper_ids array<string>, previous string")
    assert planner.plan(rows).first().subqueries == ["one; two and also three", "one", "two", "three"]


def test_margins_and_ocr(spark):
    items = spark.createDataFrame([("v", 1, 0, "page_header", "Top"), ("v", 2, 1, "page_footer", "top "), ("v", 1, 2, "text", "Top"), ("v", 2, 3, "page_footer", "once"), (None, 2, 3, "page_footer", "n")], "version_id string, page_no int, pos int, label string, text string")
    left = normalize.without_margins(items)
    assert sorted(r.text for r in left.collect()) == ["Top", "n", "once"]
    lines = spark.createDataFrame([("v", 1, 0, "T o p", 0.9, [(1.0, 2.0), (3.0, 0.5)]), ("v", 2, 0, "new line", 0.8, [(1.0, 2.0), (3.0, 0.5)])], "version_id string, page_no int, pos int, text string, confidence double, points array<struct<x:double,y:double>>")
    got = normalize.with_ocr(left, lines).where("source = 'rapidocr'").collect()
    assert [(r.page_no, r.pos, r.label, r.quality, tuple(r.bbox)) for r in got] == [(2, 1_000_000, "text", 0.8, (1.0, 0.5, 3.0, 2.0))]


def test_documents_from_items_pages_and_ocr(spark):
    items = spark.createDataFrame([("v", 1, 0, "title", " Intro\t"), ("v", 1, 1, "text", "\t "), ("v", 1, 2, "table", "t"), ("v", 1, 3, "text", "near"), ("v", 1, 4, "caption", "cap"), ("v", 2, 5, "section_header", "References"), ("v", 2, 6, "text", "r1"), ("v", 9, 7, "text", "lost")], "version_id string, page_no int, pos int, label string, text string")
    pages = spark.createDataFrame([("v", 1, 0.5), ("v", 2, 0.5)], "version_id string, page_no int, coverage double")
    ocr = spark.createDataFrame([("v", 1, "skipped", None), ("v", 2, "empty", None)], "version_id string, page_no int, status string, confidence double")
    rows, blocks = normalize.document(items, pages, ocr)
    got = blocks.orderBy("position").collect()
    assert [(r.position, r.kind, r.section_path, r.text) for r in got] == [(0, "heading", ["Intro"], "Intro"), (2, "table", ["Intro"], "t"), (3, "text", ["Intro"], "near"), (4, "caption", ["Intro"], "cap"), (5, "heading", ["References"], "References"), (6, "reference", ["References"], "r1")]
    assert got[1].related_ids == [got[3].block_id] and got[3].related_ids == [got[1].block_id] and got[2].related_ids == []
    assert [(r.page_no, r.ocr_used) for r in rows.orderBy("page_no").collect()] == [(1, False), (2, True)]
    assert got[0].next_id == got[1].block_id and got[-1].next_id is None
    with pytest.raises(ValueError):
        normalize.document(items, pages, ocr.withColumn("version_id", F.lit("other")))


def test_states_follow_quality(spark):
    versions = spark.createDataFrame([("v1", "p", "parsing"), ("v2", "p", "parsing")], "version_id string, paper_id string, parse_status string")
    papers = spark.createDataFrame([("p", "v1", "parsing", None), ("q", None, "pending", None)], "paper_id string, active_version_id string, status string, quality_level string")
    got = normalize.propagated(versions, papers, spark.createDataFrame([("v1", "ready")], "version_id string, level string"))
    assert {(r.version_id, r.parse_status) for r in got[0].collect()} == {("v1", "ready"), ("v2", "parsing")}
    assert {(r.paper_id, r.status, r.quality_level) for r in got[1].collect()} == {("p", "ready", "ready"), ("q", "pending", None)}


def test_text_expressions(spark):
    row = spark.range(1).select(
        tx.han_grams(F.lit("研究ab法")).alias("han"), F.round(normalize.garbled_share(F.lit("ab� c\x01")), 3).alias("bad"), tx.casefold(F.lit("Maß ﬁ ΑΣ µ İ")).alias("fold"), tx.squeezed(F.lit("　a\x85\t b ")).alias("squeezed"),
        tx.stripped(F.lit("  x y\x1c")).alias("stripped"), tx.redacted(F.lit("API-Key: k1, x Authorization = Bearer t2")).alias("safe"), F.round(tx.sigmoid(F.lit(0.0)), 3).alias("half"), tx.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("unit"), tx.unit(F.array(F.lit(0.0))).alias("zero"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.round(tx.backoff(n), 3)).alias("pauses"), tx.content_key(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert row.han == ["研", "究", "研究", "法"] and row.bad == 0.4 and row.fold == "Maß ﬁ ΑΣ µ İ".casefold() and row.squeezed == "a b" and row.stripped == "x y"
    assert row.safe == "API-Key: [REDACTED], x Authorization = Bearer [REDACTED]" and row.half == 0.5 and row.unit == [0.6, 0.8] and row.zero == [0.0]
    assert row.pauses == [0.05, 0.1, 0.2, 0.2, 0.2] and row.none is None


def test_boxes(spark):
    texts = ['{"l":1,"t":2,"r":3,"b":4}', '{"x0":1,"y0":2,"x1":3,"y1":4}', "[1,2,3,4]", "[1,2]", '{"l":1}', None, ""]
    got = spark.createDataFrame([(t,) for t in texts], "j string").select(tx.box_of(F.col("j")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(1, 2, 3, 4)] * 3 + [None] * 4


def test_seams(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "")], "id long, text string")
    got = {r.id: r.embedding for r in seams.hashed_embedding(16)(rows, "text").collect()}
    assert got[1] == got[2] != got[3] and math.isclose(sum(x * x for x in got[1]), 1, abs_tol=1e-5) and not any(got[4])
    own = seams.model_embedding(lambda texts: [[float(len(t)), 1.0] for t in texts], 2, batch=3)(rows, "text").orderBy("id").collect()
    assert [r.embedding for r in own] == [[10.0, 1.0], [10.0, 1.0], [5.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="3 numbers"):
        seams.model_embedding(lambda texts: [[1.0]] * len(texts), 3)(rows, "text").collect()
    replies = iter(["", "no json", '["list"]', '{"a": 1}'])
    assert seams.answered(lambda p: next(replies), "p", attempts=4) == '{"a": 1}'
    assert seams.answered(lambda p: 1 / 0 if p else "", "", attempts=2) is None and seams.answered(lambda p: "{}", "p", cancelled=lambda: True) is None
    told = seams.retried(lambda p: '{"p": "' + p + '"}')(rows.where("id = 3").withColumnRenamed("text", "prompt")).first()
    assert told.response == '{"p": "gamma"}'


def test_tools():
    assert agents.calculated("2 * (3 + 4) - -1") == 15 and agents.calculated("2**10") == 1024
    for bad in ("open('x')", "1 +", "9**9**9", "x", "[1]", "True"):
        with pytest.raises(ValueError):
            agents.calculated(bad)
    script = iter([{"content": "", "calls": [{"id": "1", "name": "calculator", "arguments": '{"expression": "6*7"}'}, {"id": "2", "name": "none"}]}, {"content": "42"}])
    got = agents.tool_loop(lambda messages: next(script), "how much")
    assert [m["role"] for m in got] == ["user", "assistant", "tool", "tool", "assistant"] and got[2]["content"] == "42" and got[3]["content"] == "unknown tool: none"
    assert len(agents.tool_loop(lambda m: {"calls": [{"name": "current_time"}]}, "x", most=3)) == 7


def test_structured_replies(spark):
    rows = spark.createDataFrame([('{"name": "n", "age": 3}',), ('{"name": "n"}',), ("no",), (None,), ('{"name": "n", "age": "x"}',)], "reply string")
    assert [r.value and tuple(r.value) for r in agents.structured(rows, "reply", "name string, age int").collect()] == [("n", 3), None, None, None, None]


def test_failures_and_chats(spark):
    rows = spark.createDataFrame([("OCR step", "OSError"), ("x", "sqlite3.Error"), ("x", "FileNotFoundError"), ("x", "RetrievalError"), ("x", "KeyError"), ("x", None)], "stage string, kind string")
    assert [r[0] for r in rows.select(lifecycle.failure_kind(F.col("stage"), F.col("kind"))).collect()] == ["ocr", "database", "filesystem", "vector_index", "unknown", "unknown"]
    chat = spark.createDataFrame([(c, t, "system" if not t else "user", f"m{t}") for c, n in ((1, 6), (2, 7)) for t in range(n)], "conv_id long, turn long, role string, text string")
    got = lifecycle.summarised(chat).orderBy("conv_id", "turn").collect()
    assert len([r for r in got if r.conv_id == 1]) == 6 and [(r.role, r.text) for r in got if r.conv_id == 2] == [("system", "m0"), ("assistant", "之前的对话摘要：m1\nm2\nm3\nm4\nm5\nm6")]
    assert [r.p for r in spark.createDataFrame([([],), (None,), (["a"] * 21,), (["a"],)], "f array<string>").select(lifecycle.batch_problem(F.col("f")).alias("p")).collect()] == ["empty", "empty", "too_many", None]


def test_blocks_and_chunks_move_their_texts_once(spark, monkeypatch):
    """where pages were too many to be sent to all, blocks moved to them, back by version, and again to their chunks."""
    rows = [(v, 1 + p // 3, p, ("title" if p == 0 else "text"), ("References" if v == 2 and p == 0 else f" t{v}-{p} ")) for v in range(1, 6) for p in range(9)] + [(6, None, 0, "text", "x"), (None, 1, 0, "text", "y"), (7, 1, 0, "title", " "), (7, 1, 1, "text", "z")]
    items = spark.createDataFrame(rows, "version_id long, page_no long, pos int, label string, text string")
    pages = spark.createDataFrame([(v, p) for v in (1, 2, 3, 7, None) for p in (1, 2)] * 2 + [(6, None)], "version_id long, page_no int")
    want = [(v, p, n, "reference" if v == 2 and n else "heading" if n == 0 and v < 7 else "text", t.strip()) for v, p, n, _, t in rows if v in (1, 2, 3, 7) and p in (1, 2) and t.strip()]
    names = ["version_id", "page_no", "position", "kind", "text"]
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        for parts in (None, 7):
            assert sorted(map(tuple, normalize.blocks(items, pages, parts).select(*names).collect())) == sorted(want)
        moved = chunking.build(normalize.blocks(items, pages, 4), parts=4)._jdf.queryExecution().executedPlan().toString()
        assert moved.count("Exchange hashpartitioning") == 2 and moved.count("REPARTITION_BY_NUM") == 1  # items, and the pages' numbers by version
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(work, "PART", 4)
    assert work.parts_for(items, "text") == -(-sum(len(r[4]) for r in rows) // 4)
