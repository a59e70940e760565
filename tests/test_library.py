import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.operators import grounding, lifecycle, normalize, retrieval, seams
from folioscope.sources import readers
from folioscope.sources.sinks import IndexTable, KeywordStore, SettingsMismatch, VectorStore, simple_ids, write_json
from folioscope.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_facets_lead_and_a_shared_chunk_counts_once(spark):
    rows = [(1, 1, 10, "a"), (1, 2, 11, "a"), (1, 3, 10, "b"), (1, 4, 12, "b"), (1, 5, 13, None)]
    got = retrieval.spread_over_facets(spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, facet string"), 3).orderBy("place").collect()
    assert [(r.place, r.chunk_id) for r in got] == [(1, 10), (2, 12), (3, 11)]


def test_expansion_keeps_the_first_proposal(spark):
    seeds = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 99)], "question_id long, ord int, chunk_id long")
    chunks = spark.createDataFrame([(5, 50, None, 6, [8]), (6, 50, 5, 7, None)], "chunk_id long, parent_id long, previous_id long, next_id long, related array<long>")
    got = grounding.expanded(seeds, chunks).orderBy("ord", "step").collect()
    assert [(r.chunk_id, r.reason, r.seed) for r in got] == [(5, "reranked", 5), (50, "parent", 5), (6, "adjacent", 5), (8, "special_relation", 5), (7, "adjacent", 6), (99, "reranked", 99)]


def test_short_histories_stay_whole(spark):
    rows = spark.createDataFrame([(c, t, "user", f"m{t}") for c, n in ((1, 8), (2, 9)) for t in range(n)], "conv_id long, turn long, role string, text string")
    got = lifecycle.compressed(rows).orderBy("conv_id", "turn").collect()
    assert len([r for r in got if r.conv_id == 1]) == 8
    assert [r.text for r in got if r.conv_id == 2] == ["m0", "m1\nm2\nm3\nm4\nm5", "m6", "m7", "m8"]


def test_page_metrics_clip_boxes_and_stand_empty_pages(spark):
    rows = [(1, 1, -10.0, 0.0, 10.0, 10.0, "x" * 50, 100.0, 100.0), (1, 2, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0)]
    got = normalize.page_metrics(spark.createDataFrame(rows, "version_id long, page_no int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double")).orderBy("page_no").collect()
    assert [(r.chars, r.coverage, r.garbled, r.needs_ocr) for r in got] == [(50, 0.01, 0.0, False), (0, 0.0, 0.0, True)]


def test_index_upsert_delete_rebuild_and_guard(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "chunk_id string, paper_id string, version_id string, text string")
    path = f"file://{tmp_path}/index"
    index = IndexTable(spark, path, {"model": "m", "dimension": 3})
    assert index.read() is None
    index.upsert(rows(("a", "p", "v1", "x"), ("b", "q", "v2", "y"), ("c", None, None, "z")))
    index.upsert(rows(("a", "p", "v1", "new")))
    assert {(r.chunk_id, r.text) for r in index.read().collect()} == {("a", "new"), ("b", "y"), ("c", "z")}
    index.delete(papers=["q"])
    assert {r.chunk_id for r in IndexTable(spark, path, {"model": "m", "dimension": 3}).read().collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        index.delete()
    with pytest.raises(SettingsMismatch):
        IndexTable(spark, path, {"model": "other", "dimension": 3})
    index.rebuild(rows(("d", "p", "v3", "w")), {"model": "other", "dimension": 3})
    index.vacuum()
    assert [r.chunk_id for r in IndexTable(spark, path, {"model": "other", "dimension": 3}).read().collect()] == ["d"]
    assert len(list((tmp_path / "index").glob("generation-*"))) == 1


def test_json_artifacts(spark, tmp_path):
    for value in ({"a": 1}, {"a": "ü"}):
        write_json(spark, f"file://{tmp_path}", "report-1", value)
    assert json.loads((tmp_path / "report-1.json").read_text()) == {"a": "ü"} and not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        write_json(spark, f"file://{tmp_path}", "../x", {})


def test_cases_and_pictures(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"id": "A1", "fixture": "f", "question": "q", "scope": ["p"], "evidence": [], "layer": "l"}]')
    assert readers.cases(spark, str(tmp_path / "c.json")).first().scope == ["p"]
    got = readers.parsed_items(spark.createDataFrame([("v", '{"pictures":[{"prov":[{"page_no":3}]}]}')], "version_id string, json string")).collect()
    assert [(r.label, r.text, r.page_no) for r in got] == [("picture", None, 3)]


def test_changes_rewrite_the_buckets_they_touch(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 5).cast("string").alias("paper_id"), F.lit("v").alias("version_id"), F.lit("x").alias("text"))
    index = IndexTable(spark, f"file://{tmp_path}/t", {}, buckets=8)
    index.upsert(rows)
    before = index.pointer()["places"]
    index.upsert(rows.where("chunk_id = '7'").withColumn("text", F.lit("new")).withColumn("extra", F.lit(1)))
    after = index.pointer()["places"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert index.read().count() == 200 and [r.chunk_id for r in index.read().where("text = 'new' and extra = 1").collect()] == ["7"]
    index.delete(papers=[str(i) for i in range(5)])
    assert index.read() is None
    index.vacuum()


def test_stores_embed_and_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "v1", "red fox"), ("b", "q", "v2", "blue whale")], "chunk_id string, paper_id string, version_id string, text string")
    more = spark.createDataFrame([("c", "p", "v3", "red whale")], rows.schema)
    asked = spark.createDataFrame([(1, "red whale")], "query_id long, text string")
    vector = VectorStore(spark, f"file://{tmp_path}/v", {"model": "m", "dimension": 32}, seams.hashed_embedding(32))
    keyword = KeywordStore(spark, f"file://{tmp_path}/k", {"version": 1})
    for store in (vector, keyword):
        with pytest.raises(ValueError):
            store.search(asked)
        store.upsert(rows)
        store.upsert(more)
        assert store.search(asked).orderBy("rank").first().chunk_id == "c"
        store.delete(versions=["v3"])
        assert {r.chunk_id for r in store.search(asked).collect()} == {"a", "b"}
        store.rebuild(more)
        assert [r.chunk_id for r in store.search(asked).collect()] == ["c"]
    with pytest.raises(Exception, match="bad vector"):
        VectorStore(spark, f"file://{tmp_path}/w", {"dimension": 3}, seams.hashed_embedding(4)).upsert(rows)
    assert [r[0] for r in spark.range(2).select(simple_ids(F.col("id"))).collect()] == ["doc_0", "doc_1"]


def files(spark, tmp_path, **contents):
    (tmp_path / "in").mkdir()
    for name, data in contents.items():
        (tmp_path / "in" / name.replace("_", ".")).write_bytes(data)
    return str(tmp_path / "in")


def test_uploads_tell_their_problems(spark, tmp_path):
    path = files(spark, tmp_path, a_pdf=b"%PDF-1", b_PDF=b"%PDF-1", c_pdf=b"no", d_txt=b"%PDF-2", e_pdf=b"", f_pdf=b"%PDF-" + b"x" * 99, g_pdf=b"%PDF-3", h_pdf=b"%PDF-4")
    kinds = spark.createDataFrame([(f"file:{path}/g.pdf", "text/html"), (f"file:{path}/a.pdf", "application/pdf")], "path string, content_type string")
    known = readers.pdf_uploads(spark, path, 50).where("title = 'h'").select("sha256")
    got = {r.path.rsplit("/", 1)[1]: (r.problem, r.duplicate) for r in readers.pdf_uploads(spark, path, 50, known, kinds).collect()}
    first = ["a.pdf", "b.PDF"]
    assert {got.pop(x) for x in first} == {(None, False), (None, True)}
    assert got == {"c.pdf": ("no_pdf_header", False), "d.txt": ("not_a_pdf_name", False), "f.pdf": ("too_large", False), "g.pdf": ("wrong_type", False), "h.pdf": (None, True)}
    assert readers.pdf_files(spark, path, 50, known).count() == 2


def read_pages(content):
    if content.endswith(b"!"):
        raise ValueError("encrypted")
    return [{"width": 100, "height": 100, "boxes": [(0, 0, 50, 50, t.decode())]} for t in content[5:].split(b"|") if t] if b"|" in content else []


def test_preflight_images_and_page_documents(spark, tmp_path):
    path = files(spark, tmp_path, a_pdf=b"%PDF-one|two", b_pdf=b"%PDF-!", c_pdf=b"x", d_pdf=b"%PDF-")
    rows = spark.read.format("binaryFile").load(path)
    got = readers.preflight(rows, read_pages)
    assert sorted((r.path[-5:], r.page_no, r.text) for r in got.where("error is null").collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert {(r.path[-5:], r.error) for r in got.where("error is not null").collect()} == {("b.pdf", "ValueError: encrypted"), ("c.pdf", "not a PDF"), ("d.pdf", "no pages")}
    pages = got.where("error is null").select("path", "page_no")
    images = readers.page_images(rows, pages, lambda content, page, dpi: f"{page}@{dpi}".encode() if page == 1 else 1 / 0).orderBy("page_no").collect()
    assert [(bytes(r.image) if r.image else None, r.error) for r in images] == [(b"1@200", None), (None, "ZeroDivisionError: division by zero")]
    assert [(r.text, r.page, r.page_label, r.file_type) for r in readers.pdf_pages(rows, read_pages).orderBy("page").collect()] == [("one", 0, 1, "pdf"), ("two", 1, 2, "pdf")]
    done = readers.converted(rows, lambda content: ("partial_success", "{}", None) if b"|" in content else 1 / 0)
    assert readers.accepted(done).count() == 1 and done.where("status = 'failure'").count() == 3


def engine(image):
    if image == b"bad":
        raise RuntimeError("dark")
    return [(t, c, [(0, 0), (2, 3)]) for t, c in ((image.decode(), 0.5),)] if image else []


def test_ocr_goes_on_after_failures(spark):
    pages = spark.createDataFrame([("v", 1, False, None), ("v", 2, True, bytearray(b"word")), ("v", 3, True, bytearray(b"bad")), ("v", 4, True, bytearray(b""))], "version_id string, page_no int, needs_ocr boolean, image binary")
    got = readers.ocr(pages, engine).orderBy("page_no")
    assert [(r.status, r.source, len(r.lines), r.confidence, r.low_confidence, r.error) for r in got.collect()] == [
        ("skipped", "native_text", 0, None, False, None), ("success", "rapidocr", 1, 0.5, True, None), ("failed", "rapidocr", 0, None, True, "RuntimeError: dark"), ("empty", "rapidocr", 0, None, True, None),
    ]
    line = readers.ocr_lines(got).first()
    assert (line.page_no, line.pos, line.text, line.points[1].y) == (2, 0, "word", 3.0)


def test_text_and_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("# T\nx")
    (tmp_path / "b.txt").write_text("plain\ntext")
    assert [(r.text, r.file_type, r.source[-4:]) for r in readers.markdown_files(spark, str(tmp_path)).collect()] == [("# T\nx", "markdown", "a.md")]
    assert {r.text for r in readers.text_files(spark, str(tmp_path)).collect()} == {"# T\nx", "plain\ntext"}
    assert readers.by_key(readers.text_files(spark, str(tmp_path)), "text", ["plain\ntext"]).count() == 1


def test_parser_items(spark):
    json_ = '{"texts":[{"label":"title","text":"T","prov":[{"page_no":2}]},{"label":"text","text":"x"},{"text":"own","page_no":4}],"tables":[{"label":"formula","text":"given","data":{"table_cells":[{"text":"a"}]},"prov":[]}]}'
    got = readers.parsed_items(spark.createDataFrame([("v", json_)], "version_id string, json string")).orderBy("pos").collect()
    assert [(r.label, r.text, r.page_no) for r in got] == [("title", "T", 2), ("text", "x", 1), ("text", "own", 4), ("formula", "given", 1)]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, i, f"2024-01-01 00:00:{i:02d}", "s%d" % i) for i in range(9)], "task_id long, event_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("event_id < 5").write.parquet(source)
    for _ in range(2):
        ingest.append_new(spark, source, events.schema, target, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == 5
    events.where("event_id >= 5").write.mode("append").parquet(source)
    ingest.append_new(spark, source, events.schema, target, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == 9
    stream = spark.readStream.schema(events.schema).parquet(source)
    index = IndexTable(spark, f"file://{tmp_path}/index", {})
    ingest.upsert_new(stream.select(F.col("task_id").cast("string").alias("chunk_id"), "event_id"), index, str(tmp_path / "c2")).awaitTermination()
    assert index.read().count() == 3
    states = ingest.task_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    states.awaitTermination()
    assert {(r.task_id, r.state, r.events) for r in spark.table("states").collect()} == {(0, "s6", 3), (1, "s7", 3), (2, "s8", 3)}


def test_an_analysis_of_customer_0_is_queued_beside_order_0(spark, tmp_path):
    from folioscope.plans.queries import QUERIES

    spark.createDataFrame([(0,), (1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(0, 7), (5, 2), (6, 1), (4, 0)]  # order 6 runs the analysis that customer 1 wants not, order 5 that of customer 2 not: their operations differ
    orders += [(11, 1)]  # order 11 runs what customer 1 wants
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr("*", "timestamp'1995-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["submitted_analyses"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(-1, 11), (-2, None), (0, None)]


def test_new_tasks_look_at_all_tasks_once(spark):
    tasks = spark.createDataFrame([(1, 7, "failed", 2), (2, 8, "queued", 1), (3, 7, "succeeded", 4)], "task_id long, version_id long, status string, attempt int")
    wanted = spark.createDataFrame([(-1, 7), (-2, 8), (-3, 9), (-4, 9), (-5, 10), (-6, None), (-7, None)], "task_id long, version_id long")
    made, conflicts = lifecycle.created_tasks(tasks, wanted, F.current_timestamp())
    assert sorted(r.version_id for r in conflicts.collect()) == [8, 9]
    assert sorted(tuple(r)[:4] for r in made.where("task_id < 0").collect()) == [(-7, None, "queued", 1), (-6, None, "queued", 1), (-5, 10, "queued", 1), (-1, 7, "queued", 5)]
    assert made.where("task_id < 0")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
