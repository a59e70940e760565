"""The registered queries against the libraries, SQL or brute force, on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import queries, simhash
from tests.sql_check import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_op1_recall(spark):
    got = queries.op1_ann(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[asked].tolist())
    hits = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(found[ids[i]] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hits / (20 * len(asked)) >= 0.9
    assert (got.groupby("query_id").size() == 20).all()


def test_op3_accuracy(spark, docs):
    got = [r for r in queries.op3_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.98


def test_op4_accuracy(spark):
    got = {r.doc_id: r for r in queries.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_op5_equals_the_library(spark, docs):
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op5_token_counts(spark, SF).collect():
        text = docs[r.doc_id].text or ""
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(m.encode(text)), len(text.encode()), r.n_tokens > 4096)


def test_op6_finds_whole_items(spark, docs):
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {(d, b.item_id) for d, r in docs.items() for b in items if b.text in r.text} == got


def test_op7_equals_the_library(spark, docs):
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in queries.op7_token_files(spark, SF).orderBy("doc_id").collect():
        ids = t.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op9_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op9_simhash(spark, SF).collect()}
    prints = {d: simhash.fingerprint(r.text, 4) & (1 << 64) - 1 for d, r in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(got[d].fingerprint == f"{prints[d]:016x}" and got[d].component_id == find(d) for d in ids)


def packs_are_sound(rows, docs, t):
    for d, own in rows.groupby("doc_id"):
        ids = t.encode(docs[d].text or "", add_special_tokens=False).ids + [1]
        own = own.sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert (own.start == own.length.cumsum() - own.length).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(own.start, own.length)]
    rows = rows.sort_values(["sequence_id", "offset"])
    fill = rows.groupby("sequence_id").length
    assert (rows.offset == fill.cumsum() - rows.length).all() and fill.sum().max() <= 2048
    return fill.sum().sum() / (2048 * rows.sequence_id.nunique())


def test_op10_packs(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packs_are_sound(queries.op10_packing(spark, SF).toPandas(), docs, t) > 0.95


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
    assert 0 < docs.count() < before
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
