"""Ranked lexical search: against a scan of all documents in plain Python."""

import math
import random
import re

import pyarrow as pa
import pytest

from folioscope.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    rows = [(d, words(t)) for d, t in docs]
    rows = [(d, w) for d, w in rows if w]
    count, length = len(rows), sum(len(w) for _, w in rows)
    out = []
    for item, text in items:
        scored = []
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t in set(words(text)) if (n := sum(t in w for _, w in rows))}
        for d, w in rows:
            m = 100 - 50 + (50 * len(w) * count) // length
            total = sum(x * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t, x in weight.items() if t in w)
            if total > 0:
                scored.append((-total, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=50, **more):
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), **more)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k)
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Der", "ünï", "漢字", "x9", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 10, 60, 400])))) for i in range(n)]


@pytest.mark.parametrize("block", [200, 4 << 20])
def test_equals_a_scan(spark, block):
    docs = corpus(1, 300) + [(1000 + i, "w1 w2 der w5 w5") for i in range(100)]  # a quarter are copies: ties beyond k
    items = corpus(2, 12) + [(50, "w1 W1 w2"), (51, "nowhere"), (52, "漢字 Ünï ünï")]
    assert found(spark, docs, items, k=20, block_bytes=block) == brute(docs, items, 20)


def test_items_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ASKED", 10)
    docs, items = corpus(3, 120), corpus(4, 20)
    assert found(spark, docs, items, k=5, block_bytes=500) == brute(docs, items, 5)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha"), (6, "ALPHA\x00beta-gamma"), (7, "x" * 300_000 + " alpha")]
    items = [(1, "Alpha"), (1, "Alpha"), (2, None), (3, ""), (None, "gamma beta")]
    assert found(spark, docs, items) == brute(docs, items, 50)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, " ")], items) == []
    assert found(spark, docs, [(1, "zeta")]) == []


def test_other_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 7), (2, "b c", 5, 7)], "doc_id long, text string, block int, q long")
    items = spark.createDataFrame([(9, "b", 3, "x")], "item_id long, text string, g int, term string")
    got = lexical.search(lexical.build(docs), items).collect()
    assert [(r["rank"], r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [t[1:] for t in brute([(1, "a b"), (2, "b c")], [(9, "b")], 50)]


def test_terms_equal_the_pattern():
    texts = ["Ab-cd éÀ", None, "", "x", "y z\x7f1", " nbsp", "end"]
    flat, n = lexical.terms_of(pa.array(texts))
    assert flat.to_pylist() == [w for t in texts for w in words(t)] and n.tolist() == [len(words(t)) for t in texts]
    flat, n = lexical.terms_of(pa.array(texts).slice(3, 3))
    assert flat.to_pylist() == [w for t in texts[3:6] for w in words(t)] and n.tolist() == [1, 3, 1]


def test_bounds_hold_every_score():
    import numpy as np

    tf, n = np.meshgrid(np.array([1, 2, 3, 50, 10_000]), np.array([1, 5, 300, 10**6]))
    share = lexical.part(tf, n, 1000, 200_000)
    impact = -(-share // lexical.STEP)
    assert impact.max() <= 255 and (impact * lexical.STEP >= share).all() and (impact * lexical.STEP - (lexical.STEP - 1) <= share).all()
