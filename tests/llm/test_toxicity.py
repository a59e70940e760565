"""Toxicity: the kernel by enumeration, sentences, planted insults in every disguise, held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import queries, string_kernel as sk, toxicity

SF = "/root/testdata/sf0.01"


def enumerated(s, t):
    def subsequences(word):
        out = {}
        for n in range(1, sk.ORDER + 1):
            for at in itertools.combinations([i for i, c in enumerate(word) if c.isalnum()], n):
                weight = np.prod([sk.GAP if word[i].isalnum() else sk.SOFT for i in range(at[0], at[-1]) if i not in at])
                key = "".join(word[i] for i in at)
                out[key] = out.get(key, 0) + weight
        return out

    a, b = subsequences(s), subsequences(t)
    return sum(sk.WEIGHTS[len(k) - 1] * v * b.get(k, 0) for k, v in a.items())


def test_kernel_equals_enumeration():
    words = ["idiot", "i-d-i-o-t", "idxiot", "aabbab", "m*r_n", "ñandú", "x", "aaaaaaaaaaaaaaaa", "zz--zz", "漢字漢", "q1w2e3r4t5y6u7i8"]
    marks = sk.Landmarks(["idiot", "abab", "漢字", "m-r"])
    got = marks.features(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks.words):
            assert got[i, j] == pytest.approx(enumerated(w, m) / np.sqrt(enumerated(w, w) * enumerated(m, m)), abs=1e-5)
    assert (marks.features(["", "--"]) == 0).all()
    some = np.random.default_rng(1).normal(size=(4, 3))
    assert np.allclose(marks.compared(words, some), got @ some, atol=1e-5)


def test_words_and_sentences():
    words, place, sentence, doc = toxicity.units(pa.array(["One two. Three!\nfour", None, "", "you i d i o t", "a.b c"]))
    shown = [(words[p], int(s)) for p, s in zip(place, sentence)]
    assert shown[:4] == [("one", 0), ("two", 0), ("three", 1), ("four", 2)]
    assert ("i d i o t", 5) in shown and ("a.b", 6) in shown
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 4]


def planted(seed, n):
    """Invented words; toxic texts hold three of six insults, which stand nowhere else."""
    rng = random.Random(seed)
    insults = ["blorgat", "snivenk", "drupplo", "gazmirk", "frenzub", "wattock"]
    syllables = ["ta", "ne", "ri", "so", "lu", "ma", "ke", "po"]
    texts, labels = [], []
    for i in range(n):
        own = ["".join(rng.choices(syllables, k=rng.choice([1, 2, 3, 4]))) for _ in range(rng.choice([12, 40, 120]))]
        toxic = i % 5 == 0
        for w in rng.sample(insults, 3) if toxic else []:
            own.insert(rng.randrange(len(own)), w)
        texts.append(" ".join(own) + ".")
        labels.append(int(toxic))
    return texts, np.array(labels), insults


def scored(machine, texts):
    words, place, sentence, doc = toxicity.units(pa.array(texts))
    margin = machine.margins(words)
    return machine.probability(machine.evidence(margin[place], doc[sentence], len(texts)))


def test_insults_in_disguise():
    texts, labels, insults = planted(1, 400)
    machine = toxicity.fit(texts, labels)
    fresh, wanted, _ = planted(2, 200)
    assert ((scored(machine, fresh) >= 0.3) == wanted).all()
    base = "tane riso luma kepo tariso nelu {} poke masolu tane {} riso keluma {} sota."
    for disguise in ("-".join, " ".join, ".".join, lambda w: w[:3] + "*" + w[3:], lambda w: w[:4] + "x" + w[4:], str.upper, lambda w: f"({w}!)"):
        p = scored(machine, [base.format(*map(disguise, three)) for three in itertools.combinations(insults, 3)])
        assert (p >= 0.3).all()
    assert (scored(machine, [base.format("tata", "soso", "riri")]) < 0.3).all()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in labels]) > 0.93


def test_edges(spark):
    texts, labels, _ = planted(3, 120)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(500, None, 0), (501, "", 0), (None, "blorgat", 0), (0, texts[0], 0)], "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)] + [(None, 1), (500, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, marks)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == 124
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and {r.predicted for r in got if r.doc_id in (500, 501)} == {0}
    lines = "tane riso.\nluma blorgat snivenk drupplo.\ntane."
    row = toxicity.score(spark.createDataFrame([(1, lines)], "doc_id long, text string"), machine).first()
    assert (row.predicted, row.sentence) == (1, 1)
    long = "tane riso. " * 40_000 + "wattock"
    assert toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), machine).first().sentence == 40_000
    assert toxicity.score(docs.limit(0), machine).count() == 0
    none = toxicity.learn(docs, marks.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs.limit(0), marks)).collect()} == {0}


def test_ties_give_the_first_sentence(spark):
    texts, labels, _ = planted(4, 120)
    machine = toxicity.fit(texts, labels)
    row = toxicity.score(spark.createDataFrame([(1, "blorgat.\nblorgat.\ntane")], "doc_id long, text string"), machine).first()
    assert row.sentence == 0
