"""Splitters of text against their definitions, written out another way."""

import math
import random
import re

import pytest

from folioscope.operators import chunking, seams


def texts(seed, n=40):
    rng = random.Random(seed)
    marks = ["\n\n", "\n", "。", "！", "？", "；", "，", "、", " ", " ", " ", ". ", "! ", "? ", ", "]
    words = ["a", "bc", "def", "longerword", "句子", "文", "x" * 30, "Ünï"]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", " ", "。", "一句话说明。" * 3, "x" * 200, "\n\n\n"]


def recursive(text, size, overlap, separators):
    """The rule on strings: split with the separator kept at the start, merge what is short, go on with what is long."""
    mark = next((s for s in separators if s == "" or s in text), separators[-1])
    finer = separators[separators.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p for p in re.split(f"(?={re.escape(mark)})", text)] if len(mark) == 1 else [text.split(mark)[0], *[mark + p for p in text.split(mark)[1:]]]
    out, short = [], []

    def merge(parts):
        done, held = [], []
        for p in parts:
            if held and sum(map(len, held)) + len(p) > size:
                done.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held = held[1:]
            held = [*held, p]
        return done + (["".join(held)] if held else [])

    for p in [p for p in parts if p]:
        if len(p) < size:
            short.append(p)
            continue
        out, short = out + merge(short), []
        out += recursive(p, size, overlap, finer) if finer else [p]
    return out + merge(short)


@pytest.mark.parametrize(("size", "overlap"), [(12, 0), (12, 4), (40, 10), (500, 80)])
def test_recursive_splits_equal_the_rule(size, overlap):
    for text in texts(1):
        spans = chunking.split_recursively(text, size, overlap)
        assert [text[a:b] for a, b in spans] == (recursive(text, size, overlap, chunking.SEPARATORS) if text else [])
        assert all(b - a <= max(size, 2) for a, b in spans)
        covered = [False] * len(text)
        for a, b in spans:
            covered[a:b] = [True] * (b - a)
        assert all(covered)
        if not overlap:
            assert "".join(text[a:b] for a, b in spans) == text


def test_recursive_split_of_rows(spark):
    rows = spark.createDataFrame([(1, "一句话说明。" * 3), (2, None), (3, ""), (4, "  \n\n  "), (5, "ab " * 300)], "id long, text string")
    got = {}
    for r in chunking.recursive_split(rows, 12, 0).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert "".join(got[1]) == "一句话说明。" * 3 and set(got) == {1, 5} and " ".join(got[5]) == ("ab " * 300).strip()
    whole = chunking.recursive_split(rows, 12, 0, strip=False).where("id = 5").orderBy("part").collect()
    assert "".join(r.piece for r in whole) == "ab " * 300


def packed(sentences, width, overlap):
    """The fold over sentences that all fit, on their lengths."""
    chunks, first, i = [], 0, 0
    while i < len(sentences):
        if i > first and sum(map(len, sentences[first : i + 1])) > width:
            chunks.append("".join(sentences[first:i]).strip())
            keep = i
            while keep > first and sum(map(len, sentences[keep - 1 : i])) <= overlap and sum(map(len, sentences[keep - 1 : i + 1])) <= width:
                keep -= 1
            first = keep
        i += 1
    return [c for c in [*chunks, "".join(sentences[first:]).strip()] if c]


@pytest.mark.parametrize(("width", "overlap"), [(60, 0), (60, 25), (200, 80)])
def test_sentences_stay_whole(width, overlap):
    rng = random.Random(3)
    for _ in range(60):
        sentences = [" ".join("w" * rng.randint(1, 7) for _ in range(rng.randint(1, 6))) + rng.choice([". ", "! ", "? ", "。", ".\n\n", '." ']) for _ in range(rng.randint(1, 30))]
        assert chunking.sentence_pieces("".join(sentences), len, width, overlap) == packed(sentences, width, overlap)


def test_long_sentences_are_cut_finer():
    long = "one phrase, another phrase, " + "word " * 30 + "x" * 100 + " end."
    got = chunking.sentence_pieces(f"Short one. {long} Last one.", len, 40, 0)
    assert all(len(p) <= 40 for p in got) and got[0].startswith("Short one.")
    assert "".join("".join(got).split()) == "".join(f"Short one. {long} Last one.".split())
    for text in texts(2):
        assert "".join("".join(chunking.sentence_pieces(text, len, 30, 0)).split()) == "".join(text.split())
    assert chunking.sentence_pieces(" \n ", len) == []
    with pytest.raises(ValueError):
        chunking.sentence_pieces("a", len, 10, 10)


def test_sentence_windows_of_rows_and_tokenizers(spark):
    class Words:
        def encode(self, text):
            return text.split()

        def decode(self, tokens):
            return " ".join(tokens)

    rows = spark.createDataFrame([(1, "a b c. d e f. g h."), (2, None), (3, " ")], "id long, text string")
    got = chunking.sentence_windows(rows, Words(), 6, 2).orderBy("part").collect()
    assert [(r.id, r.part, r.piece) for r in got] == [(1, 0, "a b c. d e f."), (1, 1, "g h.")]


def test_semantic_splits_equal_the_rule(spark):
    rng = random.Random(4)
    topics = [["cat", "dog", "pet", "fur"], ["star", "moon", "sky", "orbit"], ["bread", "flour", "oven", "yeast"]]
    rows = [(i, " ".join(" ".join(rng.choices(topics[(k // 3) % 3], k=4)) + rng.choice([".", "?", "!"]) for k in range(rng.randint(1, 14)))) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "  "), (53, "alone"), (54, "--. ??. !!"), (0, "the same id. again. and again")]
    embed = seams.hashed_embedding(16)
    got = {}
    for r in chunking.semantic_split(spark.createDataFrame(rows, "id long, text string"), embed, 0.6).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.part, r.piece, r.sentences))
    sentences = {n: [s for s in re.split(r"(?<=[.?!])\s+", t or "") if s.strip()] for n, (_, t) in enumerate(rows)}
    near = [(n, k, " ".join(own[max(0, k - 1) : k + 2])) for n, own in sentences.items() for k in range(len(own))]
    vectors = {(r.n, r.k): r.embedding for r in embed(spark.createDataFrame(near, "n long, k long, text string"), "text").collect()}
    want = {}
    for n, (i, _) in enumerate(rows):
        own = [vectors[n, k] for k in range(len(sentences[n]))]
        far = []
        for a, b in zip(own, own[1:]):
            norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            far.append(round(1 - sum(x * y for x, y in zip(a, b)) / norm, 9) if norm else None)
        known = sorted(x for x in far if x is not None)
        limit = None
        if known:
            spot = 0.6 * (len(known) - 1)
            low = known[int(spot)]
            limit = low + (known[min(int(spot) + 1, len(known) - 1)] - low) * (spot - int(spot))
        groups = [[]]
        for k, s in enumerate(sentences[n]):
            if k and far[k - 1] is not None and far[k - 1] > limit:
                groups.append([])
            groups[-1].append(s)
        want.setdefault(i, []).extend((g, " ".join(own), len(own)) for g, own in enumerate(groups) if own)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}


def test_sentence_windows_give_their_pieces_by_and_by(spark, monkeypatch):
    monkeypatch.setattr(chunking, "_TEXTS", 2)
    rows = spark.createDataFrame([(f"d{i}", f"One {i}. Two {i}." if i % 3 else None) for i in range(7)], "id string, text string")
    made = chunking.sentence_windows(rows, seams.CodePoints(), 8, 1)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == sorted((f"d{i}", k, f"{w} {i}.") for i in range(7) if i % 3 for k, w in enumerate(("One", "Two")))


def test_neighbours_of_simple_sentences_are_added_up(spark):
    rng = random.Random(6)
    words = ["Straße", "x-1.b", "a1", "Émile", "don't", "_", "plain", "Haus"]
    rows = [(i, " ".join(" ".join(rng.choices(words, k=rng.randint(1, 5))) + "." for _ in range(rng.randint(1, 9)))) for i in range(150)] + [(200, "ﬁ x. 汉字 two. a."), (201, None), (202, "")]
    frame = spark.createDataFrame(rows, "id long, text string")
    embed = seams.hashed_embedding(16)
    plain = lambda some, text: embed(some, text)
    for around in (0, 1, 2):
        got, want = (sorted(map(tuple, chunking.semantic_split(frame, e, 0.7, around).collect())) for e in (embed, plain))
        assert got == want
    assert not hasattr(seams.hashed_embedding(16, "query: "), "near")


def test_sentences_are_tokenised_once(spark):
    """a sentence's words were found again for each of its neighbours, and its text moved twice."""
    rows = spark.createDataFrame([(1, "One two. Three. Four five.")], "id long, text string")
    made = chunking.semantic_split(rows, seams.hashed_embedding(16))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow added" in made and "collect_list" not in made
