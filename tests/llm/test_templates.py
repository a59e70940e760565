"""Templates of benchmark items with other values, against a plain statement of what a leak is."""

import itertools
import random
import re

import numpy as np
import pytest

from folioscope.llm import decontamination as dc

QUESTIONS = [
    "{A} buys {x} red apples. {B} buys {y} green pears. {C} buys {z} ripe plums. How many fruits do they buy?",
    "{A} has {x} marbles and gives {y} of them to {B}. {B} already had {z} marbles. How many marbles does {B} have now?",
    "A train leaves {A} at {x} km per hour. {B} is {y} km away from the station. When will the train arrive there?",
    "{A} reads {x} pages every day. {B} reads twice as many pages as {A}. {C} reads {y} pages fewer than {B}. How many pages do the three friends read in a week?",
    "In the town of {A} there are {x} bakeries. {B} owns {y} of them. {C} wants to buy half of the rest. How many bakeries will {C} own?",
]
NAMES = "Alice Bob Carol Dora Evan Fred Gina Hugo Iris Jack Kate Liam Mona Nora Owen Pete Quinn Rita Sam Tina".split()


def filled(rng, question, names=NAMES):
    a, b, c = rng.sample(names, 3)
    x, y, z = rng.sample(range(3, 99), 3)
    return question.format(A=a, B=b, C=c, x=x, y=y, z=z)


@pytest.mark.parametrize("frame", ["{}", "Some words before it. {} And then some after.", "it was said that {} so it was"])
def test_other_names_and_numbers_are_found(frame):
    rng = random.Random(1)
    items = dc.prepare([(i, filled(rng, q)) for i, q in enumerate(QUESTIONS)])
    for i, q in enumerate(QUESTIONS):
        texts = [frame.format(filled(rng, q)) for _ in range(20)]
        assert {d for d, item, *_ in dc.matches(items, dc.Canon(), texts) if item == i} == set(range(20))


def test_slots_that_contradict_each_other_are_no_leak():
    question = "{A} walks to the old market and {B} walks to the new market because {A} wants to meet {B} there."
    items = dc.prepare([(1, question.format(A="Alice", B="Bob"))])
    fine, mixed = question.format(A="Dora", B="Evan"), "Dora walks to the old market and Evan walks to the new market because Evan wants to meet Fred there."
    same = question.format(A="Dora", B="Dora")
    assert [d for d, *_ in dc.matches(items, dc.Canon(), [fine, mixed, same])] == [0]


# what a leak is, said plainly: kinds of words, all alignments, all readings of capitals that begin a sentence


def words_of(text):
    out, start, number = [], True, False
    for raw in text.split():
        word = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        low = word.lower()
        if word:
            if low in dc.NUMBERS or re.fullmatch(r"\d+", low):
                kind = "number"
            elif low in dc.UNITS and number:
                kind = "unit"
            elif word[0].isupper():
                kind = "start" if start else "name"
            else:
                kind = "plain"
            out.append((low, kind))
        number = bool(word) and out[-1][1] == "number"
        start = raw[-1] in ".!?"
    return out


def alike(window, other):
    """Whether a window of an item and one of a text have a common template with enough plain words."""
    starts = [k for k, (_, kind) in enumerate(window) if kind == "start"]
    for ways in itertools.product([False, True], repeat=len(starts)):
        named = dict(zip(starts, ways))
        ok, plain = True, 0
        for k, ((w, kind), (v, other_kind)) in enumerate(zip(window, other)):
            as_name = named.get(k, kind == "name")
            shown = "name" if other_kind == "start" else other_kind
            own = "name" if as_name else "plain" if kind in ("plain", "start") else kind
            ok &= own == shown and (own != "plain" or w == v)
            plain += own == "plain"
        if ok and plain >= dc.LITERALS:
            return True
    return False


def brute(items, texts):
    found = set()
    for (d, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        own, other = words_of(item), words_of(text)
        size, covered, best = min(dc.WINDOW, len(own)), set(), 0
        for shift in range(-len(own), len(other)):
            at = [j for j in range(len(own) - size + 1) if 0 <= j + shift and j + shift + size <= len(other)]
            exact = {j for j in at if all(own[j + k][0] == other[j + shift + k][0] for k in range(size))}
            typed = {j for j in at if alike(own[j : j + size], other[j + shift : j + shift + size])}
            there, back, sound = {}, {}, True
            for j in sorted(typed - exact) + sorted(typed & exact):
                for k in range(j, j + size):
                    kind = "name" if own[k][1] == "start" else own[k][1]
                    if kind != "plain":
                        key, word = (kind, own[k][0]), other[k + shift][0]
                        sound &= there.setdefault(key, word) == word and back.setdefault((kind, word), key) == key
            on = {x for j in (typed | exact if sound else exact) for x in range(j, j + size)}
            covered |= on
            best = max(best, dc.longest(on))
        if covered and (best >= dc.RUN or len(covered) >= dc.enough(len(own))):
            found.add((d, i))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = "the old red house stands near a small river and two men walk home with dogs while rain falls".split()

    def sentence():
        own = rng.choices(vocabulary, k=rng.randint(4, 12))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice([rng.choice(NAMES), str(rng.randint(2, 50)), "The", "km"])
        own[0] = own[0].capitalize() if rng.random() < 0.8 else own[0]
        return " ".join(own) + rng.choice([".", "?", "", "!"])

    items = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(8)]
    texts = []
    for _ in range(40):
        own = rng.choice(items).split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(own))
            own[at] = rng.choice(NAMES) + "." * own[at].endswith(".") if own[at][0].isupper() else str(rng.randint(2, 50)) if own[at].isdigit() else own[at] if rng.random() < 0.6 else rng.choice(vocabulary)
        texts.append(" ".join([sentence() if rng.random() < 0.5 else "", *own, sentence() if rng.random() < 0.5 else ""]))
    got = {(d, i) for d, i, *_ in dc.matches(dc.prepare(list(enumerate(items))), dc.Canon(), texts)}
    assert got == brute(items, texts)


def test_blocks_are_taken_one_after_the_other(spark):
    rng = random.Random(9)
    items = [(i, filled(rng, QUESTIONS[i % 5]) + f" part{i} of a longer list of things") for i in range(40)]
    rows = [(i, filled(rng, QUESTIONS[i % 5]) if i % 2 else f"nothing to see here {i} at all") for i in range(60)] + [(100, None), (101, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    one, many = dc.without_leaks(docs, bench), dc.without_leaks(docs, bench, block_bytes=size // 5)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in many.collect())
    assert {r.doc_id for r in many.collect()} >= {100, 101, *range(0, 60, 2)}


def test_ends_of_words_are_kept_apart():
    items = dc.prepare([(1, "")])
    assert not items.windows and dc.matches(items, dc.Canon(), ["", None, "a b c"]) == []
    assert np.array_equal(dc.rolled(np.zeros(3, np.uint64), np.zeros(3, int), 8)[0], np.zeros(0, np.uint64))
