"""Vector codes: against full Lloyd rounds, and what the heaps save."""

import hashlib

import numpy as np
import pytest

from folioscope.llm import vector_codes as vc


def full_lloyd(x, labels, parts=16, entries=64, rounds=2):
    """Every part scanned in every round. x: whole numbers, rows in the order of their ids."""
    cut = x.shape[1] // parts
    books = [x[:entries, p * cut : (p + 1) * cut].copy() for p in range(parts)]

    def near(p):
        off = x[:, None, p * cut : (p + 1) * cut] - books[p][None]
        d = (off * off).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            own = near(p)[0]
            for e in np.unique(own):
                some = x[own == e, p * cut : (p + 1) * cut]
                books[p][e] = some.sum(0) // len(some)
    found = [near(p) for p in range(parts)]
    error = sum(d for _, d in found)
    codes = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(x))]
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    sums = {k: int(sum(e for e, m in zip(error, labels) if m == k)) for k in set(labels)}
    return codes, error.tolist(), [sums[k] for k in labels], sha


def run(spark, rows, ddl="vec_id long, embedding array<float>, label int", **more):
    coded, books = vc.compress(spark.createDataFrame(rows, ddl), **more)
    return {r.vec_id: r for r in vc.with_label_errors(coded).collect()}, vc.digest(books)


def test_equals_full_lloyd_with_copies_and_a_hot_label(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 32)), 2)
    x[200:430] = x[7]  # a third of all rows are one vector
    labels = [None if i % 11 == 0 else 5 if i % 3 else i % 4 for i in range(700)]
    got, sha = run(spark, [(i * 3, x[i].astype(np.float32).tolist(), labels[i]) for i in range(700)])
    codes, errors, sums, want = full_lloyd(np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64), labels)
    assert sha == want
    assert [(got[i * 3].code, got[i * 3].error, got[i * 3].label_error) for i in range(700)] == list(zip(codes, errors, sums))


def test_edges(spark):
    good = [0.5, -0.25, 1.0, 0.0] * 8
    rows = [
        (1, good, 1), (1, good, 1), (2, None, 1), (3, [], 1), (4, [None] + good[1:], 1), (5, [float("nan")] + good[1:], 1),
        (6, [float("inf")] + good[1:], 2), (7, good[:5], 2), (None, [0.0] * 32, None), (9, [-1e30] * 32, 2),
    ]
    coded, books = vc.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = vc.with_label_errors(coded).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 9), (True, 0)]
    assert all(r.error == 0 and r.label_error == 0 for r in got)  # fewer rows than entries: each is its own entry
    assert {r.code for r in got if r.vec_id == 1} == {"00" * 16}
    empty, none = vc.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label string, own_0 int"))
    assert vc.with_label_errors(empty).count() == 0 and none.shape[1] == 0


def test_labels_of_names_and_no_label(spark):
    rows = [(i, [float(i % 7), 1.0], name) for i, name in enumerate(["a", None, "b"] * 5)]
    got, _ = run(spark, rows, "vec_id long, embedding array<double>, label string", parts=2, entries=3)
    for name in ("a", None, "b"):
        own = [r for r in got.values() if r.label == name]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}
    alone, _ = run(spark, [(i, [float(i)], None) for i in range(9)], parts=1, entries=2)
    assert {r.label_error for r in alone.values()} == {sum(r.error for r in alone.values())}


@pytest.mark.parametrize("seed", [1, 2])
def test_heaps_pop_only_what_drift_has_reached(seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-2000, 2000, (8, 4))
    x = centers[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 4))
    books = centers[None].astype(np.int64)
    codes, keys, rows = vc.first_round(x, books)
    drift = np.zeros((1, 8))
    for _ in range(3):
        new = np.stack([x[codes[0] == e].sum(0) // (codes[0] == e).sum() for e in range(8)])[None]
        way = np.sqrt(((new - books) ** 2).sum(2))
        drift, books = drift + way + way.max(), new
        scanned = vc.next_round(x, books, drift, codes, keys, rows)
        off = x[:, None] - books[0][None]
        assert (codes[0] == (off * off).sum(2).argmin(1)).all()
        assert scanned < 300  # a tenth at most of well separated parts


def test_ties_are_scanned_again():
    x = np.array([[0], [2], [1], [1]])
    books = np.array([[[0], [2]]])
    codes, keys, rows = vc.first_round(x, books)
    assert codes[0].tolist() == [0, 1, 0, 0]
    assert vc.next_round(x, books, np.zeros((1, 2)), codes, keys, rows) == 2  # both ties, no more
    assert codes[0].tolist() == [0, 1, 0, 0]


def test_wide_numbers_stay_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 27), 1 << 27, (200, 4))
    book = rng.integers(-(1 << 27), 1 << 27, (16, 4))
    own, slack = vc.scan(x, book)
    exact = [min(range(16), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(r, book[e])), e)) for r in x]
    assert own.tolist() == exact and (slack > 0).any()
