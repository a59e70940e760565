"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are bins of plain measures (words, characters of each
class, repetition, ends) of the line itself and of the lines before and after it; neighbouring
labels are tied by transition weights. Forward-backward gives each line's marginal, and a document's
quality is the mean of its lines' marginals for good, weighted by their lengths.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import labelled_texts, ship, sliced, tidy

ROUNDS, RATE, DECAY = 120, 0.1, 1e-3
#: Characters that count as the punctuation of sentences.
PUNCTUATION = ".,;:!?'\"()-–—’‘“”„«»¿¡…"
SPACE, UPPER, LETTER, DIGIT, POINT, SYMBOL = range(6)
#: Upper ends of the bins of each measure.
BINS = {
    "words": [0.5, 1.5, 2.5, 5.5, 10.5, 20.5, 50.5],
    "word_length": [1.5, 3, 4, 5, 6, 7.5, 10, 20],
    "upper": [0.001, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9],
    "digits": [0.001, 0.02, 0.1, 0.3, 0.6],
    "symbols": [0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4],
    "points": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3],
    "distinct": [0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.97],
    "marked": [0.001, 0.1, 0.25, 0.5, 0.75],  # symbols and points a word
    "stop": [0.5],
    "start": [0.5],
    "same": [0.5],
}
_SIZES = [len(x) + 1 for x in BINS.values()]
_FIRST = np.concatenate(([0], np.cumsum(_SIZES)[:-1]))
_PER_LINE = int(sum(_SIZES))
FEATURES = 3 * _PER_LINE + 3  # before, itself, after; no line before, no line after, always
_MEASURES = len(BINS)


def _classes() -> np.ndarray:
    table = np.full(1 << 16, SYMBOL, np.uint8)
    for code in range(1 << 16):
        kind = unicodedata.category(chr(code))
        if kind[0] == "Z" or kind == "Cc":
            table[code] = SPACE
        elif kind in ("Lu", "Lt"):
            table[code] = UPPER
        elif kind[0] in "LM":
            table[code] = LETTER
        elif kind[0] == "N":
            table[code] = DIGIT
    table[[ord(c) for c in PUNCTUATION]] = POINT
    return table


_TABLE: list[np.ndarray] = []


def measures(lines: list[str], new: np.ndarray) -> np.ndarray:
    """Lines x measures. ``new`` marks the first line of each text."""
    if not _TABLE:
        _TABLE.append(_classes())
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), "<u4")
    line = np.cumsum(codes == 10)
    line -= codes == 10  # a break counts to the line before it, as space
    kind = _TABLE[0][np.minimum(codes, 0xFFFF)]
    kind = np.where(codes > 0xFFFF, np.where((codes >= 0x20000) & (codes < 0x40000), LETTER, SYMBOL), kind)
    counts = np.bincount(line * 6 + kind, minlength=6 * len(lines)).reshape(-1, 6).astype(np.float64)
    words, distinct = np.empty(len(lines)), np.empty(len(lines))
    stop, start, same = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    before = None
    for i, x in enumerate(lines):
        own = x.split()
        words[i], distinct[i] = len(own), len(set(own))
        if own:
            stop[i], start[i] = own[-1][-1] in ".!?…", own[0][0].isupper()
            same[i] = x == before and not new[i]
        before = x
    black = np.maximum(1, counts[:, UPPER:].sum(1))
    letters = counts[:, UPPER] + counts[:, LETTER]
    some = np.maximum(1, words)
    return np.stack(
        [
            words, counts[:, UPPER:].sum(1) / some, counts[:, UPPER] / np.maximum(1, letters), counts[:, DIGIT] / black, counts[:, SYMBOL] / black,
            counts[:, POINT] / black, np.where(words > 0, distinct / some, 1), (counts[:, SYMBOL] + counts[:, POINT]) / some, stop, start, same,
        ], 1,
    )


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of every line (lines x active features), lines of each text, and line lengths."""
    split = [(t or "").split("\n") for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    lines = [x for own in split for x in own]
    new = np.zeros(len(lines), bool)
    new[np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)] = True
    last = np.append(new[1:], True)
    m = measures(lines, new)
    own = np.stack([_FIRST[i] + np.searchsorted(b, m[:, i], side="right") for i, b in enumerate(BINS.values())], 1)
    none = FEATURES  # a place whose weight stays zero
    before = np.where(new[:, None], none, np.roll(own, 1, 0) + _PER_LINE)
    after = np.where(last[:, None], none, np.roll(own, -1, 0) + 2 * _PER_LINE)
    edges = np.stack([np.where(new, 3 * _PER_LINE, none), np.where(last, 3 * _PER_LINE + 1, none), np.full(len(lines), 3 * _PER_LINE + 2)], 1)
    return np.concatenate([own, before, after, edges], 1), sizes, np.array([len(x) for x in lines], np.float64)


@dataclass
class LineField:
    """weights: what each feature adds to good over bad (one more, zero, for no feature); ties: what keeping good, keeping bad adds."""

    weights: np.ndarray
    ties: np.ndarray

    def marginals(self, active: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(good) of every line, by forward-backward over all texts side by side."""
        return _chains(self.weights[active].sum(1), self.ties, sizes)[0]


def _chains(score: np.ndarray, ties: np.ndarray, sizes: np.ndarray):
    """Marginals for good, and the expected numbers of kept good and kept bad neighbours."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]]) if len(order) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    at = first[order]
    good, bad = np.zeros(len(score)), np.zeros(len(score))  # forward sums, in logarithms
    good[at], bad[at] = score[at], 0.0
    for t in range(1, longest):
        i = at[: active[t]] + t
        g, b = good[i - 1], bad[i - 1]
        good[i] = score[i] + np.logaddexp(g + ties[0], b)
        bad[i] = np.logaddexp(g, b + ties[1])
    later_g, later_b = np.zeros(len(score)), np.zeros(len(score))
    kept = np.zeros(2)
    ends = np.logaddexp(good[first + sizes - 1], bad[first + sizes - 1])
    total = np.repeat(ends, sizes)
    for t in range(longest - 1, 0, -1):
        i = at[: active[t]] + t
        g, b = later_g[i] + score[i], later_b[i]
        later_g[i - 1] = np.logaddexp(ties[0] + g, b)
        later_b[i - 1] = np.logaddexp(g, ties[1] + b)
        kept += np.exp(good[i - 1] + ties[0] + g - total[i]).sum(), np.exp(bad[i - 1] + ties[1] + b - total[i]).sum()
    return np.exp(np.minimum(0, good + later_g - total)), kept


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> LineField:
    """Maximum likelihood of the lines' labels (each line has its text's) by gradient steps with decay."""
    weights, ties = np.zeros(FEATURES + 1), np.zeros(2)
    if not texts:
        return LineField(weights, ties)
    active, sizes, _ = features(texts)
    y = np.repeat(labels.astype(np.float64), sizes)
    pairs = sizes - 1
    kept = np.array([(pairs * labels).sum(), (pairs * (1 - labels)).sum()])
    theta = np.zeros(FEATURES + 3)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, ties = theta[: FEATURES + 1], theta[FEATURES + 1 :]
        p, expected = _chains(weights[active].sum(1), ties, sizes)
        up = np.bincount(active.ravel(), np.repeat(y - p, active.shape[1]), FEATURES + 1)
        up[FEATURES] = 0
        grad = np.concatenate([up, kept - expected]) / len(texts) - DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(theta[: FEATURES + 1], theta[FEATURES + 1 :])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 8 << 20) -> LineField:
    """Fit on labelled documents (doc_id, text) and (doc_id, quality 0 or 1).

    At most about ``sample`` documents with ``sample_bytes`` of text in all are used, chosen as
    ``common.labelled_texts`` says. Without any labelled text (also in empty tables) every line gets 0.5.
    """
    return fit(*labelled_texts(docs, labels, "quality", sample, sample_bytes))


def score(docs: DataFrame, field: LineField, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted, lines) of every row of ``docs``; only the whole text is looked at.

    ``score`` is the length-weighted mean of P(good) over the lines (a line weighs its characters
    and one more); ``predicted`` is 1 from ``threshold`` on; ``lines`` has P(good) of each line.
    Null and empty texts are one empty line. Texts of any length are taken whole, in one task each;
    repeated rows get the same score each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                active, sizes, lengths = features(part.column("text").to_pylist())
                p = field.marginals(active, sizes)
                first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
                mean = means(p, sizes, lengths)
                lines = pa.ListArray.from_arrays(pa.array(np.append(first, len(p)), pa.int32()), pa.array(p))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(mean), pa.array((mean >= threshold).astype(np.int32)), lines], names=[id_col, "score", "predicted", "lines"])

    return docs.select(id_col, "text").mapInArrow(tidy(run), f"{id_col} {kind}, score double, predicted int, lines array<double>")


def keep_good(docs: DataFrame, field: LineField, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score (see ``score``) reaches ``threshold``, all columns as they are.

    Null, empty, long and repeated rows are scored as ``score`` says, each by itself.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                active, sizes, lengths = features(part.column("text").to_pylist())
                yield part.filter(pa.array(means(field.marginals(active, sizes), sizes, lengths) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def means(p: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each text's mean of its lines' ``p``, weighted by their lengths and one."""
    first = (np.cumsum(sizes) - sizes).astype(np.int64)
    return np.clip(np.add.reduceat(p * (lengths + 1), first) / np.add.reduceat(lengths + 1, first), 0, 1)
