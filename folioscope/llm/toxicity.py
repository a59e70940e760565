"""Toxicity of documents: a support vector machine with a subsequence string kernel over words.

A sentence is as toxic as its most toxic word. A document is judged by its three most toxic words
and its length. Words are compared by gap-weighted common subsequences (``string_kernel``), so an insult with marks, blanks or
letters put in between stays close to the plain one. Single letters that follow each other are read
as one word.

Learning sees sentences with the labels of their documents. Most sentences of a toxic document are
harmless, so the machine is trained in turns: sentences of toxic documents stand for the words that
the machine of the turn before calls toxic, and each such document for the worst word of its worst
sentence; all words of clean sentences are negative. A sigmoid, fitted on documents, makes the
margins a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import labelled_texts, resident, ship, sliced, tidy
from folioscope.llm.string_kernel import Landmarks, pieces

LANDMARKS, TURNS, COST, TOLD = 96, 5, 10.0, 4.0
_CACHED, _SPELLED, _STEP = 500_000, 3, 16_384
_ENDS = ".!?…"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, the word of each place, sentence of each place, document of each sentence).

    Words are split at white space, lower-cased, and freed of marks at their ends; three or more
    single letters in a row are one more word. A sentence ends with a line, or with a word that ends
    in a full stop, an exclamation or a question mark and isn't a single letter. Every text has a
    sentence at least, maybe without words.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lines = pc.split_pattern(texts, "\n")
    n_lines = np.diff(lines.offsets.to_numpy())
    line_doc = np.repeat(np.arange(len(texts)), n_lines)
    words = pc.utf8_split_whitespace(lines.flatten())
    n_words = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    shown = flat.dictionary.to_pylist()
    place = flat.indices.to_numpy()
    bare = [_EDGES.sub("", w) for w in shown]
    single = np.array([len(b) <= 1 for b in bare], bool)
    marks = np.array([bool(w) and w[-1] in _ENDS and len(b) > 1 for w, b in zip(shown, bare)], bool)
    line = np.repeat(np.arange(len(n_words)), n_words)
    # sentences: a new one begins with a line and after an end
    ends = marks[place] if len(place) else np.zeros(0, bool)
    begins = np.ones(len(place), bool)
    begins[1:] = (line[1:] != line[:-1]) | ends[:-1]
    empty = np.flatnonzero(n_words == 0)
    order = np.argsort(np.concatenate([line[begins], empty]), kind="stable")
    sentence_doc = line_doc[np.concatenate([line[begins], empty])[order]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sentence = rank[np.cumsum(begins) - 1] if len(place) else np.zeros(0, np.int64)
    # spelled words
    alone = single[place] if len(place) else np.zeros(0, bool)
    edge = np.diff(alone.astype(np.int8), prepend=0, append=0)
    extra, extra_at = [], []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= _SPELLED:
            for cut in _by_document(line_doc[line[a:b]], a):
                letters = _EDGES.sub("", " ".join([shown[place[i]] for i in range(*cut)]))
                if sum(c.isalnum() for c in letters) >= _SPELLED:
                    extra.append(letters)
                    extra_at.append(sentence[cut[0]])
    index: dict[str, int] = {}
    code = np.array([index.setdefault(b, len(index)) for b in bare], np.int64)
    more = np.array([index.setdefault(b, len(index)) for b in extra], np.int64)
    each = np.concatenate([code[place] if len(place) else np.zeros(0, np.int64), more])
    return list(index), each, np.concatenate([sentence, np.array(extra_at, np.int64)]), sentence_doc


def _by_document(docs: np.ndarray, start: int) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)]
    return [(start + a, start + b) for a, b in zip(cuts, cuts[1:])]


def worst(values: np.ndarray, groups: np.ndarray, size: int, none: float, count: int = 1) -> np.ndarray:
    """The ``count`` greatest of ``values`` of each group (groups x count), greatest first; ``none`` where there are fewer."""
    order = np.lexsort((-values, groups))
    held = np.bincount(groups, minlength=size)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
    out = np.full((size, count), none)
    top = rank < count
    out[groups[order[top]], rank[top]] = values[order[top]]
    return out


@dataclass
class Machine:
    """landmarks with their coefficients and the bias; ``slopes`` (of the three worst margins, the logarithm of the length, and one) make a score."""

    landmarks: Landmarks | None
    alpha: np.ndarray
    bias: float
    slopes: np.ndarray

    def margins(self, words: list[str], known: dict[str, float] | None = None) -> np.ndarray:
        """The decision value of each word; words without letters have the bias alone."""
        if self.landmarks is None:
            return np.full(len(words), self.bias)
        known = {} if known is None else known
        found = list(map(known.get, words))
        new = [i for i, v in enumerate(found) if v is None]
        parts = [pieces(words[i]) for i in new]
        flat = [_EDGES.sub("", p) for own in parts for p in own]
        value = self.landmarks.compared(flat, self.alpha[:, None])[:, 0].astype(np.float64) + self.bias
        at = 0
        for i, own in zip(new, parts):
            found[i] = known[words[i]] = float(value[at : at + len(own)].max())
            at += len(own)
        if len(known) > _CACHED:
            known.clear()
        return np.array(found, np.float64)

    def evidence(self, margin: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
        """What documents are scored by, from the margins of all their words (``docs``: the document of each).

        Margins beyond 1 count as 1: the machine is as sure there as it was asked to be.
        """
        words = np.bincount(docs, minlength=size)
        return np.column_stack([worst(np.minimum(margin, 1), docs, size, min(self.bias, 1.0), 3), np.log1p(words), np.ones(size)])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((evidence * self.slopes).sum(1), -50, 50)))


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine on the given rows of ``x``, by Newton steps over those within the margin.

    Rows are taken some at a time, so that no second copy of ``x`` is held.
    """
    size = x.shape[1] + 1
    keep = np.eye(size)
    keep[-1, -1] = 1e-6

    def wide(at: int) -> np.ndarray:
        some = x[rows[at : at + _STEP]]
        return np.hstack([some, np.ones((len(some), 1), some.dtype)]).astype(np.float64)

    def loss(w: np.ndarray) -> float:
        total = 0.0
        for at in range(0, len(rows), _STEP):
            short = np.maximum(0, 1 - y[at : at + _STEP] * (wide(at) @ w))
            total += float((weight[at : at + _STEP] * short * short).sum())
        return float(w @ keep @ w / 2 + cost * total)

    w = np.zeros(size)
    now = loss(w)
    for _ in range(100):
        square, side = keep.copy(), np.zeros(size)
        for at in range(0, len(rows), _STEP):
            a, own = wide(at), y[at : at + _STEP]
            inside = own * (a @ w) < 1
            a, c = a[inside], 2 * cost * weight[at : at + _STEP][inside]
            square += (a * c[:, None]).T @ a
            side += (a * (c * own[inside])[:, None]).sum(0)
        step, length = np.linalg.solve(square, side) - w, 1.0
        while length > 1e-4 and loss(w + length * step) > now:
            length /= 2
        w = w + length * step
        now, last = loss(w), now
        if last - now <= 1e-6 * last:
            break
    return w[:-1], float(w[-1])


def told(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely a word in so many toxic and clean documents is one of toxic ones: the signed root of its deviance from the share of toxic documents."""
    base, n = n_toxic / (n_toxic + n_clean), np.maximum(1, toxic + clean)
    share = toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (np.where(toxic > 0, toxic * np.log(share / base), 0) + np.where(clean > 0, clean * np.log((1 - share) / (1 - base)), 0))
    return np.sign(share - base) * np.sqrt(np.maximum(0, deviance))


def chosen_landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, docs: tuple[int, int], count: int) -> list[str]:
    """Half the words that most tell toxic sentences from clean ones, half spread over all others."""
    plain = [i for i, w in enumerate(words) if 3 <= len(w) <= 12 and w.isalnum()]
    tell = told(toxic, clean, *docs)
    best = sorted(plain, key=lambda i: (-tell[i], words[i]))[: count // 2]
    rest = sorted(set(plain) - set(best), key=lambda i: words[i])
    step = max(1, len(rest) // max(1, count - len(best)))
    return [words[i] for i in best + rest[::step][: count - len(best)]]


def fit(texts: list[str], labels: np.ndarray) -> Machine:
    """Train on whole texts with labels 0 and 1. With one label alone every word gets the same score."""
    labels = np.asarray(labels, np.int64)
    constant = Machine(None, np.zeros(0), 0.0, np.array([0, 0, 0, 0, 50.0 if len(labels) and labels.all() else -50.0]))
    if not len(labels) or labels.all() or not labels.any():
        return constant
    words, place, sentence, doc = units(pa.array(texts, pa.string()))
    all_places = place, doc[sentence]
    bad = labels[doc].astype(bool)
    pair = np.unique(place * len(doc) + sentence)  # a word counts once a sentence
    place, sentence = pair // len(doc), pair % len(doc)
    of_bad = bad[sentence]
    per_doc = np.unique(place * len(texts) + doc[sentence])
    toxic = np.bincount(per_doc // len(texts), labels[per_doc % len(texts)] == 1, len(words))
    clean = np.bincount(per_doc // len(texts), labels[per_doc % len(texts)] == 0, len(words))
    short = np.array([0 < len(w) <= 32 for w in words], bool)
    negative = np.flatnonzero((clean > 0) & short)
    marks = chosen_landmarks(words, toxic, clean, (int(labels.sum()), int((1 - labels).sum())), LANDMARKS)
    if not marks:
        return constant
    landmarks = Landmarks(marks)
    root = landmarks.root()
    wanted = np.flatnonzero(short & ((clean > 0) | (toxic > 0)))
    row = np.full(len(words), -1)
    row[wanted] = np.arange(len(wanted))
    x = landmarks.compared([words[i] for i in wanted], root)
    tell = told(toxic, clean, int(labels.sum()), int((1 - labels).sum()))
    margin = np.where(short, tell - TOLD, -np.inf)  # of the first turn
    fine = of_bad & short[place] & (tell[place] > 0)  # a word that is as frequent in clean documents is no insult
    places, sentences = place[fine], sentence[fine]
    taken = None
    for turn in range(TURNS):
        # all toxic words of toxic documents, and the worst word of the worst sentence of each
        order = np.lexsort((places, -margin[places], doc[sentences]))
        best = order[np.flatnonzero(np.diff(doc[sentences[order]], prepend=-1))]
        best = best[margin[places[best]] > -1]  # a document without any such word is taken for a wrong label
        chosen = np.flatnonzero(margin[places] > 0)
        positive = np.union1d(chosen, best)
        if not len(positive):
            return constant
        if taken is not None and np.array_equal(taken, positive):
            break
        taken = positive
        counts = np.bincount(np.unique(places[positive] * len(texts) + doc[sentences[positive]]) // len(texts), minlength=len(words))  # documents
        yes = np.flatnonzero(counts)
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(negative))])
        weight = np.concatenate([counts[yes] * ((1 - labels).sum() / labels.sum()), clean[negative]])
        w, bias = svm(x, row[np.concatenate([yes, negative])], y, weight, COST)
        margin = np.full(len(words), -np.inf)
        margin[wanted] = x @ w + bias
    machine = Machine(landmarks, root @ w, bias, np.zeros(5))
    known = np.where(np.isneginf(margin), bias, margin)
    evidence = machine.evidence(known[all_places[0]], all_places[1], len(texts))
    used = np.arange(evidence.shape[1])
    while True:  # a more toxic word never lowers the score
        machine.slopes = np.zeros(evidence.shape[1])
        machine.slopes[used] = sigmoid(evidence[:, used], labels)
        if (machine.slopes[:3] >= 0).all():
            return machine
        used = np.setdiff1d(used, np.flatnonzero(machine.slopes[:3] < 0))


def sigmoid(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Coefficients of the likeliest sigmoid over rows ``x``, by Newton steps with a little decay; targets are off 0 and 1 by the counts."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    decay = 0.01 * np.eye(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + w @ decay @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay, x.T @ (target - p) - decay @ w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 4 << 20) -> Machine:
    """Train on labelled documents (doc_id, text) and (doc_id, toxic 0 or 1).

    At most about ``sample`` documents with ``sample_bytes`` of text in all are used, chosen as
    ``common.labelled_texts`` says. Without a toxic text every document scores 0; without a clean one, 1.
    """
    texts, marks = labelled_texts(docs, labels, "toxic", sample, sample_bytes)
    return fit(texts, marks)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted, sentence) of every row of ``docs``; only the whole text is looked at.

    ``sentence`` is the number, from 0, of the first most toxic sentence. Null and empty texts have one
    sentence; where a text has fewer than three words, the bias stands for the rest. Long texts are taken whole, in
    one task each; repeated rows get the same score each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[id_col]
    sent = spark.sparkContext.broadcast(machine)  # landmarks and tables over their subsequences: bounded by LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = resident("toxicity", dict)
        for batch in batches:
            for part in sliced(batch):
                own = sent.value
                words, place, sentence, doc = units(part.column("text"))
                margin = own.margins(words, known)
                p = own.probability(own.evidence(margin[place], doc[sentence], part.num_rows))
                top = worst(margin[place], sentence, len(doc), own.bias)[:, 0]
                order = np.lexsort((-top, doc))
                first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
                starts = np.searchsorted(doc, np.arange(part.num_rows))
                values = [part.column(id_col), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array((first - starts).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(values, names=[id_col, "score", "predicted", "sentence"])

    return docs.select(id_col, "text").mapInArrow(tidy(run), f"{id_col} {kind}, score double, predicted int, sentence long")
