"""Language identification: script ranges narrow the candidates, Viterbi labels spans of words.

A word's score for a language is the log probability of its character n-grams (1 to 4, with word
ends) under counts learned from labelled texts. The script of a word's letters rules out the
languages that aren't written in it. Viterbi over the words of a text, with a penalty for each
switch, gives spans of one language; the language with the most letters in its spans names the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ship, sliced, tidy

SLOTS, ORDERS, PENALTY = 1 << 16, 4, 8.0
#: First and last code point of scripts, from the public Unicode block list.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_EDGES = np.array([x for _, a, b in SCRIPTS for x in (a, b + 1)])
_CLASS = np.array([0, *[x for name, _, _ in SCRIPTS for x in (NAMES.index(name), 0)]])
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CACHED = 300_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Fractions, superscripts and other numerals alone are no word."""
    if not text:
        return []
    low = text.lower()
    found = _WORD.findall(low)
    return found if low.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all n-grams, the word of each, and the script of each word's first letter."""
    joined = "\n" + "\n".join(words) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(codes == 10)
    word = np.cumsum(codes == 10) - 1  # the mark before a word counts to it
    out, whose = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDERS + 1):
        h = (h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        inside = (codes[: len(h)] != 10) if n == 1 else word[: len(h)] == word[n - 1 :]
        if n > 1:  # also those that end with the mark after the word
            inside |= (codes[n - 1 :] == 10) & (word[: len(h)] == word[n - 1 :] - 1) & (word[: len(h)] < len(words))
        at = np.flatnonzero(inside)
        out.append(((h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
        whose.append(word[at])
    script = _CLASS[np.searchsorted(_EDGES, codes[ends[:-1] + 1], side="right")] if words else np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose), script


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # slots x languages
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        slots, word, script = grams(words)
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(words)))
        out = np.add.reduceat(self.logs[slots[order]], starts, axis=0) if len(words) else np.zeros((0, len(self.languages)), np.float32)
        fits = self.allowed[script]
        return np.where(fits | ~fits.any(1, keepdims=True), out, -1e4).astype(np.float32)


class Labeller:
    """Scores words through a cache of limited size and labels batches of texts."""

    def __init__(self, model: LanguageModel, penalty: float):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def states(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The language (its number) of every word of every text."""
        if len(self.known) > _CACHED:
            self.known, self.scores = {}, self.scores[:0]
        fresh = list(set().union(*docs).difference(self.known)) if docs else []
        if fresh:
            self.known.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(fresh)])
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        return self._viterbi(flat, first, sizes, order)

    def _viterbi(self, flat, first, sizes, order) -> list[np.ndarray]:
        out = np.zeros(len(flat), np.uint16)
        longest = int(sizes[order[0]]) if len(order) else 0
        ordered = sizes[order]
        active = np.searchsorted(-ordered, -np.arange(longest), side="left")  # texts with a word at each place
        value, steps = None, []
        for t in range(longest):
            n = int(active[t])
            s = self.scores[flat[first[order[:n]] + t]]
            if t == 0:
                value = s.astype(np.float64)
                continue
            held = value[:n]
            best = held.argmax(1)
            top = held[np.arange(n), best] - self.penalty
            switch = held < top[:, None]
            steps.append((switch, best.astype(np.uint16)))
            value = value.copy()
            value[:n] = np.where(switch, top[:, None], held) + s
        if longest:
            state = value.argmax(1)
            for t in range(longest - 1, -1, -1):
                n = int(active[t])
                rows = np.arange(n)
                out[first[order[:n]] + t] = state[:n]
                if t:
                    switch, best = steps[t - 1]
                    state[:n] = np.where(switch[rows, state[:n]], best, state[:n])
        return [out[a : a + n] for a, n in zip(first, sizes)]


def learn(docs: DataFrame, sample_bytes: int = 16 << 20) -> LanguageModel:
    """Learn from (text, lang) rows: those with a text and a language.

    At most about ``sample_bytes`` of text are used, rows being chosen by a hash of their text,
    the same share of every language but at least ``sample_bytes`` / 32 of each. Repeated rows
    count each; an empty table, or one without letters, gives a model of ``und`` alone. At most
    65,536 languages.
    """
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # a row per language
    languages = sorted(x for x, n in sizes.items() if n)
    if not languages:
        return LanguageModel(["und"], np.zeros((SLOTS, 1), np.float32), np.ones((len(NAMES), 1), bool))
    share = sample_bytes / max(1, sum(sizes.values()))
    shares = {x: min(1.0, max(share, sample_bytes / 32 / sizes[x])) for x in languages}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang"))
    sample = labelled.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < bound * (1 << 30))
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS + len(NAMES)), np.int64)
        for batch in batches:
            for part in sliced(batch, 1 << 20):
                by: dict[str, list[str]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by.setdefault(lang, []).extend(words_of(text))
                for lang, words in by.items():
                    if words:
                        slots, _, script = grams(words)
                        total[number[lang], :SLOTS] += np.bincount(slots, minlength=SLOTS)
                        total[number[lang], SLOTS:] += np.bincount(script, minlength=len(NAMES))
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[lang, slot], pa.int64())], names=["lang", "slot", "n"])

    sums = sample.mapInArrow(tidy(count), "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x slots at most
    counts = np.zeros((len(languages), SLOTS + len(NAMES)))
    counts[sums["lang"], sums["slot"]] = sums["n"]
    seen, scripts = counts[:, :SLOTS] + 0.5, counts[:, SLOTS:]
    logs = np.log(seen / seen.sum(1, keepdims=True)).T
    used = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return LanguageModel(languages, np.ascontiguousarray(logs - logs.mean(1, keepdims=True), np.float32), (used > 0.002).T.copy())


def predict(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY, id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, spans) of every row of ``docs``; only the text is looked at.

    ``spans``: array of (lang, first_word, words, letters), in text order. The prediction is the
    language whose spans have the most letters (ties: the first in order), ``score`` its share.
    A text that is null or has no letter (category L) is ``und`` with score 0 and no spans. Texts
    of any length are taken whole, in one task each; repeated rows get the same result each; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shape = spark.sparkContext.broadcast(model)  # languages x fixed sizes
    kind = dict(docs.dtypes)[id_col]
    span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, names = Labeller(shape.value, penalty), shape.value.languages
        for batch in batches:
            for part in sliced(batch, 8 << 20):
                docs_ = [words_of(t) for t in part.column("text").to_pylist()]
                langs, scores, spans = [], [], []
                for words, states in zip(docs_, label.states(docs_)):
                    if not words:
                        langs.append("und"), scores.append(0.0), spans.append([])
                        continue
                    letters = np.fromiter(map(len, words), np.int64, len(words))
                    totals = np.bincount(states, letters, len(names))
                    starts = np.flatnonzero(np.concatenate(([True], states[1:] != states[:-1])))
                    sums = np.add.reduceat(letters, starts).tolist()
                    counts = np.diff(np.append(starts, len(words))).tolist()
                    spans.append([{"lang": names[s], "first_word": a, "words": n, "letters": k} for s, a, n, k in zip(states[starts], starts.tolist(), counts, sums)])
                    langs.append(names[int(totals.argmax())])
                    scores.append(float(totals.max() / totals.sum()))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)], names=[id_col, "lang_pred", "score", "spans"])

    return docs.select(id_col, "text").mapInArrow(tidy(run), f"{id_col} {kind}, lang_pred string, score double, spans array<struct<lang string, first_word long, words long, letters long>>")
