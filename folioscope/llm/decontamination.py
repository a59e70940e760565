"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values keeps its
template. A capital makes a name. Where an item begins a sentence with one, which may be any word,
its windows are offered in both readings, and the slots' consistency decides. Windows of eight
canonical words meet in a hash join whose build side is a block of the benchmark of limited size (a
larger benchmark takes several passes over the documents). Matches on one alignment must fill the
slots consistently: equal values stay equal, different ones different. Windows of the words
themselves, case aside, meet too: they find copies in lower case and what has too few plain words
for a template.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship, sliced, tidy

WINDOW, LITERALS, RUN, BLOCK_BYTES = 8, 5, 13, 16 << 20
#: Words taken as units and as numbers.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces lb lbs pound pounds ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma "
    "j kj cal kcal n pa kpa bar degree degrees celsius fahrenheit kelvin percent dollar dollars cent cents euro euros usd eur gbp kmh mph byte bytes kb mb gb tb"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_NUMBER = re.compile(r"[+-]?(?:\d[\d.,:/]*)(?:e[+-]?\d+|th|st|nd|rd)?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = ".,;:!?\"'()[]"
_LITERAL, _NUM, _UNIT, _NAME, _SKIP = range(5)
_TYPED = dict.fromkeys(UNITS, _UNIT) | dict.fromkeys(NUMBERS, _NUM)
_MARKS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(WINDOW)], np.uint64)
_CACHED = 300_000


class Canon:
    """Canonical words through a cache of limited size."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.hash: list[int] = []
        self.flag: list[int] = []  # kind, 8 for a capital at the start, 16 for the end of a sentence

    def learn(self, words: set[str]) -> None:
        for raw in words:
            word = raw if raw.isalpha() else raw.strip(_ENDS)
            if word and not (word[0].isalnum() and word[-1].isalnum()):
                word = _EDGE.sub("", word)
            low = word.lower()
            if not word:
                kind = _SKIP
            elif low in _TYPED:
                kind = _TYPED[low]
            elif word[-1].isdigit() or word[0].isdigit():
                kind = _NUM if _NUMBER.fullmatch(low) else _LITERAL
            else:
                kind = _LITERAL
            tail = "" if raw[-1].isalnum() else raw[len(raw.rstrip(".!?\"')]”»")) :]
            self.known[raw] = len(self.hash)
            self.hash.append(xxhash.xxh64_intdigest(low))
            self.flag.append(kind | (8 if word[:1].isupper() else 0) | (16 if any(c in ".!?" for c in tail) else 0))

    def sequence(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words that are not skipped: canonical hash, kind, their text (number), their place there, own hash (case aside), and whether they are capitals at the start of a sentence."""
        if len(self.known) > _CACHED:
            self.__init__()
        self.learn(set().union(*docs).difference(self.known) if docs else set())
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(docs)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flag, hashes = np.array(self.flag, np.uint8)[ids], np.array(self.hash, np.uint64)[ids]
        start = np.ones(len(ids), bool)
        start[1:] = (flag[:-1] & 16 > 0) | (doc[1:] != doc[:-1])
        kind = flag & 7
        number = np.zeros(len(ids), bool)
        number[1:] = (kind[:-1] == _NUM) & (doc[1:] == doc[:-1])
        kind = np.where((kind == _UNIT) & ~number, _LITERAL, kind)  # a unit stands behind a number only: "a" is a word else
        capital = (kind == _LITERAL) & (flag & 8 > 0)
        kind = np.where(capital, _NAME, kind)
        keep = kind != _SKIP
        canon = np.where(kind == _LITERAL, hashes, _MARKS[kind])
        return canon[keep], kind[keep], doc[keep], place[keep], hashes[keep], (capital & start)[keep]


def rolled(canon: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` canonical words, and which of them lie in one text."""
    n = len(canon) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += canon[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB), doc[:n] == doc[size - 1 :]


@dataclass
class Items:
    """A block of the benchmark: its windows by form (True: the words themselves) and size, sorted by hash."""

    ids: list[int]
    lengths: list[int]
    words: list[list[str]]  # canonical items: the plain words
    kinds: list[np.ndarray]
    windows: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # (form, size) -> hash, item, first word
    maps: dict[tuple[bool, int], np.ndarray] = field(default_factory=dict)


def prepare(rows: list[tuple[int, str]]) -> Items:
    """All windows as they are, those with ``LITERALS`` plain words at least as templates too.

    An item of fewer than ``WINDOW`` words is one window. A capital at the start of a sentence is
    read as a name and as a plain word, in all ways for up to three of them in a window; beyond that,
    every third is read alike.
    """
    split = [(t or "").split() for _, t in rows]
    canon = Canon()
    c, kind, doc, place, raw, start = canon.sequence(split)
    items = Items([i for i, _ in rows], np.bincount(doc, minlength=len(rows)).tolist(), [], [])
    first = np.concatenate(([0], np.cumsum(items.lengths))).astype(np.int64)
    for i in range(len(rows)):
        at = slice(first[i], first[i + 1])
        items.words.append([_EDGE.sub("", split[i][p]).lower() for p in place[at]])
        items.kinds.append(kind[at])
    turn = (np.cumsum(start) - 1) % 3
    for size in sorted({min(WINDOW, n) for n in items.lengths if n}):
        h, whole = rolled(raw, doc, size)
        own = np.array(items.lengths)[doc[: len(h)]]
        fits = whole & (np.minimum(own, WINDOW) == size)
        every = np.flatnonzero(fits)
        own_hash, found = h[every], []
        for ways in range(8 if start.any() else 1):  # a bit says how every third start is read
            named = start & ((ways >> turn) & 1 > 0)
            template, _ = rolled(np.where(start, np.where(named, _MARKS[_NAME], raw), c), doc, size)
            plain = np.convolve((kind == _LITERAL) | (start & ~named), np.ones(size, np.int64), "valid")[: len(h)]
            at = np.flatnonzero(fits & (plain >= LITERALS))
            found.append(np.stack([template[at], at.astype(np.uint64)]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        template = both[0], both[1].astype(np.int64)
        for exact, (hashes, at) in ((False, template), (True, (own_hash, every))):
            if not len(at):
                continue
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            items.windows[exact, size] = hashes, doc[at], at - first[doc[at]]
            seen = np.zeros(1 << 20, bool)
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            items.maps[exact, size] = seen
    return items


def enough(length: int, least: int = 13, share: float = 0.4) -> int:
    """Words of an item that must be covered: ``share`` of them, ``least`` at least, all of a shorter item."""
    return min(length, max(least, -(-length * share // 1)))


def longest(words: set[int]) -> int:
    """The length of the longest run of successive numbers."""
    best = run = 0
    for x in sorted(words):
        run = run + 1 if x - 1 in words else 1
        best = max(best, run)
    return best


def matches(items: Items, canon: Canon, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, covered words, first and last word matched) of every leak."""
    docs = [(t or "").split() for t in texts]
    c, _, doc, place, raw, _ = canon.sequence(docs)
    found: dict[tuple[int, int], dict[int, list[tuple[int, int, int, bool]]]] = defaultdict(lambda: defaultdict(list))
    for (exact, size), (hashes, item, start) in items.windows.items():
        h, whole = rolled(raw if exact else c, doc, size)
        at = np.flatnonzero(items.maps[exact, size][(h >> np.uint64(44)).astype(np.int64)] & whole)
        low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            for k in range(a, b):
                found[int(doc[p]), int(item[k])][p - int(start[k])].append((p, int(start[k]), size, exact))
    out = []
    for (d, i), diagonals in found.items():
        covered, spots, run = set(), [], 0
        for hits in diagonals.values():
            ways, back, sound = {}, {}, True
            for p, j, size, exact in hits:
                for k in range(0 if exact else size):
                    if items.kinds[i][j + k] != _LITERAL:
                        word = _EDGE.sub("", docs[d][place[p + k]]).lower()
                        key = (int(items.kinds[i][j + k]), items.words[i][j + k])
                        sound &= ways.setdefault(key, word) == word and back.setdefault((key[0], word), key) == key
            hits = [x for x in hits if sound or x[3]]
            own = {x for _, j, size, _ in hits for x in range(j, j + size)}
            covered |= own
            run = max(run, longest(own))
            spots += [p for p, *_ in hits] + [p + size - 1 for p, _, size, _ in hits]
        if covered and (run >= RUN or len(covered) >= enough(items.lengths[i])):
            out.append((d, i, len(covered), int(place[min(spots)]), int(place[max(spots)])))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, covered_words, share, first_word, last_word) of every item that a document leaks.

    An item leaks where consistent matches cover ``enough`` of its canonical words, or ``RUN`` of
    them in a row on one alignment; ``first_word``
    and ``last_word`` bound the matches among the document's words (cut at white space). Windows
    and items with fewer than five plain words are found with the same values only, a short item
    wherever all its words stand in a row. Null or empty items and texts, and rows with a null
    item_id give nothing; null doc_ids are kept; repeated rows give one row. Items that share an id are
    matched each, and the one with most words covered counts. Texts of any length are taken whole,
    in one task each; empty tables give no rows. Documents are not shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, covered_words long, share double, first_word long, last_word long"
    parts = [_pass(docs, block, schema) for block in _blocks(benchmark, block_bytes)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    best = F.max(F.struct("covered_words", "share", (-F.col("first_word")).alias("f"), "last_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.covered_words", "best.share", (-F.col("best.f")).alias("first_word"), "best.last_word")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The benchmark's distinct items, prepared in blocks of limited size; one block at least."""
    held, size, made = [], 0, 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield prepare(held)
            held, size, made = [], 0, made + 1
    if held or not made:
        yield prepare(held)


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item (see ``leaks``), all columns as they are; nothing is shuffled.

    Blocks of the benchmark are taken in turn, what each has left is written, so that a task never
    holds more than one of them.
    """
    ship(docs.sparkSession)
    for n, block in enumerate(_blocks(benchmark, block_bytes)):
        rows = materialize(docs, "decontaminated") if n else docs
        docs = rows.mapInArrow(tidy(_filter(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs


def _filter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            for part in sliced(batch):
                leaking = {hit[0] for hit in matches(shared.value, canon, part.column("text").to_pylist())}
                yield part.filter(pa.array([i not in leaking for i in range(part.num_rows)], pa.bool_()))

    return run


def _pass(docs: DataFrame, block: Items, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # a block of limited size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        canon = Canon()
        for batch in batches:
            for part in sliced(batch):
                hits = matches(items, canon, part.column("text").to_pylist())
                own = part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                numbers = [pa.array([f(h) for h in hits], t) for f, t in (
                    (lambda h: items.ids[h[1]], pa.int64()), (lambda h: h[2], pa.int64()), (lambda h: h[2] / items.lengths[h[1]], pa.float64()),
                    (lambda h: h[3], pa.int64()), (lambda h: h[4], pa.int64()))]
                yield pa.RecordBatch.from_arrays([own, *numbers], names=["doc_id", "item_id", "covered_words", "share", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
