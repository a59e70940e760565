"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols are its characters; the adjacent pair whose joined piece has the best score is
merged again and again (leftmost first among equals). The count is the number of initial symbols
less the merges; characters that no piece holds count as the bytes they fall back to. No ids are
made. Equal to the length of the sentencepiece library's encoding without begin and end tokens.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from folioscope.llm.common import map_texts, resident

SPACE = "▁"
_LONGEST, _CACHED = 48, 400_000
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    """Counts the pieces of a text for a byte-pair sentencepiece model.

    No piece of such a model holds a word mark after another character, so words (with the marks
    before them) are merged on their own and their counts are kept in a cache of limited size.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        normal = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.rank = {m.id_to_piece(i): -m.get_score(i) for i in normal}
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in self.rank)
        self.words: dict[str, int | None] = {}
        self.runs: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.merged(SPACE + text.replace(" ", SPACE))
        if len(self.words) + len(self.runs) > _CACHED:
            self.words.clear()
            self.runs.clear()
        try:
            return sum(map(self.words.__getitem__, text.split(" ")))
        except (KeyError, TypeError):
            total = 0
            for word in text.split(" "):
                n = self.words.get(word, 0)
                if n == 0:
                    n = self._learn(word)
                if n is None:
                    break
                total += n
            else:
                return total
        return sum(map(self._run, _RUNS.findall(SPACE + text.replace(" ", SPACE))))

    def _learn(self, word: str) -> int | None:
        """The count of a word with a mark before it; None where runs of marks may cross the cut."""
        n = None if not word or SPACE in word else self.merged(SPACE + word)
        if len(word) <= _LONGEST:
            self.words[word] = n
        return n

    def _run(self, run: str) -> int:
        n = self.runs.get(run)
        if n is None:
            n = self.merged(run)
            if len(run) <= _LONGEST:
                self.runs[run] = n
        return n

    def merged(self, text: str) -> int:
        rank = self.rank
        symbols: list[str] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            score = rank.get(text[i : i + 2])
            if score is not None:
                heap.append((score, i, i + 1, 2))
        heapify(heap)
        merges = 0
        while heap:
            _, i, j, size = heappop(heap)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of them has been merged since
            symbols[i], symbols[j] = left + right, ""
            merges += 1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                piece = symbols[i] + symbols[k]
                score = rank.get(piece)
                if score is not None:
                    heappush(heap, (score, i, k, len(piece)))
            k = before[i]
            if k >= 0:
                piece = symbols[k] + symbols[i]
                score = rank.get(piece)
                if score is not None:
                    heappush(heap, (score, k, i, len(piece)))
        return n - merges + sum(len(x.encode()) - 1 for x in symbols if x and x not in rank)


def counter(path: str) -> PieceCounter:
    return resident(path, lambda: PieceCounter(path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; repeated rows stay repeated; other columns
    are ignored. One narrow stage: nothing is shuffled.
    """

    def make():
        pieces = counter(model_path)

        def work(texts, kept):
            n = [pieces.count(t) for t in texts]
            return {id_col: kept[id_col], "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_texts(docs, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean", [id_col], make, keeps=model_path)
