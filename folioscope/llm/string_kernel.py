"""A gap-weighted subsequence kernel over words, with landmarks.

The kernel of two words sums over all common subsequences of one to ``ORDER`` letters or digits, each
weighted by the characters that its occurrences skip: a skipped letter weighs ``GAP``, any other
skipped character ``SOFT``, so that marks strewn into a word cost little. Longer subsequences count
more. It is normalised to 1 of a word with itself. Landmarks give words finite features (Nyström):
the kernel with each landmark, times the inverse root of the landmarks' own kernel matrix.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

ORDER, GAP, SOFT, RIDGE = 3, 0.85, 0.95, 1e-3
#: What a common subsequence of 1, 2, ... characters counts.
WEIGHTS = np.array([0.2, 1.0, 3.0], np.float32)
LONGEST = 32  # longer words are taken in pieces of this length that overlap by half
_ROWS, _SHORT = 256, 14


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words of one length (words x length): their code, negative where they never match, and their decay."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int32)
    kinds = {c: chr(c).isalnum() for c in np.unique(codes).tolist()}
    letter = np.vectorize(kinds.__getitem__, otypes=[bool])(codes) if codes.size else np.zeros(codes.shape, bool)
    return np.where(letter, codes, -1), np.where(letter, np.float32(GAP), np.float32(SOFT)).astype(np.float32)


def _kernel(codes: np.ndarray, decay: np.ndarray, other: np.ndarray, other_decay: np.ndarray) -> np.ndarray:
    """Raw kernels. codes: length x words; other: length x words x landmarks (or broadcast to it)."""
    shape = np.broadcast_shapes(codes.shape[1:] + (1,), other.shape[1:])
    width = len(other)
    open_ = np.zeros((ORDER - 1, width + 1, *shape), np.float32)  # place 0 stays empty: what ends before the first character
    total = np.zeros(shape, np.float32)
    kept = np.empty((width, *shape), np.float32)
    for a in range(len(codes)):
        own = codes[a][:, None]
        match = ((other == own[None]) & (own[None] >= 0)).astype(np.float32)
        fade = decay[a][:, None]
        for i in range(ORDER - 1, -1, -1):  # longest first: open_[i - 1] is still that of the characters before
            ends = match if i == 0 else np.multiply(match, open_[i - 1, :-1], out=kept)
            total += WEIGHTS[i] * ends.sum(0)
            if i == ORDER - 1:
                continue
            state = open_[i]
            state *= fade
            run = np.zeros(shape, np.float32)
            for b in range(width):
                run *= other_decay[b]
                run += ends[b]
                state[b + 1] += run
    return total


class Landmarks:
    """Words to compare others with; ``features`` gives the normalised kernel with each.

    The kernel is a sum over subsequences. For short plain words these are few and stand at the same
    places in all words of a length, so they are looked up in a table of the landmarks' own
    subsequences; other words take the recursion. Both give the same sums.
    """

    def __init__(self, words: list[str]):
        self.words = words
        longest = max(map(len, words))
        codes, decay = np.full((longest, 1, len(words)), -2, np.int32), np.ones((longest, 1, len(words)), np.float32)
        for j, w in enumerate(words):
            c, d = coded([w])
            codes[: len(w), 0, j], decay[: len(w), 0, j] = c[0], d[0]
        self.codes, self.decay = codes, decay
        self.norm = np.sqrt(np.maximum(own_kernel(words), 1e-9))
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w if c.isalnum()}))}
        base = len(self.letters) + 1
        values: dict[int, np.ndarray] = {}  # of a subsequence, written with its order in base ``base``: what it weighs in each landmark
        for j, w in enumerate(words):
            for n in range(1, ORDER + 1):
                for at in combinations([i for i, c in enumerate(w) if c.isalnum()], n):
                    skipped = [GAP if w[i].isalnum() else SOFT for i in range(at[0], at[-1]) if i not in at]
                    key = (n - 1) * base**ORDER + sum(self.letters[w[i]] * base**p for p, i in enumerate(at))
                    values.setdefault(key, np.zeros(len(words), np.float32))[j] += np.prod(skipped) * WEIGHTS[n - 1]
        self.row = np.zeros(ORDER * base**ORDER, np.int32)  # 0: of no landmark
        self.row[list(values)] = np.arange(1, len(values) + 1)
        self.table = np.vstack([np.zeros((1, len(words)), np.float32), *values.values()]) / self.norm.astype(np.float32)
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _subsequences(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For words of ``size`` letters: what each letter adds to each key (letters x keys, and a constant), and the keys' weights."""
        if size not in self.places:
            base, every = len(self.letters) + 1, [at for n in range(1, ORDER + 1) for at in combinations(range(size), n)]
            digits = np.zeros((size + 1, len(every)), np.int64)
            for k, at in enumerate(every):
                for p, i in enumerate(at):
                    digits[i, k] = base**p
                digits[size, k] = (len(at) - 1) * base**ORDER
            weights = np.array([GAP ** (at[-1] - at[0] + 1 - len(at)) for at in every], np.float32)
            self.places[size] = digits, weights
        return self.places[size]

    def compared(self, words: list[str], with_: np.ndarray) -> np.ndarray:
        """Normalised kernels with the landmarks, times ``with_`` (landmarks x columns).

        Words have up to ``LONGEST`` characters, of which the first and last are letters or digits;
        those without any have zeros.
        """
        out = np.zeros((len(words), with_.shape[1]), np.float32)
        norm = np.sqrt(np.maximum(own_kernel(words), 1e-9)).astype(np.float32)
        table = self.table @ with_.astype(np.float32)
        for at in _by_length(words):
            some = [words[i] for i in at]
            size = len(some[0])
            plain = np.array([size <= _SHORT and w.isalnum() for w in some])
            if plain.any():
                digits, weights = self._subsequences(size)
                own = np.array([[self.letters.get(c, -1) for c in w] for w, p in zip(some, plain) if p], np.int64)
                key = np.where(own < 0, 0, own) @ digits[:size] + digits[size]
                row = self.row[key]
                if (own < 0).any():
                    row[((own < 0).astype(np.int8) @ (digits[:size] > 0).astype(np.int8)) > 0] = 0
                # row sums, not products of matrices: a word's value must not depend on the words beside it
                out[at[plain]] = (table[row, 0] * weights).sum(1)[:, None] if table.shape[1] == 1 else np.einsum("wkc,k->wc", table[row], weights)
            if not plain.all():
                codes, decay = coded([w for w, p in zip(some, plain) if not p])
                raw = _kernel(codes.T, decay.T, self.codes, self.decay) / self.norm.astype(np.float32)
                out[at[~plain]] = (raw * with_[:, 0]).sum(1)[:, None] if table.shape[1] == 1 else raw @ with_
        return out / norm[:, None]

    def features(self, words: list[str]) -> np.ndarray:
        """Words x landmarks."""
        return self.compared(words, np.eye(len(self.words)))

    def root(self) -> np.ndarray:
        """The inverse root of the landmarks' kernel matrix."""
        values, vectors = np.linalg.eigh(self.features(self.words).astype(np.float64))
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + RIDGE)) @ vectors.T


def own_kernel(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words))
    for at in _by_length(words, 4096):
        codes, decay = coded([words[i] for i in at])
        out[at] = _kernel(codes.T, decay.T, codes.T[:, :, None], decay.T[:, :, None])[:, 0]
    return out


def _by_length(words: list[str], rows: int = _ROWS):
    """Places of words of equal lengths, some at a time; empty words are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        if sizes[order[a]]:
            for i in range(a, b, rows):
                yield order[i : min(b, i + rows)]


def pieces(word: str) -> list[str]:
    """A word as itself, or as pieces of ``LONGEST`` characters that overlap by half."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]
