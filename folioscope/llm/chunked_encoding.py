"""Ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Both public vocabularies split a text before they merge, so a text can be cut at blanks and before
sentence marks, and the ids of its chunks joined. Cutting, telling distinct chunks apart and
joining are columnar; only chunks that a cache of limited size doesn't know reach the library
(plain words its merging model directly). Texts whose cuts are not provably harmless are encoded
whole. Results equal ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import gc
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.llm.common import resident

_LONGEST, _CACHED, _BATCH = 48, 700_000, 20_000
#: Texts with such characters are encoded whole: beyond Latin, or separators that libraries see in different ways.
_ODD = "[^\\x02-\\x1b\\x20-\\x{84}\\x{86}-\\x{9f}\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]"
#: Sentence marks after a letter and before white space are a piece of their own in both vocabularies.
_MARKS = r"(\pL)([.,;:!?]+)(\s|$)"
_JOINED = "\x01"  # starts a chunk that no blank stands before


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ChunkedEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)
        self.spaced = self.tokenizer.normalizer is None  # byte-level: a blank belongs to the word after it
        self.letters = byte_letters()
        self.blank = self.letters[0x20] if self.spaced else ""
        self.chunks: dict[str, bytes | bool] = {}  # False: white space might go over the cut

    @staticmethod
    def _ids(encodings) -> list[bytes]:
        found = [array("I", e.ids) for e in encodings]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), _BATCH):
            out += self._ids(self.tokenizer.encode_batch_fast(texts[at : at + _BATCH], add_special_tokens=False))
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        cut = self._cut(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        code = cut.flatten().dictionary_encode()
        on = gc.isenabled()
        gc.disable()  # nothing below makes cycles; walks over the long lists of chunks would take a third of the time
        try:
            values = self._values(code.dictionary.to_pylist())
        finally:
            if on:
                gc.enable()
        at = code.indices.to_numpy(zero_copy_only=False)
        known = np.array([v is not False for v in values], bool)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        if not known.all():
            odd[np.searchsorted(offsets, np.flatnonzero(~known[at]), side="right") - 1] = True
        sizes = np.fromiter(map(len, [v or b"" for v in values]), np.int32, len(values)) // 4
        ids = np.frombuffer(b"".join([v for v in values if v]), "<u4")
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[at]
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        where = np.repeat(first[at] - ends[:-1].astype(np.int32), each)  # a call's texts have far fewer than 2**31 ids
        where += np.arange(ends[-1], dtype=np.int32)
        joined = ids[where].tobytes()
        bounds = (4 * ends[offsets]).tolist()
        out = [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole([texts[i].as_py()])[0]
        return out

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of every text."""
        if not self.spaced:
            marked = pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, r"\1 \2\3")
            return pc.utf8_split_whitespace(marked)
        marked = pc.replace_substring_regex(texts, _MARKS, rf"\1 {_JOINED}\2\3")
        return pc.split_pattern(pc.binary_join_element_wise(_JOINED, marked, ""), " ")

    def _values(self, parts: list[str]) -> list[bytes | bool]:
        if len(self.chunks) > _CACHED:
            self.chunks = {}
        values = list(map(self.chunks.get, parts))
        missing = [i for i, v in enumerate(values) if v is None]
        plain, other = [], []
        for i in missing:
            part = parts[i]
            if part.isalpha():
                plain.append(i)
            elif self.spaced and (not part or part[0].isspace() or part[-1].isspace()):
                values[i] = False
            else:
                other.append(i)
        for at in range(0, len(plain), _BATCH):
            some = plain[at : at + _BATCH]
            raw = "\n".join([parts[i] for i in some]).encode().decode("latin-1").split("\n")
            found = self.merger.encode_batch_fast([self.blank + x.translate(self.letters) for x in raw], add_special_tokens=False)
            for i, ids in zip(some, self._ids(found)):
                values[i] = ids
        shown = [parts[i] for i in other]
        if self.spaced:
            shown = [x[1:] if x[0] == _JOINED else f" {x}" for x in shown]
        for i, ids in zip(other, self.whole(shown)):
            values[i] = ids
        self.chunks.update([(parts[i], values[i]) for i in missing if len(parts[i]) <= _LONGEST])
        return values


def encoder(path: str) -> ChunkedEncoder:
    """The worker's encoder for a vocabulary file; its cache lives on while tasks ``keeps=path`` follow each other."""
    return resident(path, lambda: ChunkedEncoder(path))
