"""Token ids on disk: static range asymmetric numeral coding in independent interleaved blocks.

One frequency table, counted over all ids, serves every block. A block holds up to ``BLOCK`` ids,
dealt over lanes that are coded side by side; it starts with the lanes' states, so any block can
be decoded alone. A file's index holds, for each block, where it begins, how many ids it has, the
checksum of its bytes, and the checkpoint of its first id among the file's ids.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

BITS, LOW, BLOCK, MAGIC = 20, 1 << 31, 1 << 18, b"FSRANS1\n"


def quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, 1 at least where a count is positive."""
    counts = counts.astype(np.float64)
    used = counts > 0
    total = 1 << BITS
    if used.sum() > total:
        raise ValueError("more distinct ids than the table has places")
    if not used.any():
        return np.zeros(len(counts), np.int64)
    freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    spare = int(total - freq.sum())
    if spare > 0:
        freq[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        take = min(int(freq[i]) - 1, -spare)
        freq[i] -= take
        spare += take
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = 1 << max(0, min(10, (n // 64).bit_length() - 1))
        f, c = self.freq[ids], self.start[ids]
        if n and not f.all():
            raise ValueError("an id that the table doesn't hold")
        limit = f << np.uint64(63 - BITS)  # (LOW >> BITS) << 32, times the frequency
        state = np.full(lanes, LOW, np.uint64)
        words = []
        for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
            k = min(lanes, n - at)
            x, ff = state[:k], f[at : at + k]
            full = np.flatnonzero(x >= limit[at : at + k])
            if len(full):
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x[full] >>= np.uint64(32)
            q = x // ff
            state[:k] = (q << np.uint64(BITS)) + (x - q * ff) + c[at : at + k]
        body = np.concatenate(words[::-1]).tobytes() if words else b""
        return struct.pack("<II", n, lanes) + state.astype("<u8").tobytes() + body

    def decode(self, block: bytes) -> np.ndarray:
        n, lanes = struct.unpack_from("<II", block)
        state = np.frombuffer(block, "<u8", lanes, 8).astype(np.uint64)
        words = np.frombuffer(block, "<u4", offset=8 + 8 * lanes).astype(np.uint64)
        out, used, mask = np.empty(n, np.uint32), 0, np.uint64((1 << BITS) - 1)
        for at in range(0, n, lanes):
            k = min(lanes, n - at)
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            out[at : at + k] = s
            x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.start[s]
            empty = np.flatnonzero(x < LOW)
            if len(empty):
                x[empty] = (x[empty] << np.uint64(32)) | words[used : used + len(empty)]
                used += len(empty)
            state[:k] = x
        if used != len(words):
            raise ValueError("a block with words left over")
        return out


def table_bytes(freq: np.ndarray) -> bytes:
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def table_from(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def file_bytes(coder: Coder, table_crc: int, docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """A file: magic, blocks, index (JSON, compressed), then the index's size and checksum."""
    out, index, at = [MAGIC], [], len(MAGIC)
    for first in range(0, len(ids), BLOCK):
        block = coder.encode(ids[first : first + BLOCK])
        index.append([at, len(block), first, min(BLOCK, len(ids) - first), zlib.crc32(block)])
        out.append(block)
        at += len(block)
    footer = zlib.compress(json.dumps({"table": table_crc, "blocks": index, "docs": docs}).encode(), 6)
    return b"".join([*out, footer, struct.pack("<II", len(footer), zlib.crc32(footer))])


def read_index(data: bytes) -> dict:
    size, crc = struct.unpack("<II", data[-8:])
    footer = data[-8 - size : -8]
    if not data.startswith(MAGIC) or zlib.crc32(footer) != crc:
        raise ValueError("not a whole file of coded ids")
    return json.loads(zlib.decompress(footer))


def read_block(coder: Coder, data: bytes, entry: list[int]) -> np.ndarray:
    """The ids of one block of a file, by its entry of the index."""
    at, size, _, n, crc = entry
    block = data[at : at + size]
    if zlib.crc32(block) != crc:
        raise ValueError("a block's checksum is wrong")
    ids = coder.decode(block)
    if len(ids) != n:
        raise ValueError("a block of another length")
    return ids
