"""Vectorised words and hashes over the bytes of an Arrow string batch (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.RandomState(20240607)
BYTE_CODE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: A-Z to a-z, other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:
    got = cache.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, np.uint64(base))
        got[0] = 1
        got = cache[base] = np.multiply.accumulate(got)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (64 bits to 64 bits, one to one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span raw[start:end]; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * _powers(BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of each row: starts, ends (bytes), row, and first (n+1: where each row's words begin)."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool = True):
        raw, self.offsets = text_bytes(column)
        self.raw = LOWER[raw] if lower else raw
        inside = is_word[self.raw]
        edge = np.empty(len(raw), bool)
        if len(raw):
            edge[0] = True
            np.not_equal(inside[1:], inside[:-1], out=edge[1:])
            cuts = self.offsets[:-1][self.offsets[:-1] < len(raw)]
            edge[cuts] = True
        at = np.flatnonzero(edge)
        upto = np.append(at[1:], len(raw))
        word = inside[at]
        self.starts, self.ends = at[word], upto[word]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and n+1 offsets by row; a row with 1 to k-1 words has one shingle, all its words."""
    h = words.hashes()
    first, n = words.first, np.diff(words.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + (np.arange(off[-1]) - off[row])
    length = np.minimum(n, k)[row]
    out = np.full(len(at), 0x51, np.uint64)
    for j in range(k):
        has = j < length
        out[has] = mix(out[has] * np.uint64(BASE) + h[at[has] + j])
    return mix(out + length.astype(np.uint64)), off
