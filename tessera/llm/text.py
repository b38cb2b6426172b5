"""Words and their 64-bit hashes for a block of texts at once, in numpy.

Texts are handled as UTF-8 bytes. Every word class used here is decided by ASCII bytes alone (bytes of
0x80 and above always belong to words), so working on bytes gives exactly the words of the code points.
A word's hash is a polynomial over its lower-cased bytes, finished by an avalanche; equal words have
equal hashes, and different ones share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R = np.random.default_rng(20240607)
BYTE = _R.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
STEP = [U(int(x)) for x in _R.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters and digits: all but ASCII that is neither; after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


class Block:
    """Some texts: bytes, and where each begins (offsets has one more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self, kind: np.ndarray):
        """(byte begin, byte end, hash) of each word, and the index of the first word of each text (one more)."""
        data, n = self.data, len(self.data)
        solid = kind[data]
        if not n or not solid.any():
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(0, dtype=np.uint64), np.zeros(self.n + 1, dtype=np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        head = solid.copy()
        head[1:] &= ~solid[:-1] | edge[1:n]
        tail = solid.copy()
        tail[:-1] &= ~solid[1:] | edge[1:n]
        begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        size = end - begin
        low = LOWER[data[solid]]
        at = np.cumsum(size) - size
        place = np.arange(len(low)) - np.repeat(at, size)
        h = np.add.reduceat(BYTE[low] * powers(int(size.max()))[place], at)
        return begin, end, mix(h), np.searchsorted(begin, self.offsets)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow column (null: empty) in blocks of about limit bytes; a longer text is a block of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def grams(h: np.ndarray, first: np.ndarray, size: int):
    """Hashes of runs of size words, never over the end of a text; and the index of each text's first run (one more)."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    index = np.concatenate([[0], np.cumsum(count)])
    if not index[-1]:
        return np.zeros(0, dtype=np.uint64), index
    at = np.arange(index[-1]) + np.repeat(first[:-1] - index[:-1], count)
    g = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        g += h[at + j] * STEP[j]
    return mix(g), index
