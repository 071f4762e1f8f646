"""Words, word hashes and n-gram hashes of whole Arrow text columns, vectorised over their UTF-8 bytes.

Texts are never turned into Python strings here: an Arrow string column is one byte
buffer with offsets, which is worked through in slices of about a quarter of a megabyte. A
longer text is cut between words where bytes are scrambled, so beside the text itself it takes
32 bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
#: Bytes that are scrambled at once.
PIECE = 1 << 21

#: Word bytes: ASCII digits and letters, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
NON_SPACE = _SPACE

_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def lean(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives unused memory back: it will be used again."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not every C library has it
            pass

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for b in (_BASE, _INVERSE):
            x = np.full(max(n, SLICE + 4096), b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers = (made[0], made[1])
    return _powers


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, wide, n + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags that don't cross a text's edge."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1] | edge[1:n]
    last[:-1] &= ~flag[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def fold(buf: np.ndarray, latin: bool) -> np.ndarray:
    """Lower case of A-Z, and with ``latin`` of the capitals from À to Þ."""
    low = LOWER[buf]
    if latin and len(buf) > 1:
        at = np.flatnonzero(buf[:-1] == 0xC3) + 1
        b = low[at]
        low[at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return low


def word_hashes(buf: np.ndarray, offsets: np.ndarray, latin: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of these texts: text number, 64-bit hash, start and end byte."""
    if len(buf) > PIECE:
        parts = []
        for a, b in _pieces(buf):
            i = int(np.searchsorted(offsets, a, side="right")) - 1
            j = int(np.searchsorted(offsets, b))
            doc, h, s, e = _word_hashes(buf[a:b], np.clip(offsets[i : j + 1], a, b) - a, latin)
            parts.append((doc + i, h, s + a, e + a))
        return tuple(np.concatenate(x) for x in zip(*parts))
    return _word_hashes(buf, offsets, latin)


def _word_hashes(buf: np.ndarray, offsets: np.ndarray, latin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = runs(WORD[buf], offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    n = len(buf)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[fold(buf, latin)] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return np.searchsorted(offsets, starts, side="right") - 1, hashes, starts, ends


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end between words, however long a word is."""
    a = 0
    while a < len(buf):
        b = min(len(buf), a + PIECE)
        while b < len(buf):
            gap = np.flatnonzero(~WORD[buf[b : b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(len(buf), b + 4096)
        yield a, b
        a = b


def hash_word(word: str) -> np.uint64:
    """The hash that :func:`word_hashes` gives this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[1][0]


def gram_hashes(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word's number and hash of each run of ``n`` words within a text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(g[at])


class HashSet:
    """Fast membership of 64-bit hashes: a bitmap that settles most, then a sorted search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, np.uint64))
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.values))))) + 5)
        self.mask = np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.values & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of members, and each one's place among the sorted values."""
        at = np.flatnonzero(self.bitmap[h & self.mask])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[place] == h[at]
        return at[ok], place[ok]
