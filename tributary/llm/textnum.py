"""Words of Arrow string columns as numpy arrays, without a Python object per text or word.

A word is a maximal run of bytes outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased, that is of ASCII
digits, letters and non-ASCII code points, and never crosses a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * K1
    h = h ^ (h >> np.uint64(29))
    h = h * K2
    return h ^ (h >> np.uint64(32))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 2 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with at most limit bytes together; a longer text comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """starts, lengths (bytes), hashes and first: the words of text k are [first[k], first[k + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        low = _LOWER[data]
        inside = _WORD[low]
        before = np.zeros(len(low) + 1, dtype=bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(low) + 1, dtype=bool)
        after[:-1] = inside
        after[offsets] = False  # a word that reaches a text's end stops there
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.lengths = np.flatnonzero(inside & ~after[1:]) + 1 - self.starts
        self.first = np.searchsorted(self.starts, offsets)
        self.low = low
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        n = len(self.starts)
        out = np.empty(n, dtype=np.uint64)
        if not n:
            return out
        widest = int(self.lengths.max())
        powers = np.cumprod(np.full(widest, 0x100000001B3, dtype=np.uint64))
        ends, i = np.cumsum(self.lengths), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
            lengths = self.lengths[i:j]
            at = np.cumsum(lengths) - lengths
            within = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            bytes_ = self.low[np.repeat(self.starts[i:j], lengths) + within]
            out[i:j] = np.add.reduceat((bytes_.astype(np.uint64) + np.uint64(1)) * powers[within], at)
            i = j
        return mix(out + self.lengths.astype(np.uint64))

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)
