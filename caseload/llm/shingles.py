"""Word shingles of whole texts, vectorised over the bytes of many documents at once.

Words are maximal runs of bytes other than white space (``\\x20``, ``\\x09``-``\\x0D``), with A-Z in
lower case. In UTF-8 those bytes never occur inside another character, so bytes suffice. A word
is hashed as a polynomial modulo 2^64, a shingle as a weighted sum of word hashes; both are mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (a longer document is handled alone).
BLOCK = 1 << 20
#: The same where a block's arrays take many times its bytes, in every Python worker.
SMALL_BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WEIGHTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                     0x165667B19E3779F9], dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null rows are empty."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(rows, max(first + 1, end))
        yield first, end
        first = end


class Hasher:
    """Word and shingle hashes; keeps the powers it needs."""

    def __init__(self, words: int = 5):
        self.words = words
        self.powers = self.inverses = np.ones(1, np.uint64)
        table = np.arange(256, dtype=np.uint64) + np.uint64(1)
        table[65:91] += np.uint64(32)
        self.value = table
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * SMALL_BLOCK, min(2 * len(self.powers), 2 * BLOCK))
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all rows, and each row's offsets in them."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._grow(n + 1)
        space = self.space[data]
        edge = np.zeros(n + 1, bool)  # a row begins or ends before this byte
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = space[:-1]
        starts = np.flatnonzero(~space & (before | edge[:n]))
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = space[1:]
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.inverses[starts])
        return hashes, np.searchsorted(starts, offsets)

    def shingles_of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each row."""
        words, at = self.words_of(data, offsets)
        k = self.words
        n = len(words) - k + 1
        if n > 0:
            grams = np.zeros(n, np.uint64)
            for i in range(k):
                grams += words[i:i + n] * _WEIGHTS[i]
            grams = mix(grams)
        for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
            if end - first >= k:
                yield np.unique(grams[first:end - k + 1])
            elif end > first:  # fewer words: the whole sequence is the one shingle
                few = np.uint64(end - first) + (words[first:end] * _WEIGHTS[:end - first]).sum(dtype=np.uint64)
                yield mix(np.array([few], np.uint64))
            else:
                yield np.empty(0, np.uint64)
