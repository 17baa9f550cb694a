"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are folded
to a-z before hashing and nothing else is folded.  Words are told apart by a
64-bit hash of their bytes.  Work goes in slices of about ``SLICE`` bytes of
text, so memory stays bounded however large an Arrow batch is; a longer text is
a slice of its own, in which the tables of powers go no further than ``SLICE`` bytes or the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SEPARATORS = b" \t\n\x0b\x0c\r"
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed only."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_KEY = constants(256, 11)[_FOLD]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = down = np.ones(0, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE + 1)
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                table = np.full(size, base, _U)
                table[0] = 1
                setattr(cls, name, np.cumprod(table))
        return cls.up[:n], cls.down[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about limit bytes."""
    raw, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """Word hashes of a slice: ``hash``, ``doc`` (row in the slice) and ``bounds`` (first word of each row).

    Words are runs of the bytes that ``is_word`` marks.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD):
        n, rows = len(raw), len(offsets) - 1
        self.start = self.end = np.zeros(0, np.int64)
        self.hash = np.zeros(0, _U)
        if n:
            inside = is_word[raw]
            edge = np.zeros(n + 1, bool)  # a row's first byte starts a word even after another row's word
            edge[offsets] = True
            first = inside & edge[:n]
            first[1:] |= inside[1:] & ~inside[:-1]
            first[0] |= inside[0]
            last = inside & edge[1:]
            last[:-1] |= inside[:-1] & ~inside[1:]
            last[-1] |= inside[-1]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
            self.hash = np.zeros(len(self.start), _U)
            low = 0
            while low < len(self.start):  # runs of words of about SLICE bytes, so that powers and sums stay small
                at = self.start[low]
                high = max(low + 1, int(np.searchsorted(self.end, at + SLICE, "right")))
                part = raw[at : self.end[high - 1]]
                up, down = _Powers.get(len(part) + 1)
                sums = np.zeros(len(part) + 1, _U)
                np.cumsum(_BYTE_KEY[part] * up[: len(part)], out=sums[1:])
                a, b = self.start[low:high] - at, self.end[low:high] - at
                self.hash[low:high] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
                low = high
        self.bounds = np.searchsorted(self.start, offsets).astype(np.int64)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(rows), self.counts)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, row after row, and the first of each row.

    A row of 1 to k - 1 words gives its whole sequence as one shingle.
    """
    keys = constants(k, 23)
    n = len(words.hash)
    total = np.zeros(n, _U)
    for j in range(min(k, n)):
        total[: n - j] += words.hash[j:] * keys[j]
    ends = words.bounds[1:]
    whole = np.arange(n) + k <= np.repeat(ends, words.counts)
    for row in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        a, b = words.bounds[row], words.bounds[row + 1]
        total[a] = np.sum(np.append(words.hash[a:b] * keys[: b - a], _U((int(b - a) * 0xA0761D6478BD642F) & (1 << 64) - 1)), dtype=_U)
        whole[a] = True
    per_row = np.where(words.counts >= k, words.counts - k + 1, (words.counts > 0).astype(np.int64))
    return mix64(total[whole]), np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, raw, offsets in slices(column):
        hashes, bounds = shingles(Words(raw, offsets), k)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[a:b])


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each row."""
    counts = []
    for _, raw, offsets in slices(column):
        inside = np.append(_IS_WORD[raw], False)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[offsets[:-1]] |= inside[offsets[:-1]]
        total = np.concatenate([[0], np.cumsum(first[:-1])])
        counts.append(total[offsets[1:]] - total[offsets[:-1]])
    return np.concatenate(counts) if counts else np.zeros(0, np.int64)
