"""Words and shingles of whole Arrow columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; A-Z count as a-z.  The bytes of UTF-8 letters never equal these six,
so cutting bytes cuts characters right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one step of NumPy work takes at most, unless one text is longer.
STEP_BYTES = 512 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(BASE, k, 1 << 64))])
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, k, 1 << 64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column, not copied; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32) if at is not None and at.size else np.zeros(column.offset + 1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; every row falls into exactly one."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of some consecutive rows: ``hash``, byte ``start`` and ``end`` in the row's text, ``first`` word per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        begin = offsets[:-1] - base
        text = _LOWER[data[base : base + size]]
        _grow(size + 1)
        solid = ~_SPACE[text]
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets - base] = True  # a word never spans two rows
        before = np.empty(size, dtype=bool)
        starts = ends = np.zeros(0, dtype=np.int64)
        if size:
            before[0] = False
            before[1:] = solid[:-1]
            starts = np.flatnonzero(solid & (~before | edge[:-1]))
            after = np.empty(size, dtype=bool)
            after[-1] = False
            after[:-1] = solid[1:]
            ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers[:size], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _inverses[starts]
        self.hash = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.first = np.searchsorted(starts, np.append(begin, size))
        self.row = np.repeat(np.arange(len(begin)), np.diff(self.first))
        self.start, self.end = starts - begin[self.row], ends - begin[self.row]
        self.rows = len(begin)
        self._text, self._at = text, starts

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def lines(self) -> np.ndarray:
        """The first word of every line that has words; lines end at line feeds and rows."""
        line = np.concatenate([[0], np.cumsum(self._text == 10)])[self._at]
        return np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(self.row) != 0)])) if len(line) else line

    def sequences(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash of the words from each start up to its end, order included."""
        _grow(len(self.hash) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers[: len(self.hash)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid): the k words from every word on; not valid where the row ends before."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out[: n - j if j else n] += np.roll(self.hash, -j)[: n - j if j else n] * np.uint64(pow(0xDA942042E4DD58B5, j + 1, 1 << 64))
        valid = np.arange(n) + k <= self.first[1:][self.row] if n else np.zeros(0, dtype=bool)
        return mix(out), valid

    def whole(self, row: int) -> np.uint64:
        """One hash of a row's whole word sequence, for rows with fewer words than a shingle."""
        h = np.uint64(self.first[row + 1] - self.first[row])
        for w in self.hash[self.first[row] : self.first[row + 1]]:
            h = mix(np.array([h * np.uint64(0xDA942042E4DD58B5) + w], dtype=np.uint64))[0]
        return h


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct k-word shingles; fewer words than k make one; none make an empty set."""
    grams, valid = words.grams(k)
    for row in range(words.rows):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield np.array([words.whole(row)], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
