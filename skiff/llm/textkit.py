"""Vectorised scans of UTF-8 text in Arrow batches: words, hashes of words and shingles.

Words are ``[^\\x20\\x09-\\x0D]+``. All arrays are numpy; a slice holds about ``SLICE`` bytes of
text (or one longer document), so the memory of a task does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 12)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents with at most ``most`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """The words of some documents: start, end (bytes) and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        before = np.ones(len(data), bool)
        before[1:] = space[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before[edge] = True
        self.start = np.flatnonzero(~space & before)
        after = np.ones(len(data), bool)
        after[:-1] = before[1:] | space[1:]
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        total = int(length.sum())
        begin = np.cumsum(length) - length
        inside = np.arange(total) - np.repeat(begin, length)
        index = inside + np.repeat(self.start, length)
        raw = self.data[index]
        if lower:
            raw = _LOWER[raw]
        value = _BYTE[raw] * powers(int(length.max()))[inside]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


_PLACE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | U(1)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word window; a document of 1 to k-1 words gives all of them as one."""
    n = len(hashes)
    doc, out = [], []
    if n >= k:
        value = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            value += hashes[j : n - k + 1 + j] * _PLACE[j]
        same = words.doc[: n - k + 1] == words.doc[k - 1 :]
        doc.append(words.doc[: n - k + 1][same])
        out.append(mix(value[same]))
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.count[short] > j
            value[has] += hashes[words.first[short][has] + j] * _PLACE[j + 32]
        doc.append(short)
        out.append(mix(value + words.count[short].astype(np.uint64)))
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(doc), np.concatenate(out)
