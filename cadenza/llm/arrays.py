"""Numpy helpers for text inside tasks: words and word shingles of whole Arrow batches as 64-bit hashes.

All of them work on UTF-8 bytes. Separators are ASCII, so no character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Bytes of text that are worked on at once.
SLICE = 2 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _C2
    h = (h ^ (h >> _U(27))) * _C3
    return h ^ (h >> _U(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows with about SLICE bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each maximal run of bytes other than white space, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    text = _LOWER[data] if lower else data
    word = ~_SPACE[data]
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | starts_row[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | starts_row[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - begin
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), np.uint64, padded, strides=(1,))
    hashes = mix((eights[begin] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _C1)
    rest = np.flatnonzero(size > 8)
    at = 8
    while len(rest) and at < LONG_WORD:
        hashes[rest] = mix(hashes[rest] * _C1 + (eights[begin[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    for k in rest:
        hashes[k] = xxhash.xxh64_intdigest(text[begin[k] : end[k]].tobytes())
    return hashes, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of width words inside a row (a row of fewer words: all of them as one), and the rows' limits as for words()."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    limits = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(limits[-1], np.uint64)
    if len(hashes) >= width:
        run = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            run = run * _C1 + hashes[k : len(hashes) - width + 1 + k]
        run = mix(run)
        long = np.flatnonzero(n >= width)
        take = np.repeat(first[long] - limits[long], counts[long])
        at = np.repeat(n >= width, counts)
        where = np.flatnonzero(at)
        out[where] = run[where + take]
    for k in range(1, width):
        rows = np.flatnonzero(n == k)
        if len(rows):
            run = hashes[first[rows]]
            for i in range(1, k):
                run = run * _C1 + hashes[first[rows] + i]
            out[limits[rows]] = mix(run + _U(k * int(_C3) & (1 << 64) - 1))
    return out, limits


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its text, lower-cased A-Z."""
    for _, data, offsets in slices(column):
        found, limits = shingles(*words(data, offsets), width)
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            if b - a < 2:
                yield found[a:b]
            else:
                own = np.sort(found[a:b])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
