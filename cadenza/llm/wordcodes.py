"""Numpy helpers for the words of whole Arrow batches: where they stand, and a number for each, equal for equal words only.

Nothing is hashed: words are compared eight bytes at a time by sorting. All work is on UTF-8 bytes; word characters are given as a table
of 256 entries that has all bytes from 0x80 on as one kind, so that no character is cut.
"""

from __future__ import annotations

import numpy as np

#: Words longer than this are told apart one by one.
LONG_WORD = 64
_MASK = np.array([0] + [((1 << 64) - 1) >> (64 - 8 * k) << (64 - 8 * k) for k in range(1, 9)], dtype=np.uint64)


def bounds(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes of words, bytes after their last ones, for each row the number of its first word and one more in the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | starts_row[1:-1]
    ends[:-1] &= ~inside[1:] | starts_row[1:-1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each value among the distinct ones, and how many these are."""
    if not len(values):
        return np.zeros(0, np.int64), 0
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), np.int64)
    new[1:] = values[order][1:] != values[order][:-1]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def codes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each word, equal for equal words, and how many there are."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))
    ranks, n = dense(eights[begin].astype(np.uint64) & _MASK[np.minimum(size, 8)])
    out, base = ranks * 9 + np.minimum(size, 8), n * 9
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest) and at < LONG_WORD:
        left = size[rest] - at
        ranks, n = dense(eights[begin[rest] + at].astype(np.uint64) & _MASK[np.minimum(left, 8)])
        ranks, n = dense(out[rest] * n + ranks)
        out[rest] = base + ranks * 9 + np.minimum(left, 8)
        base, at, rest = base + n * 9, at + 8, rest[left > 8]
    known: dict[tuple[int, bytes], int] = {}
    for k in rest:
        word = (int(out[k]), text[begin[k] + at : begin[k] + size[k]].tobytes())
        out[k] = base + known.setdefault(word, len(known))
    return dense(out)
