"""Operator 11: periodic runs of words, by Lyndon arrays on an ordered alphabet.

Words are what stands between white space (space, U+0009 to U+000D); a run is a stretch of words with smallest period q that no neighbour
extends, of at least EXPONENT periods and SHORTEST words. Each run has a root that is a Lyndon word in one of two orders of the words
(as numbered, and the reverse), and the root's first place in the run is followed by its next smaller suffix, one period on. So for
both orders the next smaller suffixes are found from left to right on a stack of previous smaller ones (lyndon_edges). How far two
suffixes agree is scanned word by word, but never twice: a comparison inside of a stretch that has matched earlier words takes its
outcome from there and goes on at that stretch's end, and a suffix below on the stack takes what is known through the one above. No suffix structures
and no hashes are used; words are numbered by sorting them.

Most text has no runs. A run's pairs of neighbouring words return within its period, so only zones where all pairs do, for long enough at some
power of two, are looked at; zones are found by sorting pairs, a run lies wholly in one zone, and none is missed.

Every document is one row in one task, read whole. Null and empty texts have no words. Words are compared byte by byte. Rows of one doc_id are
rows of their own. A doc_id that is no whole number comes out as null; only doc_id and text are read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import ship

from .arrays import slices
from .wordcodes import bounds, codes, dense

EXPONENT, SHORTEST = 4, 6
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

Run = tuple[int, int, int]


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (the text's length if there is none) and how many words both share. x: numbers from 0."""
    n, x = len(x), [*x, -1]
    after, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    reach = here = shift = 0  # what has matched furthest: x[here:reach] is x[here - shift:reach - shift]
    for i in range(1, n):
        j, same = i - 1, 0
        while True:
            if i < reach and j >= here:
                a, b = j - shift, i - shift
                known = shared[a] if after[a] == b else shared_before[b] if before[b] == a else 0
                same = max(same, min(known, reach - i))
            while x[i + same] == x[j + same]:
                same += 1
            if i + same > reach:
                reach, here, shift = i + same, i, i - j
            if x[i + same] > x[j + same]:
                before[i], shared_before[i] = j, same
                break
            after[j], shared[j] = i, same
            if before[j] < 0:
                break
            same = min(same, shared_before[j])
            j = before[j]
    return after, shared


def runs(x: list[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[Run]:
    """(start, length, period) of all runs of at least exponent (3 or more) periods and that many words, by start and period."""
    found, top = set(), max(x, default=0)
    for ordered in (x, [top - c for c in x]):
        ends: dict[int, int] = {}
        for i, (j, same) in enumerate(zip(*lyndon_edges(ordered), strict=True)):
            period = j - i
            if same < (exponent - 2) * period or ends.get(period, 0) >= j + same:
                continue
            ends[period] = j + same
            left = 0
            while left < i and x[i - left - 1] == x[j - left - 1]:
                left += 1
            if left + period + same >= max(shortest, exponent * period):
                found.add((i - left, left + period + same, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def zones(ids: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Disjoint stretches of the words of some rows that hold all of their runs whole. first: the rows' first words and one more in the end."""
    n = len(ids)
    if n < shortest:
        return []
    pairs, _ = dense(ids[:-1] * (int(ids.max()) + 1) + ids[1:])
    order = np.argsort(pairs, kind="stable")
    back = np.full(n, n, np.int64)  # how far back a pair stood last
    same = pairs[order][1:] == pairs[order][:-1]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    own = np.repeat(first[:-1], np.diff(first))  # each word's row begins there
    at = np.arange(n)
    back[at - back < own] = n
    ends = first[1:][np.diff(first) > 0] - 1
    back[ends] = n
    longest, found, most = int(np.diff(first).max()), [], 1
    breaks = np.flatnonzero(back > most)
    while True:
        need = max((exponent - 1) * (most // 2 + 1) - 1, shortest - 1 - most)
        if need > longest:
            break
        breaks = breaks[back[breaks] > most]
        k = np.flatnonzero(np.diff(breaks) - 1 >= need)
        found += zip(np.maximum(breaks[k] + 1 - most, own[breaks[k] + 1]).tolist(), (breaks[k + 1] + 1).tolist(), strict=True)
        most *= 2
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rows_runs(ids: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> dict[int, list[Run]]:
    """The runs of each row that has any, by the row's number."""
    found: dict[int, list[Run]] = {}
    for a, b in zones(ids, first, exponent, shortest):
        row = int(np.searchsorted(first, a, "right")) - 1
        here, _ = dense(ids[a:b])
        found.setdefault(row, []).extend((s + a - int(first[row]), n, q) for s, n, q in runs(here.tolist(), exponent, shortest))
    return {row: sorted(r, key=lambda x: (x[0], x[2])) for row, r in found.items() if r}


def kept_words(n: int, of: list[Run]) -> np.ndarray:
    """Of n words those that no run has after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in of:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.flatnonzero(np.cumsum(steps[:-1]) == 0)


def strongest(of: list[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then that of the shortest period."""
    best = None
    for run in of:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _exercise(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word stands where in the registered query: in every tenth row or so, by its id's checksum, the end repeats itself."""
    take = np.arange(first[-1])
    for k, doc in enumerate(ids):
        n = int(first[k + 1] - first[k])
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            take[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return take


def _words(column: pa.Array):
    """(first row, bytes, first bytes of words, bytes after them, rows' first words, words' numbers) of runs of rows."""
    for at, data, offsets in slices(column):
        begin, end, first = bounds(data, offsets, _WORD)
        yield at, data, begin, end, first, codes(data, begin, end - begin)[0]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FIELDS = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in SCHEMA.split(", ")])


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[memoryview]:
    """The rows' words joined by single spaces."""
    keep, out = _WORD[data], data.copy()
    if len(begin):
        inner = np.ones(len(begin), bool)
        inner[first[1:][np.diff(first) > 0] - 1] = False
        out[end[inner]] = 0x20
        keep[end[inner]] = True
    sizes = np.concatenate([[0], np.cumsum(end - begin + 1)])
    n = np.diff(first)
    lengths = sizes[first[1:]] - sizes[first[:-1]] - (n > 0)
    limits = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    joined = memoryview(out[keep].tobytes())
    return [joined[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)]


def _digests(exercise: bool):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, data, begin, end, first, ids in _words(batch.column(1)):
                own = docs[at : at + len(first) - 1]
                take = _exercise(own, first) if exercise else np.arange(first[-1])
                found = rows_runs(ids[take], first)
                moved = np.add.reduceat(np.concatenate([take != np.arange(len(take)), [False]]), first[:-1]) > 0
                moved &= np.diff(first) > 0
                texts = _texts(data, begin, end, first)
                rows = []
                for k, doc in enumerate(own):
                    of = found.get(k, [])
                    text = texts[k]
                    if of or moved[k]:
                        words = take[first[k] : first[k + 1]][kept_words(int(first[k + 1] - first[k]), of)]
                        shift = begin[first[k]]
                        raw = data[shift : end[first[k + 1] - 1]].tobytes()
                        text = b" ".join([raw[a:b] for a, b in zip((begin[words] - shift).tolist(), (end[words] - shift).tolist(), strict=True)])
                    best = strongest(of)
                    start, length, period = best or (None, None, None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in of)
                    rows.append((doc, len(of), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    return digest


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(0)
        for at, *_, first, ids in _words(batch.column(1)):
            rows = [(at + k, *r) for k, of in rows_runs(ids, first).items() for r in of]
            if rows:
                row, *rest = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "start", "length", "period"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(batch.num_columns - 1)
        texts: list[str | None] = [None] * len(rows)
        for at, data, begin, end, first, ids in _words(rows):
            for k, of in rows_runs(ids, first).items():
                words = first[k] + kept_words(int(first[k + 1] - first[k]), of)
                texts[at + k] = b" ".join([data[begin[w] : end[w]].tobytes() for w in words]).decode()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t if t is not None else r.as_py() for t, r in zip(texts, rows, strict=True)], pa.string())], names=batch.schema.names)


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run; ids of any type."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_listed, f"doc_id {kind}, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with all their columns; texts that have runs keep each run's first period only, their words joined by one space. Other texts stay as they are."""
    ship(docs.sparkSession)
    order = [c for c in docs.columns if c != "text"]
    rows = docs.select(*(docs[f"`{c}`"] for c in order), "text")
    return rows.mapInArrow(_short, rows.schema).select(*(f"`{c}`" for c in docs.columns))


def digested(docs: DataFrame, exercise: bool = False) -> DataFrame:
    """See SCHEMA: for each row the number of runs, the strongest one, and digests of the list of runs and of the text without what repeats.

    exercise: before that every tenth row or so is made to repeat itself from some word on, as the registered query wants it; a row without id is not.
    """
    ship(docs.sparkSession)
    return docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text").mapInArrow(_digests(exercise), SCHEMA)
