"""Operator 1: hierarchical multi-length packing.

Documents are routed to context-size tiers (the window, half of it and so on down to `floor`): whole windows of the largest size
are cut off first, and what remains goes to the smallest tier that holds it. Tiers are packed from long to short: a tier's
piece opens a window of its size, and the gap is filled with the longest fitting pieces of its own and shorter tiers.
Where long documents make up less than half of the ids, shorter ones are joined to long windows until these hold half. A gap that
no piece fits is closed with the start of a longer one; whole windows of very long documents are cut first, and a document
is cut MAX_CUTS times at most beside them, so a document of up to a window's ids is in three pieces at most. Full windows of a
tier are dealt to step groups in a snake over their attention cost, so that the groups of a tier cost about the same.

Each task packs what it reads, in pools of bounded size; nothing is shuffled, and no group grows with the corpus. Windows are
exactly full; only what is left of a task in the end, fewer ids than the floor, and a window that no document may be cut for are
sequences that have to be padded. Sequence ids are the partition's number and a count inside it, which a repeated task gives again.

Null and empty texts are the end token alone. Very long texts become many whole windows. Repeated rows are packed each on
its own. Documents of one length are taken in the order in which they are read, the last first. doc_id is a whole number or a text of
one; others and null are null. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import ship

from .tokens import encode

WINDOW = 1024
#: Tokens that a task holds before it packs them.
POOL = 1 << 20
#: Sequences of one tier that make up a training step.
STEP = 8
#: The smallest tier.
FLOOR = 256
#: The share of ids that long windows hold at least, where there are so many.
LONG_SHARE = 0.5
#: Cuts of a document beside those at whole windows.
MAX_CUTS = 2
#: Fewer ids are cut off only where nothing else closes a gap.
MIN_CUT = 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Piece:
    """A run of a document's ids. cuts: a list of one number, the cuts that the document can still take, which its pieces share."""

    __slots__ = ("doc", "ids", "start", "total", "cuts")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int, cuts: list[int]):
        self.doc, self.ids, self.start, self.total, self.cuts = doc, ids, start, total, cuts

    def cut(self, at: int) -> tuple[Piece, Piece]:
        self.cuts[0] -= 1
        return Piece(self.doc, self.ids[:at], self.start, self.total, self.cuts), Piece(self.doc, self.ids[at:], self.start + at, self.total, self.cuts)


def pieces_of(doc, ids: np.ndarray, window: int = WINDOW) -> list[Piece]:
    """Whole windows and what remains."""
    cuts = [MAX_CUTS + (len(ids) - 1) // window]
    return [Piece(doc, ids[at : at + window], at, len(ids), cuts) for at in range(0, len(ids), window)]


class Pool:
    """Pieces by their length; the numbers of which lengths there are any stand as bits in one integer."""

    def __init__(self, pieces: list[Piece], window: int):
        self.rows: list[list[Piece]] = [[] for _ in range(window + 1)]
        self.held, self.ids = 0, 0
        for p in pieces:
            self.add(p)

    def add(self, p: Piece) -> None:
        n = len(p.ids)
        self.rows[n].append(p)
        self.held |= 1 << n
        self.ids += n

    def longest(self, most: int) -> int:
        """The length of the longest piece of at most so many ids; 0 if there is none."""
        return max((self.held & ((2 << most) - 1)).bit_length() - 1, 0)

    def take(self, n: int) -> Piece:
        p = self.rows[n].pop()
        if not self.rows[n]:
            self.held &= ~(1 << n)
        self.ids -= n
        return p

    def cuttable(self, gap: int) -> Piece | None:
        """A piece of more than gap ids whose document can still be cut: the longest one."""
        above = self.held >> (gap + 1) << (gap + 1)
        while above:
            n = above.bit_length() - 1
            row = self.rows[n]
            for k in range(len(row) - 1, max(len(row) - 9, -1), -1):  # documents that were cut often are few
                if row[k].cuts[0] > 0:
                    row[k], row[-1] = row[-1], row[k]
                    return self.take(n)
            above ^= 1 << n
        return None

    def window(self, size: int) -> tuple[list[Piece], int]:
        """Pieces of size ids, and the gap that is left if no piece may be cut for it."""
        own, gap = [], size
        while gap:
            n = self.longest(gap)
            fits = n and (gap == n or gap - n >= MIN_CUT or self.held >> (gap - n) & 1)
            p = None if fits else self.cuttable(gap)
            if p is not None:
                head, rest = p.cut(gap)
                own.append(head)
                self.add(rest)
                return own, 0
            if not n:
                break
            own.append(self.take(n))
            gap -= n
        return own, gap


def pack(pieces: list[Piece], window: int = WINDOW, last: bool = True, floor: int = FLOOR, share: float = LONG_SHARE) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(tier, its pieces) of windows, and the pieces that wait for more. Every piece has at most window ids. last: nothing waits, and what fills no window is one of its own."""
    pool, full, waiting = Pool(pieces, window), [], []
    wanted = share * pool.ids
    size, made = window, 0
    while pool.ids and size >= min(floor, window):
        opens = pool.longest(size) > size // 2 or size <= floor or (size == window and made < wanted)
        if pool.ids < size or not opens:
            size //= 2
            continue
        own, gap = pool.window(size)
        if not own:  # what is left is longer, and no document may be cut again
            size //= 2
            continue
        made += size - gap
        if not gap:
            full.append((size, own))
        else:
            waiting += own
    rest = waiting + [p for row in pool.rows for p in row]
    if last:
        pool, rest = Pool(rest, window), []
        while pool.ids:
            own, gap = [], window
            while n := pool.longest(gap):
                own.append(pool.take(n))
                gap -= n
            full.append((window, own))
    return full, rest


def balanced(windows: list[tuple[int, list[Piece]]], step: int = STEP) -> list[int]:
    """For each window the number of its step group: windows of one tier, dealt in a snake by the sum of squared lengths."""
    groups, base = [0] * len(windows), 0
    by_tier: dict[int, list[int]] = {}
    for k, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(k)
    for tier in sorted(by_tier, reverse=True):
        own = sorted(by_tier[tier], key=lambda k: -sum(len(p.ids) ** 2 for p in windows[k][1]))
        n = -(-len(own) // step)
        for i, k in enumerate(own):
            lap, at = divmod(i, n)
            groups[k] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return groups


def _rows(windows: list[tuple[int, list[Piece]]], sequence: int, group: int, step: int) -> tuple[pa.RecordBatch, int, int]:
    groups = balanced(windows, step)
    rows = []
    for k, (tier, own) in enumerate(windows):
        at = 0
        for p in own:
            rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, sequence + k, at, tier, group + groups[k]))
            at += len(p.ids)
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW), sequence + len(windows), group + max(groups, default=-1) + 1


def packer(window: int, end: int, pool: int, step: int, floor: int, vocabulary: str | None, ranks: str | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        sequence = group = base
        held: list[Piece] = []
        tokens = 0
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, vocabulary, ranks), strict=True):
                ids = np.append(ids, np.uint32(end))
                held += pieces_of(doc, ids, window)
                tokens += len(ids)
                if tokens >= pool:
                    full, held = pack(held, window, False, floor)
                    out, sequence, group = _rows(full, sequence, group, step)
                    tokens = sum(len(p.ids) for p in held)
                    yield out
        out, sequence, group = _rows(pack(held, window, True, floor)[0], sequence, group, step)
        yield out

    return task


def packed(docs: DataFrame, window: int = WINDOW, end: int = 0, pool: int = POOL, step: int = STEP, floor: int = FLOOR, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece of a document's ids; see SCHEMA. window, floor: powers of two. vocabulary: a tokenizers file (None: the public one), ranks: the same as a tiktoken file, if there is one."""
    if window & (window - 1) or floor & (floor - 1):
        raise ValueError("window and floor must be powers of two")
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").mapInArrow(packer(window, end, pool, step, floor, vocabulary, ranks), SCHEMA)
