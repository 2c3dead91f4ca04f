"""Operator 13: bytes that repeat, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Such strings are brought together and compared like this:

1. Pieces. Each string of LENGTH bytes has an anchor, the run of CORE bytes in it with the smallest hash, so that equal strings have equal anchors at
   equal places. A piece is a maximal stretch in which successive strings have one anchor: its core, and up to LENGTH - CORE bytes on both sides. Pieces are
   rows without text: where they are, and hashes of the core and of the whole piece.
2. Classes. Pieces whose core stands nowhere else hold nothing that repeats. Pieces that are equal as a whole are counted and stand once from then on: all that they cover repeats.
   Others with the same core are a class, and their text is read again.
3. Expansion. Tasks own ranges of classes and work on some at a time: the pieces' bytes are put in suffix order, with the core as one symbol. From the transform, intervals of
   suffixes that begin alike are expanded backwards, breadth first by one symbol a round: an interval's end that was not known before is where the common prefix of two
   neighbours has just that length. This stops at the length that a string of LENGTH bytes has in symbols; neighbours still not told apart share it.
4. Hot classes. A class of more than HOT different pieces is cut: strings of it whose anchor lies in the same block of places share more than the core, namely all bytes
   between the block's first string's end and its last one's start, and this longer core deals them into smaller classes. Blocks of the last level hold one place, where core and string are one.
5. The spans that are found are gathered by document and taken out of its text.

All of it is exact but for equal 64-bit hashes of the cores and, within one core, of the pieces; in step 3 cores are compared as bytes.

Null texts count as empty. Nothing crosses documents. Rows of one doc_id are documents of their own, whose texts repeat in each other; documents are told apart by doc_id, whatever its type, and a
hash of their text. A doc_id that is no whole number comes out as null. Very long texts are read whole. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import release, ship

from .arrays import mix, slices
from .shared import discard, small, stored

LENGTH, CORE = 400, 200
#: A class with more different pieces is cut.
HOT = 1024
#: Sizes of blocks of places by level; the first holds all places, the last one.
BLOCKS = (256, 32, 4, 1)
#: Symbols that are put in suffix order at once, unless one class has more.
SYMBOLS = 1 << 19
#: Documents whose lists of pieces or spans may be broadcast.
LISTS = 100_000

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width bytes."""
    power, span, part, out, have = 0x9E3779B97F4A7C15, 1, _BYTE[data], None, 0
    while True:
        if width & span:
            if out is None:
                out = part
            else:
                n = len(part) - have
                out = out[:n] * _U(power) + part[have:]
            have += span
        if have == width:
            return mix(out[: max(len(data) - width + 1, 0)])
        part = part[:-span] * _U(power) + part[span:]
        power, span = power * power & (1 << 64) - 1, 2 * span


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each run of width of them."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - width + span], values[width - span :]) if span < width else values


def anchors(data: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, place of the anchor) of each piece of a text of at least length bytes. Of equal hashes the first counts."""
    hashes = grams(data, core)
    keys = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    at = (smallest(keys, length - core + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return start, np.diff(np.append(start, len(at))), at[start]


def core_of(anchor: int, place: int, size: int, length: int = LENGTH, core: int = CORE) -> tuple[int, int]:
    """The bytes that all strings share whose anchor lies in the block of that size around place: from, to."""
    low = place // size * size
    return anchor - low, anchor - min(low + size - 1, length - core) + length


def blocks(start: int, count: int, anchor: int, size: int) -> Iterator[tuple[int, int]]:
    """A piece's strings cut where their anchor's place passes into another block: (first string, number)."""
    end = start + count
    while start < end:
        n = min(end - start, (anchor - start) % size + 1)
        yield start, n
        start += n


def _digest(data: memoryview) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_PIECE = "start int, count int, anchor int, core long, content long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, text -> name and the text's pieces."""
    for batch in batches:
        for at, data, offsets in slices(batch.column(1)):
            rows, columns = [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if b - a < LENGTH:
                    continue
                own = data[a:b]
                start, count, anchor = anchors(own)
                raw, hashes = memoryview(own.tobytes()), grams(own, CORE)[anchor]
                content = [_digest(raw[s : s + n + LENGTH - 1]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                rows.append(np.full(len(start), at + k))
                columns.append((start, count, anchor, hashes.view(np.int64), np.array(content, np.int64)))
            if rows:
                found = [np.concatenate(c) for c in zip(*columns, strict=True)]
                name = batch.column(0).take(pa.array(np.concatenate(rows)))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([name, *(pa.array(c).cast(t) for c, t in zip(found, kinds, strict=True))], ["name", "start", "count", "anchor", "core", "content"])
    release()


def _recut(size: int):
    """name, text, list of pieces with their weights -> the pieces cut into blocks of that size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, pieces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = memoryview((text or "").encode())
                for p in pieces:
                    for start, n in blocks(p["start"], p["count"], p["anchor"], size):
                        a, b = core_of(p["anchor"], p["anchor"] - start, size)
                        rows.append((name, start, n, p["anchor"], _digest(raw[a:b]), _digest(raw[start : start + n + LENGTH - 1]), p["weight"]))
            if rows:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "start", "count", "anchor", "core", "content", "weight"])

    return cut


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, text, list of pieces -> each piece with its bytes."""
    kinds = [("start", pa.int32()), ("count", pa.int32()), ("anchor", pa.int32()), ("core", pa.int64()), ("weight", pa.int64())]
    for batch in batches:
        rows = []
        for name, text, pieces in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw = (text or "").encode()
            rows += [(name, *(p[k] for k, _ in kinds), raw[p["start"] : p["start"] + p["count"] + LENGTH - 1]) for p in pieces]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, *(t for _, t in kinds), pa.binary()], strict=True)], ["name", *(k for k, _ in kinds), "bytes"])


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of x in the order of their first depth symbols (numbers from 0, fewer than 2^15), and each suffix's place in it. x is followed by zeros."""
    n = len(x)
    bits = max(int(n).bit_length(), 15)
    rank, have, per = x.astype(np.int64), 1, 4
    width = 15
    while True:
        padded = np.concatenate([rank, np.zeros(per * have, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(per):
            key = key << width | padded[k * have : k * have + n]
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        new = np.cumsum(new)  # from 1: a suffix that ends early comes first
        have *= per
        if have >= depth or new[-1] == n:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        rank = np.empty(n, np.int64)
        rank[order] = new
        width = bits
        per = max(2, 63 // bits)


def common_prefixes(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in order, depth for depth or more; a 0 in the end. 0 ends strings: prefixes that go on after one count as depth.

    order: of suffixes by at least depth symbols.
    """
    n = len(x)
    last = x[order - 1]  # the transform
    by = np.argsort(last, kind="stable")
    image = np.empty(n, np.int64)
    image[by] = np.arange(n)  # where the suffix longer by one symbol is
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = last[by][1:] == last[by][:-1]
    after[by[:-1][same]], before[by[1:][same]] = by[1:][same], by[:-1][same]
    out = np.full(n + 1, depth, np.int16)
    out[0] = 0
    low, high = np.array([0]), np.array([n])
    open_ = np.ones(n + 1, bool)
    open_[0] = False
    for known in range(depth):
        size = high - low
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(low - first, size)
        ends = after[at] >= np.repeat(high, size)
        begins = before[at] < np.repeat(low, size)
        if known:
            inside = last[at] != 0
            ends &= inside
            begins &= inside
        low, high = np.sort(image[at[begins]]), np.sort(image[at[ends]]) + 1
        new = open_[high]
        low, high = low[new], high[new]
        if not len(high):
            break
        out[high], open_[high] = known, False
    out[n] = 0
    return out


def repeated(pieces: list[tuple[bytes, int, int, int]]) -> list[np.ndarray]:
    """For each piece (bytes, core from, core to, number of strings; those of one class have equal cores): which strings, by their first byte, stand in another piece or twice in one."""
    cores: dict[bytes, int] = {}
    parts, starts, limits, n = [], [], [], 0
    for raw, a, b, _ in pieces:
        own = np.frombuffer(raw, np.uint8).astype(np.int16)
        core = 257 + cores.setdefault(raw[a:b], len(cores))
        parts += [own[:a] + 1, np.array([core], np.int16), own[b:] + 1, np.zeros(1, np.int16)]
        starts.append(n)
        limits.append(LENGTH - (b - a) + 1)
        n += len(raw) - (b - a) + 2
    x, depth = np.concatenate(parts), max(limits)
    order, place = suffix_order(x, depth)
    shared = common_prefixes(x, order, depth)
    out = []
    for start, limit, (_, _, _, count) in zip(starts, limits, pieces, strict=True):
        at = place[start : start + count]
        out.append(np.maximum(shared[at], shared[at + 1]) >= limit)
    return out


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their bytes, classes together -> name and first byte and end of stretches of strings that repeat, of pieces of weight 1."""
    held: list[tuple] = []
    symbols, core, size = 0, None, 0

    def done(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        found = repeated([(r[5], *r[6], r[2]) for r in rows])
        names, first, end = [], [], []
        for (name, start, _, _, weight, *_), hit in zip(rows, found, strict=True):
            if weight > 1:
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            names += [name] * (len(edges) // 2)
            first += (start + edges[::2]).tolist()
            end += (start + edges[1::2] - 1 + LENGTH).tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(first, pa.int32()), pa.array(end, pa.int32())], ["name", "from", "to"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for name, start, count, anchor, own, weight, level, raw in zip(*columns, strict=True):
            if (own, level) != core:
                if symbols >= SYMBOLS:
                    yield done(held, batch.schema.field(0).type)
                    held, symbols = [], 0
                core = (own, level)
            size = BLOCKS[level]
            a, b = core_of(anchor, anchor - start, size)
            held.append((name, start, count, anchor, weight, raw, (a - start, b - start)))
            symbols += len(raw) - (b - a) + 2
    if held:
        yield done(held, batch.schema.field(0).type)
    release()


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, list of spans -> see SCHEMA, and the kept bytes."""
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_py()
            raw = b"" if raw is None else raw.encode()
            kept, at, n_spans = [], 0, 0
            if spans.is_valid:
                own = spans.values
                first, end = own.field(0).to_numpy(), own.field(1).to_numpy()
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
                n_spans = len(new)
                for a, b in zip(first[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True):
                    kept.append(raw[at:a])
                    at = b
            kept = b"".join([*kept, raw[at:]])
            rows.append((doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _taken(batches):
        yield batch.select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _named(docs: DataFrame) -> DataFrame:
    """name (what tells documents apart), doc_id, text."""
    name = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of")).alias("name")
    return docs.select(name, "doc_id", "text")


def _known(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """texts with what lists have for their name."""
    lists = lists.withColumnRenamed("name", "of")
    return texts.join(lists, texts["name.id"].eqNullSafe(F.col("of.id")) & (texts["name.of"] == F.col("of.of")), how)


def _with_text(docs: DataFrame, pieces: DataFrame, fields: list[str]) -> DataFrame:
    """name, text and the list of its pieces, once for each document that has any. Broadcast is the list where it is small."""
    lists = stored(pieces.groupBy("name").agg(F.collect_list(F.struct(*fields)).alias("pieces")), "repeats-lists")
    return _known(_named(docs), small(lists, LISTS), "inner").select("name", "text", "pieces")


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """name (doc_id and a hash of the text), from, to: stretches of bytes that repeat, overlapping ones too."""
    ship(docs.sparkSession)
    name = _named(docs).schema["name"].dataType.simpleString()
    rows = stored(_named(docs).select("name", "text").mapInArrow(_cut, f"name {name}, {_PIECE}").withColumn("weight", F.lit(1).cast("long")), "repeats-pieces")
    out = None
    for level in range(len(BLOCKS)):
        twice = stored(rows.groupBy("core").agg(F.sum("weight").alias("n")).where("n > 1").select("core"), "repeats-cores")
        some = stored(rows.join(small(twice), "core", "left_semi"), "repeats-some")
        discard(rows)
        discard(twice)
        one = F.struct("name", "start", "count", "anchor")
        kinds = stored(some.groupBy("core", "content").agg(F.sum("weight").alias("weight"), F.min(one).alias("one")), "repeats-kinds")
        sizes = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "repeats-classes")
        copies = kinds.where("weight > 1").select("core", "content")
        whole = some.where("weight = 1").join(small(copies), ["core", "content"], "left_semi")
        found = whole.select("name", F.col("start").alias("from"), (F.col("start") + F.col("count") + (LENGTH - 1)).alias("to"))
        members = kinds.join(small(sizes), "core").select("one.*", "core", "weight", "kinds")
        cold = members.where(F.col("kinds") <= hot)
        text = _with_text(docs, cold, ["start", "count", "anchor", "core", "weight"])
        read = text.mapInArrow(_read, f"name {name}, start int, count int, anchor int, core long, weight long, bytes binary")
        read = read.select("name", "start", "count", "anchor", "core", "weight", F.lit(level).alias("level"), "bytes")
        dealt = read.repartition("core").sortWithinPartitions("core")
        found = stored(found.unionByName(dealt.mapInArrow(_expanded, f"name {name}, `from` int, `to` int")), "repeats-spans")
        out = found if out is None else out.unionByName(found)
        if level + 1 == len(BLOCKS) or sizes.where(F.col("kinds") > hot).isEmpty():
            return out
        text = _with_text(docs, members.where(F.col("kinds") > hot), ["start", "count", "anchor", "weight"])
        rows = stored(text.mapInArrow(_recut(BLOCKS[level + 1]), f"name {name}, {_PIECE}, weight long"), "repeats-pieces")
    return out


def _cleaned(docs: DataFrame, hot: int) -> DataFrame:
    found = spans(docs, hot)
    lists = stored(found.groupBy("name").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "repeats-removed")
    return _known(_named(docs), small(lists, LISTS), "left").select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text", "spans")


def digested(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """See SCHEMA: for each row its bytes, how many go, in how many stretches, and a digest of the rest."""
    return _cleaned(docs, hot).mapInArrow(_digested, SCHEMA)


def remaining(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The same, and the bytes that stay (kept); they may begin or end within a character."""
    return _cleaned(docs, hot).mapInArrow(_taken, f"{SCHEMA}, kept binary")
