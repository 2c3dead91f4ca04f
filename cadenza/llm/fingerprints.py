"""Operator 8: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (what stands between line feeds). Each paragraph is hashed to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, coordinate by coordinate modulo a power of two: the order of
paragraphs doesn't matter, and paragraphs can be added to or taken from a fingerprint without the rest of the text.
The vector has two parts: EXACT lanes of 64 bits from a cryptographic hash of the paragraph (modulo 2^64), which tell
equal multisets from others, and SKETCH lanes of 32 bits (modulo 2^32), in which each run of WIDTH words of the paragraph
adds or subtracts 1 at a hashed place; read as signed numbers their cosine estimates how much two documents share. No text that
Spark can hold has so many words that a lane passes 2^31.

A query over whole tables needs each document's successor: rows are dealt by ranges of doc_id, sorted, and read as a stream; the
first and last row of each partition meet in a join of as many rows as there are partitions.

Null and empty texts are one empty paragraph. Very long texts are read whole. Rows of one doc_id are ordered by their
text's hash. A null doc_id comes first; a doc_id that is no whole number counts as null. A single row's successor is itself. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import ship

from .arrays import shingles, words
from .shared import stored

EXACT, SKETCH, WIDTH = 4, 128, 2
#: Characters of text that are worked on at once.
SLICE = 1 << 21


class Vectors:
    """The fingerprints of some texts: exact (texts x EXACT, unsigned 64 bits), sketch (texts x SKETCH, unsigned 32 bits)."""

    def __init__(self, exact: np.ndarray, sketch: np.ndarray):
        self.exact, self.sketch = exact, sketch

    def __add__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Vectors) -> Vectors:
        return Vectors(self.exact - other.exact, self.sketch - other.sketch)

    def __getitem__(self, k) -> Vectors:
        return Vectors(self.exact[k], self.sketch[k])

    def __len__(self) -> int:
        return len(self.exact)

    def texts(self) -> list[str]:
        return [a.astype(">u8").tobytes().hex() + b.astype(">u4").tobytes().hex() for a, b in zip(self.exact, self.sketch, strict=True)]

    @staticmethod
    def read(texts: list[str]) -> Vectors:
        """The vectors that texts() wrote."""
        data = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), 8 * EXACT + 4 * SKETCH)
        exact, sketch = np.ascontiguousarray(data[:, : 8 * EXACT]), np.ascontiguousarray(data[:, 8 * EXACT :])
        return Vectors(exact.view(">u8").astype(np.uint64), sketch.view(">u4").astype(np.uint32))

    def joined(self, other: Vectors) -> Vectors:
        return Vectors(np.concatenate([self.exact, other.exact]), np.concatenate([self.sketch, other.sketch]))


def vectors(texts: list[str]) -> Vectors:
    """Each text's sum over its paragraphs."""
    paragraphs = [t.encode().split(b"\n") for t in texts]
    counts = [len(p) for p in paragraphs]
    flat = [x for p in paragraphs for x in p]
    lanes = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in flat]), "<u8").reshape(-1, EXACT)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    exact = np.add.reduceat(lanes, first[:-1], axis=0) if texts else np.zeros((0, EXACT), np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
    runs, limits = shingles(*words(np.frombuffer(b"".join(flat), np.uint8), offsets, lower=False), WIDTH)
    row = np.repeat(np.arange(len(texts)), limits[first[1:]] - limits[first[:-1]])
    place = row * SKETCH + (runs & np.uint64(SKETCH - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((runs >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    sums = np.bincount(place, sign, minlength=len(texts) * SKETCH).astype(np.int64)
    return Vectors(exact, sums.astype(np.uint32).reshape(-1, SKETCH))


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 for equal fingerprints, else the cosine of the signed sketches, at least 0."""
    x, y = a.sketch.view(np.int32).astype(np.float64), b.sketch.view(np.int32).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a.exact == b.exact).all(axis=1) & (a.sketch == b.sketch).all(axis=1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the first code points of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = [("edge", pa.string()), ("part", pa.int64()), ("text", pa.string())]


def _compared(ids: list, texts: list[str], own: Vectors, after: list[str], next_own: Vectors) -> dict[str, list]:
    new = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    other = vectors(new)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new], "fingerprint": own.texts(),
        "edited_fingerprint": other.texts(), "near_edited": likeness(own, other).tolist(), "near_next": likeness(own, next_own).tolist(),
    }


def _batch(columns: dict[str, list], fields: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in fields], schema=pa.schema(fields))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for all documents of a sorted partition but the last, and its first and last document as edges."""
    part, fields = TaskContext.get().partitionId(), _FIELDS + _EDGES
    last: tuple[int | None, str, Vectors] | None = None
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(ids):
            texts, size, to = [], 0, at
            while to < len(ids) and (to == at or size < SLICE):
                texts.append(column[to].as_py() or "")
                size += len(texts[-1])
                to += 1
            own, docs = vectors(texts), ids[at:to]
            if last is None:
                yield _batch({"doc_id": docs[:1], "edge": ["first"], "part": [part], "text": texts[:1]}, fields)
            else:
                docs, texts, own = [last[0], *docs], [last[1], *texts], last[2].joined(own)
            if len(docs) > 1:
                yield _batch(_compared(docs[:-1], texts[:-1], own[:-1], texts[1:], own[1:]), fields)
            last = (docs[-1], texts[-1], own[-1:])
            at = to
    if last is not None:
        yield _batch({"doc_id": [last[0]], "edge": ["last"], "part": [part], "text": [last[1]]}, fields)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, after = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        yield _batch(_compared(ids, texts, vectors(texts), after, vectors(after)), _FIELDS)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """For each row, against its successor by doc_id: see SCHEMA."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    streamed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_streamed, f"{SCHEMA}, edge string, part long, text string")
    found = stored(streamed, "fingerprints")
    edges = found.where("edge is not null")
    parts = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())  # a number for each partition
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part long, next long")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    ends = edges.where("edge = 'last'").join(F.broadcast(after), "part").join(first, "next").select("doc_id", "text", "after").mapInArrow(_joined, SCHEMA)
    return found.where("edge is null").drop("edge", "part", "text").unionByName(ends)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signed paragraphs as lanes of 32 bits, which can be summed in 64 without running over."""
    for batch in batches:
        signs = np.array([0 if s is None else s for s in batch.column(2).to_pylist()], np.int64)[:, None]
        own = vectors([x or "" for x in batch.column(1).to_pylist()])
        lanes = np.concatenate([(own.exact >> np.uint64(32)).astype(np.int64), (own.exact & np.uint64(0xFFFFFFFF)).astype(np.int64), own.sketch.view(np.int32).astype(np.int64)], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(lanes * signs), pa.list_(pa.int64()))], ["doc_id", "lanes"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = Vectors.read(batch.column(1).to_pylist())
        sums = np.array([x if x is not None else [0] * (2 * EXACT + SKETCH) for x in batch.column(2).to_pylist()], np.int64).reshape(len(own), -1).astype(np.uint64)
        by = Vectors((sums[:, :EXACT] << np.uint64(32)) + sums[:, EXACT : 2 * EXACT], (sums[:, 2 * EXACT :] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own + by).texts(), pa.string())], ["doc_id", "fingerprint"])


def changed(stored_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The fingerprints (doc_id, fingerprint) after changes (doc_id, paragraph, sign): sign 1 puts a paragraph into its document, -1 takes one out.

    The texts of the documents aren't read. A document's changes are summed lane by lane before they are shuffled, so any number
    of them may be of one document. Null signs and changes of no known document change nothing; a null paragraph counts as empty.
    """
    ship(stored_rows.sparkSession)
    kind = changes.schema["doc_id"].dataType.simpleString()
    lanes = changes.select("doc_id", "paragraph", F.col("sign").cast("long")).mapInArrow(_halves, f"doc_id {kind}, lanes array<long>")
    sums = lanes.groupBy("doc_id").agg(*(F.sum(F.get("lanes", F.lit(k))).alias(f"l{k}") for k in range(2 * EXACT + SKETCH)))
    sums = sums.select(F.col("doc_id").alias("of"), F.array(*(f"l{k}" for k in range(2 * EXACT + SKETCH))).alias("lanes"))
    rows = stored_rows.join(sums, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "fingerprint", "lanes")
    return rows.mapInArrow(_moved, f"doc_id {stored_rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")
