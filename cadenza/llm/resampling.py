"""Operator 12: target-distribution importance resampling over word tries.

Features are runs of 1 to WIDTH consecutive words, counted in BUCKETS buckets by their CRC-32. A corpus and a target have so many of each
bucket; a bucket's gain is the log of the ratio of its smoothed shares, a document's weight the sum of its features' gains, and the documents to draw are those
with the highest weight plus Gumbel noise, which is a function of doc_id.

Each partition is counted in tries over its words: a node is a path of words, holds how often it occurs and the CRC state of its path, and a child's
state comes from its parent's by running on over the next word, so no feature's text is ever put together. A trie is kept as arrays level by level
(parent, word, count, state) and covers the rows of an Arrow batch, some MB of text, so that memory doesn't grow with the partition; its counts
go into the partition's bucket totals, and these are what is shuffled: as many rows as there are buckets for each partition. To score, the same
tries are built again with gains attached to the nodes, and each document's words walk down the paths that begin at them.

Null texts have no words; texts without words weigh 0. Very long texts are read whole. Rows of one doc_id are rows of their own, and
ties between them go by reading order. doc_id is taken as text for the noise (null: 'null') and comes out as a whole number, null if it is none; in
ties null comes last. Empty tables give no rows; an empty target has no features, and every gain is then a document's
share against an even one. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import ship

from .arrays import slices
from .shared import stored
from .wordcodes import bounds, codes, dense

WIDTH, BUCKETS = 3, 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
SEED, PERCENT = 42, 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache(maxsize=4096)
def _moved(n: int) -> np.ndarray:
    """(4, 256): what each byte of a CRC state becomes when n zero bytes follow; the whole state's is the xor of its bytes'."""
    if n == 1:
        states = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
        step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        return step[states & 255] ^ (states >> 8)
    return _apply(_moved(n // 2)[None], np.zeros((4, 256), np.int64), _moved(n - n // 2))


def _apply(tables: np.ndarray, which: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros(states.shape, np.uint32)
    for k in range(4):
        out ^= tables[which, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Trie:
    """The words of some rows as paths of up to WIDTH words.

    place[k]: the node of each place's path of k + 1 words, -1 where its row ends before; count[k], state[k]: of the nodes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
        text = _LOWER[data]
        begin, end, self.first = bounds(text, offsets, _WORD)
        word, n = codes(text, begin, end - begin)
        one = np.zeros(n, np.int64)
        one[word] = np.arange(len(word))
        raw = text.tobytes()
        spelled = [raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        on = np.array([zlib.crc32(b" " + w) for w in spelled], np.uint32)
        sizes, which = np.unique((end - begin)[one] + 1, return_inverse=True)
        tables = np.stack([_moved(int(s)) for s in sizes]) if n else np.zeros((1, 4, 256), np.uint32)
        last = np.repeat(self.first[1:], np.diff(self.first))
        self.place, self.count, self.state = [word], [np.bincount(word, minlength=n)], [np.array([zlib.crc32(w) for w in spelled], np.uint32)]
        for k in range(1, width):
            deep = np.flatnonzero(np.arange(len(word)) + k < last)
            paths = self.place[-1][deep] * n + word[deep + k]
            node, size = dense(paths)
            path = np.zeros(size, np.int64)
            path[node] = paths
            parent, child = np.divmod(path, max(n, 1))
            self.state.append(_apply(tables, which[child], self.state[-1][parent]) ^ on[child])
            self.count.append(np.bincount(node, minlength=size))
            self.place.append(np.full(len(word), -1, np.int64))
            self.place[-1][deep] = node

    def totals(self, buckets: int) -> np.ndarray:
        """How many features each bucket has."""
        out = np.zeros(buckets, np.int64)
        for count, state in zip(self.count, self.state, strict=True):
            out += np.bincount(state % np.uint32(buckets), count, buckets).astype(np.int64)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's number of features and sum of gains."""
        found, sums = np.zeros((2, len(self.place[0]) + 1), np.int64)
        for place, state in zip(self.place, self.state, strict=True):
            own = np.append(gains[state % np.uint32(len(gains))], 0)  # -1: no node
            sums[1:] += own[place]
            found[1:] += place >= 0
        sums, found = np.cumsum(sums), np.cumsum(found)
        return found[self.first[1:]] - found[self.first[:-1]], sums[self.first[1:]] - sums[self.first[:-1]]


def _counted(buckets: int, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                out += Trie(data, offsets, width).totals(buckets)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["bucket", "n"])

    return count


def totals(docs: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """The features of each bucket over all rows. Collected is a number for each bucket."""
    ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_counted(buckets, width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the buckets' smoothed share of the target over that of the corpus."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _walked(own: np.ndarray, width: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(2)):
                trie = Trie(data, offsets, width)
                features, weight = trie.walked(own)
                n = len(features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(np.diff(trie.first)), pa.array(features), pa.array(weight)], ["doc_id", "name", "n_words", "n_features", "weight"])

    return walk


def weighed(docs: DataFrame, own: np.ndarray, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row. own: the buckets' gains."""
    ship(docs.sparkSession)
    rows = docs.select(F.expr("try_cast(doc_id AS long)").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), "text")
    rows = rows.mapInArrow(_walked(own, width), "doc_id long, name string, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def drawn(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: that many hundredths of the rows with enough words are ranked, by score and then doc_id.

    rows: what weighed() gives. Rows are dealt by ranges of (score, doc_id), so that a rank is a row's place in its range and what stands in the ranges before: a number for each range is collected.
    """
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = stored(rows.where(F.col("n_words") >= least).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    most, before, starts = sum(n for _, n in sizes) * percent // 100, 0, []
    for part, n in sizes:
        if before < most:
            starts.append((part, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, before long"))
    placed = ranged.join(starts, "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before"))
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long").alias("rank")
    rest = ranged.join(starts, "part", "left_anti").withColumn("rank", none)
    return ranked.select(*columns).unionByName(rest.select(*columns)).unionByName(rows.where(F.col("n_words") < least).withColumn("rank", none).select(*columns))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents' features, weights, scores and ranks against the texts of target."""
    return drawn(weighed(docs, gains(totals(docs), totals(target))), percent)
