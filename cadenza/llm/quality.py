"""Operator 10: a quality classifier by factorisation machine.

Features of a document: its words, hashed into BINS (logarithm of the count, scaled to length 1), structure statistics of the whole
text, and its n_chars as metadata. A factorisation machine adds to a linear score the interactions of all pairs of
features with low-rank weights; scoring takes linear time, since sum over pairs <v_i, v_j> x_i x_j is half of
(sum v x)^2 - sum (v x)^2 in each rank.

It is fitted on the driver from a bounded sample: the TRAIN_ROWS labelled rows with the smallest hash of doc_id, whose
features are computed on the executors; of a doc_id that stands several times one row is learned from, the one whose features
sort first. All documents are scored where they are read, with the weights broadcast.

Null and empty texts have the statistics of an empty text and get a score. Very long texts are read whole. Repeated rows are scored
each. Null labels are skipped; without labels every score is 0.5. A tie (0.5) counts as 1. Empty tables give no rows.
Only doc_id, text and n_chars (which may be missing) are read, so other columns can't clash; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import ship

from .arrays import slices, words
from .shared import bucket

BINS = 1 << 14
RANK = 8
#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 8192
STATISTICS = ("log_bytes", "log_words", "word_length", "distinct", "repeats", "top_word", "letters", "digits", "spaces", "lines", "upper", "marks", "symbols", "wide", "n_chars", "n_chars_missing")

_CLASS = np.zeros((7, 256), bool)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[_k, list(_chars)] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(text: pa.Array, n_chars: np.ndarray, bins: int = BINS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: the rows' limits in (bin, value), those two, and the statistics (rows x STATISTICS)."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    for at, data, offsets in slices(text):
        rows = len(offsets) - 1
        hashes, first = words(data, offsets)
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        found, counts = np.unique(row * bins + (hashes >> shift).astype(np.int64), return_counts=True)
        owner = found // bins
        limits = np.searchsorted(owner, np.arange(rows + 1))
        value = np.log1p(counts)
        length = np.sqrt(np.bincount(owner, value**2, minlength=rows))
        value = value / length[owner]
        top = np.zeros(rows)
        np.maximum.at(top, owner, counts)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        size, many = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
        kinds = [_sums(c[data], offsets) for c in _CLASS]
        meta = n_chars[at : at + rows]
        stats = [np.log1p(np.diff(offsets)), np.log1p(n), np.minimum((np.diff(offsets) - kinds[2] - kinds[3]) / many, 50.0), np.diff(limits) / many, _sums(same, first) / many, top / many]
        stats += [k / size for k in kinds] + [_sums(data >= 128, offsets) / size, np.where(np.isnan(meta), 0.0, np.log1p(np.maximum(np.nan_to_num(meta), 0))), np.isnan(meta).astype(float)]
        yield limits, (found % bins).astype(np.int64), value, np.stack(stats, axis=1)


def _meta(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


class Machine:
    """Weights: bias, linear (features), factors (features x rank); features are bins and then statistics, scaled by mean and spread."""

    def __init__(self, bins: int = BINS, rank: int = RANK, seed: int = 7):
        size = bins + len(STATISTICS)
        self.bins, self.bias, self.linear = bins, 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (size, rank))
        self.mean, self.spread = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 4

    def raw(self, limits, bins, value, stats) -> np.ndarray:
        """The scores before the logistic function."""
        x, dense = self.scaled(stats), slice(self.bins, None)
        total = self.bias + x @ self.linear[dense]
        flat = np.concatenate([self.factors[bins], self.linear[bins, None]], axis=1) * value[:, None]
        filled = (np.diff(limits) > 0)[:, None]
        row = lambda a: np.add.reduceat(np.concatenate([a, np.zeros((1, a.shape[1]))]), limits[:-1], axis=0) * filled
        sums, flat = row(flat), flat[:, :-1]
        total += sums[:, -1]
        s = sums[:, :-1] + x @ self.factors[dense]
        q = row(flat**2) + x**2 @ self.factors[dense] ** 2
        return total + 0.5 * (s**2 - q).sum(axis=1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], epochs: int = 12, batch: int = 128, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> None:
        """rows: (bins, values, statistics, label). Adam on the logistic loss."""
        if not rows:  # nothing is known: every score is 0.5
            self.factors[:] = 0.0
            return
        stats, y = np.stack([r[2] for r in rows]), np.array([r[3] for r in rows])
        self.mean, self.spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        rng, size, rank = np.random.default_rng(seed), *self.factors.shape
        moments = [np.zeros((size, rank + 1)), np.zeros((size, rank + 1))]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                idx, val = np.concatenate([rows[k][0] for k in own]), np.concatenate([rows[k][1] for k in own])
                n = np.array([len(rows[k][0]) for k in own])
                limits, owner = np.concatenate([[0], np.cumsum(n)]), np.repeat(np.arange(len(own)), n)
                x = self.scaled(stats[own])
                error = 1 / (1 + np.exp(-np.clip(self.raw(limits, idx, val, stats[own]), -30, 30))) - y[own]
                flat = self.factors[idx] * val[:, None]
                s = np.stack([np.bincount(owner, flat[:, f], minlength=len(own)) for f in range(rank)], axis=1) + x @ self.factors[self.bins :]
                weight = error[owner] * val / len(own)
                pull = weight[:, None] * (s[owner] - flat)
                slope = np.zeros((size, rank + 1))
                slope[: self.bins, 0] = np.bincount(idx, weight, minlength=self.bins)
                for f in range(rank):
                    slope[: self.bins, f + 1] = np.bincount(idx, pull[:, f], minlength=self.bins)
                slope[self.bins :, 0] = x.T @ error / len(own)
                slope[self.bins :, 1:] = ((error[:, None] * x).T @ s - ((error[:, None] * x**2).sum(axis=0))[:, None] * self.factors[self.bins :]) / len(own)
                slope[:, 0] += ridge * self.linear
                slope[:, 1:] += ridge * self.factors
                step += 1
                moments[0] += 0.1 * (slope - moments[0])
                moments[1] += 0.001 * (slope**2 - moments[1])
                move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
                self.linear -= move[:, 0]
                self.factors -= move[:, 1:]
                self.bias -= rate * float(error.mean())


def _inputs(docs: DataFrame) -> list[Column]:
    return [F.col("text"), (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")]


def _sparse(bins: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes, bytes]] = []
            for limits, idx, value, stats in features(batch.column(2), _meta(batch.column(3)), bins):
                for k in range(len(stats)):
                    own = slice(limits[k], limits[k + 1])
                    out.append((idx[own].astype(np.int32).tobytes(), value[own].astype(np.float32).tobytes(), stats[k].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["place", "label", "idx", "value", "stats"])

    return task


def trained(docs: DataFrame, labels: DataFrame, learn: Column, most: int = TRAIN_ROWS, bins: int = BINS, rank: int = RANK) -> Machine:
    """The machine fitted on the labelled rows (doc_id, quality) that learn takes: at most so many, those with the smallest hash of doc_id."""
    ship(docs.sparkSession)
    machine = Machine(bins, rank)
    chosen = labels.where("doc_id is not null and quality is not null").where(learn).select("doc_id", F.xxhash64("doc_id").alias("place"), F.col("quality").cast("double").alias("label")).orderBy("place", "label").limit(most)
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(chosen), "doc_id").select("place", "label", "text", "n_chars").mapInArrow(_sparse(bins), "place long, label double, idx binary, value binary, stats binary")
    once = rows.groupBy("place", "label").agg(F.min(F.struct("idx", "value", "stats")).alias("x")).select("place", "label", "x.*")  # most rows at most, however often a doc_id stands in docs
    got = sorted(once.collect(), key=lambda r: (r["place"], r["label"]))[:most]
    machine.fit([(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float), np.frombuffer(r["stats"]), r["label"]) for r in got])
    return machine


def _scored(machine, bins: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Machine = machine.value
        for batch in batches:
            raw = [own.raw(*f) for f in features(batch.column(2), _meta(batch.column(3)), bins)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(raw) if raw else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return task


def scored(docs: DataFrame, machine: Machine, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), *_inputs(docs))
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(machine), machine.bins), f"doc_id {kind}, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Fits on labels outside of the fold, scores all documents."""
    out = bucket("doc_id", folds) == fold
    return scored(docs, trained(docs, labels, ~out), out)
