"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every learning row by language, and the rows: each task counts into arrays of a fixed size,
blocks of which are summed over two shuffles; the log-probability matrix (languages x BINS) and the languages' prior are
broadcast. Scoring reads whole texts and sums the matrix's rows of a document's n-grams in numpy, slices of a few megabytes at a time.

Texts are lower-cased, and runs of what is neither letter nor combining mark count as one space. Texts that are null or have no letter
(marks alone are none) are `und` with score 0; so is everything if nothing can be learned. Ties go to the language that sorts
first. Very long texts are read whole, repeated rows are scored each. Learning skips null languages, null texts and texts
without letters. Empty tables give no rows. Only doc_id, text and lang are read, so other columns can't clash; recognised()
hands on all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import release, ship

from .shared import bucket

ORDERS = (1, 2, 3)
BINS = 1 << 16
BLOCK = 1 << 13
#: Characters that are worked on at once.
SLICE = 1 << 20
UNKNOWN = "und"
#: Block that holds the count of a language's rows.
_ROWS = -1
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _grams(texts: list[str], bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bin of the n-gram that begins at a character, and each text's limits in them. Two spaces stand before each text, so no n-gram of order up to 3 joins two of them."""
    joined = "  " + "  ".join(texts) + "   "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - bins.bit_length() + 1)
    out, run = [], np.zeros(len(codes), np.uint32)
    for order, m in enumerate(_MULTIPLIERS[: max(ORDERS)]):
        run = run * np.uint32(0x01000193) ^ np.roll(codes, -order) * np.uint32(m)
        if order + 1 in ORDERS:
            out.append(((run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift)
    limits = np.cumsum([0, *(len(t) + 2 for t in texts)])  # each from the two spaces before it
    return [own[: limits[-1]] for own in out], limits


def _clean(column: pa.Array) -> list[str]:
    """Lower case, runs of what is neither letter nor mark as one space; empty for a text without letters."""
    text = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    text = pc.if_else(pc.match_substring_regex(text, r"\pL"), text, "")
    return pc.utf8_trim(pc.replace_substring_regex(text, r"[^\pL\pM]+", " "), " ").to_pylist()


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to]) + 2
            to += 1
        yield at, texts[at:to]
        at = to


def _counted(bins: int, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        many: Counter[str] = Counter()
        for batch in batches:
            texts, langs = _clean(batch.column(0)), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own, learned = counts.setdefault(lang, np.zeros(bins, np.int64)), [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                many[lang] += len(learned)
                for _, run in _runs(learned):
                    for grams in _grams(run, bins)[0]:
                        own += np.bincount(grams, minlength=bins)
        part = TaskContext.get().partitionId() % 16
        rows = [(lang, k, part, own[k * block : (k + 1) * block].astype("<i8").tobytes()) for lang, own in counts.items() for k in range(bins // block)]
        yield _batch(rows + [(lang, _ROWS, part, np.array([n], "<i8").tobytes()) for lang, n in many.items()])
        del counts, rows
        release()

    return task


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, k, part, counts = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(part, pa.int32()), pa.array(counts, pa.binary())], ["lang", "block", "part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            own = np.frombuffer(blob.as_buffer(), "<i8")
            sums[lang, k] = sums[lang, k] + own if (lang, k) in sums else own.copy()
    yield _batch([(lang, k, 0, v.tobytes()) for (lang, k), v in sums.items()])


class Model:
    """languages, a matrix of log-probabilities of n-grams with a row for each language, and the languages' own log-probabilities."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior


def trained(rows: DataFrame, bins: int = BINS, smoothing: float = 0.5) -> Model:
    """The model of all rows (text, lang) whose text and lang are not null. What is collected is bins x languages counts."""
    ship(rows.sparkSession)
    schema, block = "lang string, block int, part int, counts binary", min(BLOCK, bins)
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    parts = rows.mapInArrow(_counted(bins, block), schema).repartition("block", "part", "lang").mapInArrow(_summed, schema)
    sums = parts.repartition("block").mapInArrow(_summed, schema).collect()
    rows = {r["lang"]: int(np.frombuffer(r["counts"], "<i8")[0]) for r in sums if r["block"] == _ROWS}
    languages = sorted(k for k, n in rows.items() if n)
    counts = np.zeros((bins, len(languages)))
    for r in sums:
        if r["block"] != _ROWS and rows[r["lang"]]:
            counts[r["block"] * block : (r["block"] + 1) * block, languages.index(r["lang"])] = np.frombuffer(r["counts"], "<i8")
    matrix = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * bins)) if languages else counts
    prior = np.log(np.array([rows[k] for k in languages], float) / sum(rows.values()))
    return Model(languages, np.ascontiguousarray(matrix.T, np.float32), prior)


def judge(m: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the language, its posterior probability, and how much likelier an n-gram of the text is in it than by chance (mean logarithm)."""
    texts = _clean(column)
    pred, score, above = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bins = m.matrix.shape[1]
    for at, run in _runs(texts if m.languages else []):
        grams, limits = _grams(run, bins)
        sums = np.zeros((len(run), len(m.languages)))
        for own in grams:
            for k, row in enumerate(m.matrix):
                sums[:, k] += np.add.reduceat(row[own], limits[:-1], dtype=np.float64)
        mean = sums.max(axis=1) / (len(grams) * np.diff(limits)) + np.log(bins)
        sums += m.prior
        best = sums.argmax(axis=1)
        sure = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for k, text in enumerate(run):
            if text:
                pred[at + k], score[at + k], above[at + k] = m.languages[best[k]], float(sure[k]), float(mean[k])
    return pred, score, above


def _scored(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, _ = judge(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return task


def predicted(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the prediction's posterior probability) of each row."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, folds: int = 4, fold: int = 2, bins: int = BINS) -> DataFrame:
    """Learns from the rows outside of the fold, predicts all."""
    out = bucket("doc_id", folds) == fold
    return predicted(docs, trained(docs.where(~F.coalesce(out, F.lit(False))), bins), out)


def recognised(docs: DataFrame, least: float = 0.5, bins: int = BINS) -> DataFrame:
    """The rows of docs whose language is recognised, with their columns. Learns from all rows that have a language.

    The language must have that probability at least, and the text's n-grams must be likelier in it than if all bins were alike:
    among the learned languages one is nearly always sure, also for a script that none of them has.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(docs, bins))

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            pred, score, above = judge(model.value, column)
            yield pa.array((np.array(pred, object) != UNKNOWN) & (score >= least) & (above > 0), pa.bool_())
        release()

    return docs.where(known("text"))
