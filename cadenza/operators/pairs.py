"""Is one recording made from another? Prints of both are compared under many tempo relations and pitch shifts, and the best trial must stand out from all.

A print is bounded: some minutes at ten frames a second, each frame 12 centred pitch classes of length 1. Pairs are rows, trials are rows of a pair, dealt over
tasks; what is said of a pair comes from aggregates over its trials.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import scoring, spectra
from cadenza.session import ship

# Tempo relations and shifts that are tried, how much a relation other than 1 must win by, refinements of the winner, frames of a piece and the share of pieces that count.
RELATIONS, SHIFTS, RELATION_COST, REFINE = (1.0, 2.0, 0.5), tuple(range(-3, 4)), 0.05, (0.94, 0.97, 1.03, 1.06)
PIECE, KEEP, LEAST = 200, 0.6, 8
# End of fixed values.


def best_path(cost: np.ndarray) -> tuple[float, int, int]:
    """(mean cost, last column, cells) of the cheapest way that takes every row of cost, by steps of (1,1), (1,2) and (2,1) rows and columns; (1, 0, 0) under 3 rows or columns, or where none fits.

    A cell takes the step with the least sum, the first of equal ones; the mean is over the way's cells.
    """
    n, m = cost.shape
    if min(n, m) < 3:
        return 1.0, 0, 0
    moved = lambda row, by: np.concatenate([np.full(by, np.inf), row[:-by]])
    total, cells, at = [cost[0]], [np.ones(m)], np.arange(m)
    for i in range(1, n):
        ways = [(i - 1, 1), (i - 1, 2), (i - 2, 1)][: 3 if i > 1 else 2]
        sums = np.stack([moved(total[row], by) for row, by in ways])
        best = sums.argmin(axis=0)
        total.append(sums[best, at] + cost[i])
        cells.append(np.stack([moved(cells[row], by) for row, by in ways])[best, at] + 1)
    reached = np.isfinite(total[-1])
    if not reached.any():
        return 1.0, 0, 0
    mean = np.where(reached, total[-1] / np.where(reached, cells[-1], 1), np.inf)
    end = int(mean.argmin())
    return float(mean[end]), end, int(cells[-1][end])


def piecewise(query: np.ndarray, reference: np.ndarray) -> tuple[float, int, int]:
    """(score, last column of the best piece, cells of all) of a query (12 x frames) whose pieces may come in any order: the mean of the best ones, 1 less twice their cost; (-1, 0, 0) without a piece that is long enough."""
    pieces = np.array_split(np.arange(query.shape[1]), max(1, round(query.shape[1] / PIECE)))
    found = [best_path((1 - query[:, k].T @ reference) / 2) for k in pieces if len(k) >= LEAST]
    if not found:
        return -1.0, 0, 0
    scores = [1 - 2 * c for c, _, _ in found]
    top = sorted(scores, reverse=True)[: max(1, int(np.ceil(len(scores) * KEEP)))]
    end = max((s, e) for s, (_, e, _) in zip(scores, found, strict=True))[1]
    return float(np.mean(top)), end, sum(c for _, _, c in found)


def trial(query: np.ndarray, reference: np.ndarray, scale: float, rolled: int) -> tuple[float, int, int] | None:
    """The query stretched by scale and rolled by so many semitones against the reference; None if that makes it too short or too long."""
    n = int(round(query.shape[1] * scale))
    if n < LEAST or n > 1.5 * reference.shape[1]:
        return None
    x = spectra.resampled(query, n)
    return piecewise(np.roll(x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), 1e-9), rolled, axis=0), reference)


def changes(frames: np.ndarray) -> np.ndarray:
    """How much the harmony rises from frame to frame, over the largest, less its mean."""
    rise = np.maximum(0, np.diff(frames, axis=1, prepend=frames[:, :1])).sum(axis=0)
    rise = rise / rise.max() if len(rise) and rise.max() > 0 else rise
    return rise - rise.mean() if len(rise) else rise


def change_correlation(reference: np.ndarray, query: np.ndarray, scale: float) -> float:
    """The largest correlation of the two prints' changes over all places of the shorter one in the longer; 0 where one is short or even."""
    a, n = changes(reference), int(round(query.shape[1] * scale))
    if len(a) < 8 or n < 8:
        return 0.0
    b = spectra.resampled(changes(query)[None, :], n)[0]
    if a.std() < 1e-9 or b.std() < 1e-9:
        return 0.0
    return float(np.correlate(a / (a.std() * len(a)), b / b.std(), mode="valid").max())


def _tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unit = lambda v: np.stack([np.asarray(x, float) for x in v]).T
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            found = trial(unit(r.query), unit(r.reference), r.scale, r.rolled)
            corr = change_correlation(unit(r.reference), unit(r.query), r.scale) if r.wanted else None
            rows.append((*(found or (None, None, None)), corr))
        out = pd.DataFrame(rows, columns=["score", "end", "cells", "corr"])
        kept = batch.drop(columns=["query", "reference"]).reset_index(drop=True)
        yield pd.concat([kept, out.astype({"end": "Int64", "cells": "Int64", "score": float, "corr": float})], axis=1)


def _trials(pairs: DataFrame, trials: Column, prints: DataFrame, wanted: bool) -> DataFrame:
    """pair, trials (relation, fine, rolled) -> a row for each with what it gives; the prints' frames are joined to it."""
    rows = pairs.select("original", "remix", "base", F.posexplode(trials).alias("k", "x")).select("original", "remix", "k", "x.relation", "x.fine", "x.rolled", (F.col("base") * F.col("x.relation") * F.col("x.fine")).alias("scale"), F.lit(wanted).alias("wanted"))
    names = rows.columns
    side = lambda name, frames: prints.select(F.col("name").alias(name), F.col("frames").alias(frames))
    rows = rows.join(side("original", "reference"), "original").join(side("remix", "query"), "remix").select(*names, "reference", "query")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.repartition("original", "remix", "k").mapInPandas(_tried, f"{schema}, score double, end long, cells long, corr double")


def matched(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """What is known of each pair (original, remix) of prints (name, bpm, source, frames): score, verdict, method, confidence, tempo_ratio, beat_relation, stretch_refine, semitones, both tempi, novelty_corr, cells, runner_up, null, margin, note.

    Pairs with a print that is missing or has under 8 frames, or without a usable relation, have a null score and the verdict reject. Repeated pairs count once.
    """
    ship(pairs.sparkSession)
    pairs = pairs.select("original", "remix").distinct()
    side = lambda name: prints.select(F.col("name").alias(name), F.col("bpm").alias(f"bpm_{name}"), F.col("source").alias(f"source_{name}"), F.size("frames").alias(f"n_{name}"))
    both = pairs.join(side("original"), "original").join(side("remix"), "remix").where(f"n_original >= {LEAST} and n_remix >= {LEAST}")
    both = both.withColumn("base", F.when(F.col("bpm_original") > 0, F.col("bpm_remix") / F.col("bpm_original")).otherwise(1.0))
    of = lambda relation, fine, rolled: F.struct(relation.alias("relation"), fine.alias("fine"), rolled.alias("rolled"))
    grid = F.array(*(of(F.lit(r), F.lit(1.0), F.lit(s)) for r in RELATIONS for s in SHIFTS))
    tried = _trials(both, grid, prints, False)
    own = ["original", "remix"]
    field = tried.groupBy(*own).agg(F.percentile("score", F.lit(0.5)).alias("null"))  # of 21 trials
    first = lambda c: F.struct(F.col(c), (-F.col("k")).alias("k"))
    adjusted = F.col("score") - F.when(F.col("relation") == 1.0, 0.0).otherwise(RELATION_COST)
    best = tried.where("score > -1").groupBy(*own, "relation").agg(F.max_by(F.struct("score", "rolled", "cells", "k"), first("score")).alias("x")).select(*own, "relation", "x.*").withColumn("adjusted", adjusted)
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("adjusted"), "k"))
    best = best.withColumn("place", place)
    top = best.groupBy(*own).agg(*(F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in ("relation", "rolled", "cells", "adjusted")), F.max(F.when(F.col("place") == 2, F.col("adjusted"))).alias("second"))
    chosen = both.join(top.select(*own, "relation", "rolled"), own)
    finer = F.array(*(of(F.col("relation"), F.lit(f), F.col("rolled")) for f in (1.0, *REFINE)))
    fine = _trials(chosen.select("original", "remix", "base", "relation", "rolled"), finer, prints, True)
    ranked = fine.where("score > -1").withColumn("s", adjusted)
    won = ranked.groupBy(*own).agg(F.max_by(F.struct("s", "fine", "cells", "corr"), first("s")).alias("w")).select(*own, "w.*")
    rows = pairs.join(both, own, "left").join(field, own, "left").join(top.select(*own, "relation", "rolled", "second"), own, "left").join(won, own, "left")
    vocal = F.coalesce((F.col("source_original") == "vocals") & (F.col("source_remix") == "vocals"), F.lit(False))
    score = F.when(F.col("s").isNotNull(), F.greatest(F.lit(0.0), F.col("s")))
    margin = score - F.col("null")
    verdict = F.when(vocal, scoring.pair_verdict(score, margin, "vocal")).otherwise(scoring.pair_verdict(score, margin, "chroma"))
    return rows.select(
        *own, score.alias("score"), F.when(F.col("s").isNull(), "reject").otherwise(verdict).alias("verdict"), F.when(vocal, "vocal").otherwise("chroma").alias("method"), F.when(vocal, "high").otherwise("low").alias("confidence"),
        (F.col("base") * F.col("relation")).alias("tempo_ratio"), F.col("relation").alias("beat_relation"), F.col("fine").alias("stretch_refine"), (-F.col("rolled")).alias("semitones"), "bpm_original", "bpm_remix", F.col("corr").alias("novelty_corr"), "cells",
        F.greatest(F.lit(0.0), F.coalesce("second", F.lit(0.0))).alias("runner_up"), "null", margin.alias("margin"), F.when(vocal, "").otherwise("no separated voice on both sides: a match of harmony only").alias("note"),
    )
