"""Kernels over sampled series that need arrays: grouped by track and run with numpy. What SQL can say is said in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import ship


def rolling_mean(value: str, keys: list[str], order: str, half: int) -> Column:
    """The mean over half samples to each side with zeros beyond the ends: the divisor is always the whole width."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)) / F.lit(2.0 * half + 1)


def flux(rows: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """rows with onset: the rise against the sample before, less its local mean, at least 0, over the largest of the track."""
    line = Window.partitionBy(*keys).orderBy(order)
    rise = F.greatest(F.lit(0.0), F.col(value) - F.coalesce(F.lag(value).over(line), F.col(value)))
    rows = rows.withColumn("__rise", rise)
    rows = rows.withColumn("__left", F.greatest(F.lit(0.0), F.col("__rise") - rolling_mean("__rise", keys, order, half)))
    return rows.withColumn("onset", F.col("__left") / F.greatest(F.max("__left").over(Window.partitionBy(*keys)), F.lit(1e-12))).drop("__rise", "__left")


def local_peaks(rows: DataFrame, keys: list[str], order: str, value: str, share: float) -> DataFrame:
    """The rows that are above their left and not below their right neighbour, and at least that share of the track's 95th percentile."""
    line = Window.partitionBy(*keys).orderBy(order)
    level = F.percentile(value, F.lit(0.95)).over(Window.partitionBy(*keys))
    rows = rows.select("*", F.lag(value).over(line).alias("__l"), F.lead(value).over(line).alias("__r"), level.alias("__p"))
    return rows.where((F.col(value) > F.col("__l")) & (F.col(value) >= F.col("__r")) & (F.col(value) >= share * F.col("__p"))).drop("__l", "__r", "__p")


def stft(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Bins x frames of a periodic Hann window, reflected at the ends."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    padded = np.pad(np.asarray(x, float), size // 2, mode="reflect" if len(x) > size // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * window, axis=1).T


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Unbiased and normalised to 1 at lag 0, by way of the spectrum."""
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    spectrum = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    out = np.fft.irfft(spectrum * spectrum.conj())[:n] / np.arange(n, 0, -1)
    return out / out[0] if out[0] > 0 else np.zeros(n)


def tempo(onset: np.ndarray, rate: float, low: float = 60.0, high: float = 200.0, centre: float = 124.0, spread: float = 0.95) -> float:
    """Beats a minute of an onset envelope: the lag of the strongest autocorrelation under a log-normal prior; 0 for silence."""
    corr = autocorrelation(onset)
    lags = np.arange(max(1, int(rate * 60 / high)), min(len(corr) - 1, int(rate * 60 / low)) + 1)
    if not len(lags) or not np.any(corr):
        return 0.0
    bpm = 60.0 * rate / lags
    k = int(np.argmax(corr[lags] * np.exp(-0.5 * (np.log2(bpm / centre) / spread) ** 2)))
    lag = float(lags[k])
    a, b, c = corr[int(lag) - 1 : int(lag) + 2]
    if a - 2 * b + c < 0:
        lag += 0.5 * (a - c) / (a - 2 * b + c)
    return 60.0 * rate / lag


def chroma(x: np.ndarray, rate: int, size: int = 8192, hop: int = 2048) -> np.ndarray:
    """12 pitch classes x frames, each frame summing to 1."""
    power = np.abs(stft(x, size, hop)) ** 2
    hertz = np.fft.rfftfreq(size, 1 / rate)
    use = (hertz > 55) & (hertz < 5000)
    note = np.rint(69 + 12 * np.log2(hertz[use] / 440)).astype(int) % 12
    out = np.zeros((12, power.shape[1]))
    np.add.at(out, note, power[use])
    return out / np.maximum(out.sum(axis=0), 1e-12)


def subsequence_cost(query: np.ndarray, target: np.ndarray) -> float:
    """The least mean cost of aligning all of the query with a part of the target; 1 if either has fewer than 3 rows.

    Steps are (1,1), (1,2) and (2,1); a cell takes the one with the least accumulated cost, the first of equal ones, and a row that
    (2,1) leaps over costs nothing. Rows are unit vectors, costs half of 1 - cosine; the mean is over the cells of the way.
    """
    cost = (1 - query @ target.T) / 2
    n, m = cost.shape
    if min(n, m) < 3:
        return 1.0
    moved = lambda row, by: np.concatenate([np.full(by, np.inf), row[:-by]])
    total, cells, at = [cost[0]], [np.ones(m)], np.arange(m)
    for i in range(1, n):
        ways = [(i - 1, 1), (i - 1, 2), (i - 2, 1)][: 3 if i > 1 else 2]
        sums = np.stack([moved(total[row], by) for row, by in ways])
        best = sums.argmin(axis=0)
        total.append(sums[best, at] + cost[i])
        cells.append(np.stack([moved(cells[row], by) for row, by in ways])[best, at] + 1)
    reached = np.isfinite(total[-1])
    return float((total[-1][reached] / cells[-1][reached]).min()) if reached.any() else 1.0


def pieces(rows: DataFrame, key: str, order: str, length: int) -> DataFrame:
    """rows with piece: each key's rows in order, cut into round(rows / length) pieces (1 at least) whose lengths differ by 1 at most, so none is longer than 1.5 length."""
    own, line = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    rows = rows.select("*", (F.row_number().over(line) - 1).alias("__i"), F.count("*").over(own).alias("__m"))
    k = F.greatest(F.lit(1), F.bround(F.col("__m") / length).cast("int"))
    rows = rows.withColumn("__short", F.floor(F.col("__m") / k)).withColumn("__longer", F.col("__m") % k)
    ends = F.col("__longer") * (F.col("__short") + 1)  # the first pieces have a row more
    at = F.when(F.col("__i") < ends, F.floor(F.col("__i") / (F.col("__short") + 1))).otherwise(F.col("__longer") + F.floor((F.col("__i") - ends) / F.col("__short")))
    return rows.withColumn("piece", at.cast("int")).drop("__i", "__m", "__short", "__longer")


def aligned(rows: DataFrame, reference: np.ndarray, key: str, order: str, vector: str, keep: float = 0.6, least: int = 1) -> DataFrame:
    """key, n, cost and score (1 less twice the cost) of each group's sequence of vectors against a reference sequence.

    The sequence is cut into pieces of about half the reference's length, since a reference can take less than twice its rows.
    Each of least rows or more is aligned on its own; the cost is the mean over the best pieces, that share of them, rounded up,
    and 1 where every piece is shorter. n counts the rows of all.
    """
    ship(rows.sparkSession)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    target = unit(np.asarray(reference, float))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        cost = subsequence_cost(unit(np.stack([np.asarray(v, float) for v in group[vector]])), target)
        return pd.DataFrame({key: group[key].iloc[:1], "piece": group["piece"].iloc[:1], "n": [len(group)], "cost": [cost]})

    cut = pieces(rows.select(key, order, vector), key, order, max(1, len(target) // 2))
    costs = cut.groupBy(key, "piece").applyInPandas(one, f"{key} {rows.schema[key].dataType.simpleString()}, piece int, n long, cost double")
    costs = costs.withColumn("cost", F.when(F.col("n") >= least, F.col("cost")))
    own = Window.partitionBy(key)
    costs = costs.select("*", F.row_number().over(own.orderBy(F.asc_nulls_last("cost"), "piece")).alias("__k"), F.count("cost").over(own).alias("__of"))
    best = F.avg(F.when(F.col("__k") <= F.ceil(F.col("__of") * keep), F.col("cost")))
    out = costs.groupBy(key).agg(F.sum("n").alias("n"), F.coalesce(best, F.lit(1.0)).alias("cost"))
    return out.select(key, "n", F.round("cost", 6).alias("cost"), F.round(1 - 2 * F.col("cost"), 6).alias("score"))
