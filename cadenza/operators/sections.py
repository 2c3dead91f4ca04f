"""Sections of recordings in chunks: boundaries where pitch classes and timbre change, moved to bars, and what each section is.

Features, their moments, novelty, levels and section means are worked out cell by cell; what is in one piece for a track is its list of boundaries,
which are some bars apart, and the distances between its sections.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import arrangement, folds, spectra
from cadenza.operators.beats import FRAMES, Frames
from cadenza.operators.chunks import CELL, Cell, halo, haloed, kernelled, scaled
from cadenza.session import Workbench, ship

# Samples of a frame of pitch classes and their range in hertz, coefficients, the weight of timbre, how a frame is stacked with those after it, the kernel's half, and what makes a boundary and a group.
CHROMA_SIZE, PITCHES, MFCC, TIMBRE, LAG, STEP, HALF = 4096, (55.0, 2093.0), 13, 0.5, 4, 2, 32
LEAST_BARS, HEIGHT, SLACK, ALIKE = 4, 0.55, 0.9, 0.30
# End of fixed values.

WIDE = 12 + MFCC
BEYOND = (LAG - 1) * STEP


def features(clips: DataFrame, bench: Workbench, frames: Frames = FRAMES, chroma_size: int = CHROMA_SIZE, cell: int = CELL) -> DataFrame:
    """track_id, sr, start, values, n, mean, spread: 12 pitch classes (summing to 1) and 13 coefficients of each frame after another, and their number, means and squared deviations for each cell. The tuning isn't corrected."""

    def kernel(c: Cell) -> list[tuple]:
        hertz = np.fft.rfftfreq(chroma_size, 1 / c.rate)
        use = (hertz >= PITCHES[0]) & (hertz <= PITCHES[1])
        note = np.rint(69 + 12 * np.log2(hertz[use] / 440)).astype(int) % 12
        fold = np.zeros((12, int(use.sum())))
        fold[note, np.arange(len(note))] = 1.0
        first, blocks = c.magnitudes(chroma_size, frames.hop)
        classes = np.concatenate([np.sqrt(fold @ m[use] ** 2) for m in blocks] or [np.zeros((12, 0))], axis=1)
        bank, basis = spectra.mel_bank(c.rate, frames.size, 40), spectra.cosines(MFCC, 40)
        _, blocks = c.magnitudes(frames.size, frames.hop)
        timbre = np.concatenate([basis @ np.log1p(1000 * (bank @ m)) for m in blocks] or [np.zeros((MFCC, 0))], axis=1)
        own = np.concatenate([classes / np.maximum(classes.sum(axis=0), 1e-9), timbre])
        if not own.shape[1]:
            return []
        mean = own.mean(axis=1)
        return [(first * WIDE, own.T.ravel().tolist(), own.shape[1], mean.tolist(), ((own - mean[:, None]) ** 2).sum(axis=1).tolist())]

    wide = halo(max(chroma_size, frames.size), frames.hop)
    return bench.put(kernelled(haloed(clips, cell, wide, wide), cell, kernel, "start long, values array<double>, n long, mean array<double>, spread array<double>"))


def _moments(found: DataFrame) -> DataFrame:
    """track_id, mean and deviation of each feature over the whole track, from those of its cells."""
    rows = found.select("track_id", "n", F.posexplode(F.arrays_zip("mean", "spread")).alias("d", "m")).select("track_id", "d", "n", "m.*")
    total = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    each = rows.groupBy("track_id", "d").agg(total.alias("mean"), F.sum("n").alias("n"), F.collect_list(F.struct("n", "mean", "spread")).alias("cells"))
    away = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["spread"] + c["n"] * (c["mean"] - F.col("mean")) * (c["mean"] - F.col("mean")))
    each = each.select("track_id", "d", "mean", F.sqrt(away / F.col("n")).alias("deviation"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "mean", "deviation")))
    return each.groupBy("track_id").agg(ordered.alias("o")).select("track_id", F.col("o.mean").alias("mean"), F.col("o.deviation").alias("deviation"))


def novelty(found: DataFrame, bench: Workbench, half: int = HALF, cell: int = 1 << 12) -> DataFrame:
    """track_id, sr, start, values: how much the frames before a place differ from those after it, over the track's largest; see spectra.novelty_curve(). found: features()."""
    rows = found.select("track_id", "sr", "start", "values").join(_moments(found), "track_id")
    weight, carry = np.array([1.0] * 12 + [TIMBRE] * MFCC), ("mean", "deviation")

    def kernel(c: Cell) -> list[tuple]:
        first, last, m = c.start // WIDE, c.end // WIDE, c.total // WIDE - BEYOND
        last = min(last, m)
        if last <= first:
            return []
        own = min(half, max(4, m // 8))
        x = c.beyond((first - own) * WIDE, (last + own + BEYOND) * WIDE).reshape(-1, WIDE)
        x = (x - np.array(c.carried["mean"])) / np.maximum(np.array(c.carried["deviation"]), 1e-9) * weight
        x = spectra.stacked(x.T, LAG, STEP)
        x = x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), 1e-9)
        side = np.repeat([1.0, -1.0], own) * np.exp(-0.5 * np.linspace(-2, 2, 2 * own) ** 2)
        out = ((np.lib.stride_tricks.sliding_window_view(x, 2 * own, axis=1)[:, : last - first] @ side) ** 2).sum(axis=0)
        at = np.arange(first, last)
        out[(at < own) | (at >= m - own)] = 0.0
        return [(first, out.tolist())]

    wide = (half + BEYOND) * WIDE
    return bench.put(scaled(bench.put(kernelled(haloed(rows, cell * WIDE, half * WIDE, wide, "start", "values", carry), cell * WIDE, kernel, "start long, values array<double>", carry))))


def quantiles(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key and quantile: that share of each group's values is below it, linear between neighbours. By sorted rows, so that no group is held."""
    own = Window.partitionBy(key)
    rows = rows.select(key, F.col(value).alias("v"), (F.row_number().over(own.orderBy(value)) - 1).alias("k"), (share * (F.count("*").over(own) - 1)).alias("at"))
    near = rows.where((F.col("k") == F.floor("at")) | (F.col("k") == F.floor("at") + 1))
    low, high = F.min("v"), F.max("v")
    return near.groupBy(key).agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("quantile"))


def tops(curve: DataFrame) -> DataFrame:
    """track_id, frame, v of the places above what is to both sides; of a flat top the middle."""
    line = Window.partitionBy("track_id").orderBy("frame")
    last = F.max("frame").over(Window.partitionBy("track_id"))
    changes = curve.select("*", F.lag("v").over(line).alias("before"), last.alias("last")).where("before is null or before <> v")
    found = changes.select("*", F.lead("v").over(line).alias("after"), F.lead("frame").over(line).alias("next"))
    return found.where("before < v and after < v").select("track_id", F.floor((F.col("frame") + F.col("next") - 1) / 2).alias("frame"), "v")


def strongest(rows: DataFrame, apart: Column) -> DataFrame:
    """rows (track_id, frame, v) that are so many frames, a number of their track's own, from all stronger ones that stay; of equal ones the earlier."""
    # greedy_apart takes one distance for all: frames are counted in units of their track's own
    also = tuple(c for c in rows.columns if c not in ("track_id", "v"))
    chosen = folds.greedy_apart(rows.withColumn("__t", F.col("frame") * 1_000_000 / apart), "track_id", "__t", "v", 999_999.5, also=also)
    return chosen.select(*rows.columns)


def snapped(times: DataFrame, grid: DataFrame) -> DataFrame:
    """times (track_id, seconds) with seconds moved to the nearest of the grid's (track_id, seconds), the earlier of two; tracks without a grid stay."""
    both = times.select("track_id", "seconds", F.lit(1).alias("asked")).unionByName(grid.select("track_id", "seconds", F.lit(0).alias("asked")))
    line, known = Window.partitionBy("track_id").orderBy("seconds", "asked"), F.when(F.col("asked") == 0, F.col("seconds"))
    before = F.last(known, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("track_id").orderBy(F.desc("seconds"), "asked")
    after = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.select("track_id", "seconds", "asked", before.alias("before"), after.alias("after")).where("asked = 1")
    nearest = F.when(F.col("seconds") - F.col("before") <= F.col("after") - F.col("seconds"), F.col("before")).otherwise(F.coalesce("after", "before", "seconds"))
    return rows.select("track_id", nearest.alias("seconds"))


def merged(bounds: Column, least: Column) -> Column:
    """Boundaries in order without those nearer than least to the one kept before; the last stays, and the one before it goes if it is too near."""
    last = F.element_at(bounds, -1)
    kept = F.aggregate(F.slice(bounds, 2, F.size(bounds)), F.slice(bounds, 1, 1), lambda a, b: F.when((b - F.element_at(a, -1) >= least) | (b == last), F.concat(a, F.array(b))).otherwise(a))
    near = (F.size(kept) > 2) & (F.element_at(kept, -1) - F.get(kept, F.size(kept) - 2) < least)
    return F.when(near, F.concat(F.slice(kept, 1, F.size(kept) - 2), F.slice(kept, -1, 1))).otherwise(kept)


def boundaries(curve: DataFrame, tracks: DataFrame, downbeats: DataFrame, hop: int, least_bars: int = LEAST_BARS) -> DataFrame:
    """track_id, place, start, end of the sections of each of tracks (track_id, sr, seconds, bar: the length of a bar): they cover the track without a gap.

    curve: novelty(); downbeats: track_id, seconds. A boundary is a peak of at least the 55th percentile of what is above 0, as far as a section's
    shortest length from stronger ones, moved to the nearest downbeat. The shortest length is 4 bars, up to 8 in long tracks.
    """
    bars = F.greatest(F.lit(1), F.floor(F.col("seconds") / F.greatest("bar", F.lit(1e-6))))
    least = F.least(F.lit(2 * least_bars), F.greatest(F.lit(least_bars), F.floor(bars / 8)))
    tracks = tracks.select("track_id", "sr", "seconds", "bar", (least * F.col("bar")).alias("least"))
    each = curve.select("track_id", "start", F.posexplode("values").alias("k", "v")).select("track_id", (F.col("start") + F.col("k")).alias("frame"), "v")
    height = quantiles(each.where("v > 0"), "track_id", "v", HEIGHT)
    apart = F.greatest(F.lit(2.0), F.rint(F.col("least") * F.col("sr") / hop))
    rows = tops(each).join(height, "track_id").where("v >= quantile").join(tracks, "track_id")
    times = strongest(rows, apart).select("track_id", (F.col("frame") * hop / F.col("sr")).alias("seconds"))
    inner = snapped(times, downbeats).groupBy("track_id").agg(F.collect_set("seconds").alias("inner"))
    every = tracks.join(inner, "track_id", "left")
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("seconds").cast("double")), F.coalesce("inner", F.array().cast("array<double>")))))
    kept = every.select("track_id", merged(bounds, SLACK * F.col("least")).alias("b"))
    return kept.select("track_id", F.posexplode(F.arrays_zip(F.slice("b", 1, F.size("b") - 1).alias("start"), F.slice("b", 2, F.size("b")).alias("end"))).alias("place", "s")).select("track_id", "place", "s.start", "s.end")


def _asked(spans: DataFrame, cell: int) -> DataFrame:
    cells = F.sequence(F.floor(F.col("low") / cell), F.floor((F.greatest(F.col("high"), F.col("low") + 1) - 1) / cell))
    return spans.select("track_id", F.explode(cells).alias("cell"), F.struct("place", "low", "high").alias("a")).groupBy("track_id", "cell").agg(F.collect_list("a").alias("asked"))


def described(sections: DataFrame, clips: DataFrame, found: DataFrame, frames: Frames = FRAMES, cell: int = CELL) -> DataFrame:
    """sections (track_id, sr, place, start, end) with mean features (12 classes over their sum, 13 coefficients over the largest) and level."""
    carry = ("asked",)

    def means(c: Cell) -> list[tuple]:
        x = c.beyond(c.start, c.end).reshape(-1, WIDE)
        at = c.start // WIDE
        cut = ((a["place"], x[max(a["low"] // WIDE - at, 0) : max(a["high"] // WIDE - at, 0)]) for a in c.carried["asked"])
        return [(place, len(own), own.sum(axis=0).tolist()) for place, own in cut if len(own)]

    def powers(c: Cell) -> list[tuple]:
        x = c.beyond(c.start, c.end)
        cut = ((a["place"], x[max(a["low"] - c.start, 0) : max(a["high"] - c.start, 0)]) for a in c.carried["asked"])
        return [(place, len(own), float((own * own).sum())) for place, own in cut if len(own)]

    fps = F.col("sr") / frames.hop
    low = F.floor(F.col("start") * fps)
    spans = sections.select("track_id", "place", (low * WIDE).alias("low"), (F.greatest(F.floor(F.col("end") * fps), low + 1) * WIDE).alias("high"))
    wide = frames.cell * WIDE
    sums = kernelled(haloed(found.select("track_id", "sr", "start", "values"), wide, 0, 0, "start", "values").join(_asked(spans, wide), ["track_id", "cell"]), wide, means, "place int, n long, sums array<double>", carry)
    sums = sums.select("track_id", "place", "n", F.posexplode("sums").alias("d", "x")).groupBy("track_id", "place", "d").agg((F.sum("x") / F.sum("n")).alias("x"))
    sums = sums.groupBy("track_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    classes, timbre = F.slice("v", 1, 12), F.slice("v", 13, MFCC)
    total, most = F.greatest(F.aggregate(classes, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9)), F.greatest(F.array_max(F.transform(timbre, F.abs)), F.lit(1e-9))
    sums = sums.select("track_id", "place", F.concat(F.transform(classes, lambda x: x / total), F.transform(timbre, lambda x: x / most)).alias("v"))
    spans = sections.select("track_id", "place", F.floor(F.col("start") * F.col("sr")).alias("low"), F.floor(F.col("end") * F.col("sr")).alias("high"))
    power = kernelled(haloed(clips, cell, 0, 0).join(_asked(spans, cell), ["track_id", "cell"]), cell, powers, "place int, n long, power double", carry)
    power = power.groupBy("track_id", "place").agg(F.sqrt(F.sum("power") / F.sum("n")).alias("level"))
    nothing = F.array_repeat(F.lit(0.0), WIDE)
    return sections.join(sums, ["track_id", "place"], "left").join(power, ["track_id", "place"], "left").withColumn("v", F.coalesce("v", nothing)).withColumn("level", F.coalesce("level", F.lit(1e-6)))


def grouped(sections: DataFrame) -> DataFrame:
    """track_id, place, group: sections of a track whose mean features (v) are as near as the nearest 30 of 100 pairs of it, directly or by way of others; a group's name is its first place. The distances of one track's sections are in one task."""
    ship(sections.sparkSession)
    kind = sections.schema["track_id"].dataType.simpleString()

    def alike(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x = np.stack([np.asarray(v, float) for v in rows["v"]])
        n, group = len(x), np.arange(len(x))
        if n > 1:
            i, j = np.triu_indices(n, 1)
            far = np.concatenate([np.linalg.norm(x[i[k : k + 65536]] - x[j[k : k + 65536]], axis=1) for k in range(0, len(i), 65536)])
            near = far <= np.percentile(far, 100 * ALIKE)
            for a, b in zip(i[near], j[near], strict=True):
                if group[a] != group[b]:
                    group[group == max(group[a], group[b])] = min(group[a], group[b])
        return pd.DataFrame({"track_id": rows["track_id"].to_numpy(), "place": rows["place"].to_numpy(), "group": group})

    return sections.select("track_id", "place", "v").groupBy("track_id").applyInPandas(alike, f"track_id {kind}, place int, group long")


def segmented(clips: DataFrame, downbeats: DataFrame, bar: DataFrame, frames: Frames = FRAMES, chroma_size: int = CHROMA_SIZE, cell: int = CELL, half: int = HALF, least_bars: int = LEAST_BARS) -> DataFrame:
    """track_id, place, start, end, label, group, energy (level over the track's largest), rms_db and repeats (sections of the group) of clips with known downbeats (track_id, seconds) and length of a bar (track_id, bar).

    Tracks of which no bar is known are left out; one without a peak is one section. The tables between the steps are deleted.
    """
    bench = Workbench(clips.sparkSession)
    found = features(clips, bench, frames, chroma_size, cell)
    length = clips.where(F.col("sr").isNotNull() & (F.size("samples") > 0)).groupBy("track_id").agg(F.first("sr").alias("sr"), (F.max(F.col("start_sample") + F.size("samples")) / F.first("sr")).alias("seconds"))
    tracks = bench.put(length.join(bar.select("track_id", "bar"), "track_id").where("bar > 0"))
    cut = bench.put(boundaries(novelty(found, bench, half, frames.cell), tracks, downbeats, frames.hop, least_bars))
    rows = bench.put(described(cut.join(tracks.select("track_id", "sr"), "track_id"), clips, found, frames, cell))
    rows = rows.join(grouped(rows), ["track_id", "place"])
    own = Window.partitionBy("track_id")
    energy = F.col("level") / F.greatest(F.max("level").over(own), F.lit(1e-9))
    rows = rows.select("track_id", "place", "start", "end", "group", energy.alias("energy"), (20 * F.log10(F.greatest("level", F.lit(1e-6)))).alias("rms_db"), F.count("*").over(Window.partitionBy("track_id", "group")).alias("repeats"))
    out = bench.put(arrangement.labelled(bench.put(rows), "track_id", "place", "group", "energy"), keep=True)
    bench.clear()
    return out
