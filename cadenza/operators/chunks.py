"""Long series in chunks: kernels over frames that need some samples of the neighbours, so that no recording is ever in one piece.

A table of chunks has track_id, sr, a start and an array of values; chunks may overlap and be of any length. haloed() deals them onto a grid: a row
for each cell of it, with the samples around that a kernel needs. A frame belongs to the cell that its centre lies in, so each is worked out once, and the
results don't depend on how a recording was cut. Sums go on by aggregation; envelopes are tables of chunks again, at their frames' rate.

Rows without track, rate or values fall away; samples that no chunk has are zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import folds, spectra
from cadenza.session import Workbench, ship

#: Samples in a cell of the grid.
CELL = 1 << 16


@dataclass
class Cell:
    """Samples x from place `at` on, of which those from start to end are the cell's own; the track has total of them. carried: what else is known of the track."""

    x: np.ndarray
    at: int
    start: int
    end: int
    total: int
    rate: float
    carried: dict

    def beyond(self, low: int, high: int, fill: str = "zero") -> np.ndarray:
        """The samples from low to high, which may lie beyond the track's ends: zeros there, the last sample, or the track reflected."""
        i = np.arange(low, high)
        if fill == "edge":
            i = np.clip(i, 0, self.total - 1)
        elif fill == "reflect":
            turn = max(2 * (self.total - 1), 1)
            i = i % turn
            i = np.where(i > self.total - 1, turn - i, i)
        out = np.zeros((len(i), *self.x.shape[1:]))
        inside = (i >= self.at) & (i < self.at + len(self.x))
        out[inside] = self.x[i[inside] - self.at]
        return out

    def frames(self, size: int, hop: int, before: int = 0) -> tuple[int, np.ndarray]:
        """(number of the first one, frames x size) of the frames whose centres are the cell's own, and of so many before them. The track's end is a centre too."""
        first = -(-self.start // hop)
        last = self.end // hop if self.end == self.total else (self.end - 1) // hop
        first = max(first - before, 0)
        if last < first:
            return first, np.zeros((0, size))
        around = self.beyond(first * hop - size // 2, last * hop + size - size // 2, "reflect" if self.total > size // 2 else "zero")
        return first, np.lib.stride_tricks.sliding_window_view(around, size)[::hop]

    def magnitudes(self, size: int, hop: int, before: int = 0, block: int = 512) -> tuple[int, Iterator[np.ndarray]]:
        """(number of the first frame, bins x frames, some frames at a time)."""
        first, frames = self.frames(size, hop, before)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        return first, (np.abs(np.fft.rfft(frames[k : k + block] * window, axis=1)).T for k in range(0, len(frames), block))

    def own_frames(self, hop: int) -> int:
        """The number of the first frame whose centre is the cell's own."""
        return -(-self.start // hop)


def haloed(chunks: DataFrame, cell: int, before: int | Column, after: int | Column, start: str = "start_sample", values: str = "samples", carry: tuple[str, ...] = ()) -> DataFrame:
    """track_id, cell, sr, total, carried columns and parts (place, values) of each cell with the samples before and after it."""
    at, n = F.col(start), F.size(values)
    before, after = (c if isinstance(c, Column) else F.lit(c) for c in (before, after))
    rows = chunks.where(F.col("track_id").isNotNull() & F.col("sr").isNotNull() & (n > 0)).select("track_id", "sr", *carry, at.cast("long").alias("at"), F.col(values).alias("v"), before.cast("long").alias("before"), after.cast("long").alias("after"))
    end = F.col("at") + F.size("v")
    rows = rows.join(rows.groupBy("track_id").agg(F.max(end).alias("total")), "track_id")
    low = F.greatest(F.lit(0), F.floor((F.col("at") - F.col("after")) / cell))
    high = F.least(F.floor((F.col("total") - 1) / cell), F.floor((end - 1 + F.col("before")) / cell))
    rows = rows.select("*", F.explode(F.sequence(low, high)).alias("cell"))
    first = F.greatest("at", F.col("cell") * cell - F.col("before"))
    last = F.least(end, (F.col("cell") + 1) * cell + F.col("after"))
    part = F.struct(first.alias("at"), F.slice("v", (first - F.col("at") + 1).cast("int"), (last - first).cast("int")).alias("v"))
    rows = rows.where(last > first)
    return rows.groupBy("track_id", "cell").agg(*(F.first(c).alias(c) for c in ("sr", "total", *carry)), F.collect_list(part).alias("parts"))


def _array(values: pa.Array) -> np.ndarray:
    if pa.types.is_struct(values.type):
        return np.stack([f.to_numpy(zero_copy_only=False).astype(float) for f in values.flatten()], axis=1)
    return values.to_numpy(zero_copy_only=False).astype(float)


def kernelled(cells: DataFrame, cell: int, kernel: Callable[[Cell], list[tuple]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """track_id, sr and the rows that the kernel gives for each cell of haloed(); nulls in the samples count as zeros."""
    ship(cells.sparkSession)
    out = T.StructType([cells.schema["track_id"], cells.schema["sr"], *T.StructType.fromDDL(schema).fields])
    names = [f.name for f in out.fields]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out)
        for batch in batches:
            rows: list[tuple] = []
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                known = {n: columns[n][k].as_py() for n in ("track_id", "cell", "sr", "total", *carry)}
                parts = columns["parts"][k].values
                places, own = parts.field("at").to_pylist(), parts.field("v")
                low, high = min(places), max(p + len(v) for p, v in zip(places, own, strict=True))
                x = None
                for p, v in zip(places, own, strict=True):
                    v = np.nan_to_num(_array(v.values))
                    x = np.zeros((high - low, *v.shape[1:])) if x is None else x
                    x[p - low : p - low + len(v)] = v
                start = known["cell"] * cell
                of = Cell(x, low, start, min(start + cell, known["total"]), known["total"], known["sr"], {c: known[c] for c in carry})
                rows += [(known["track_id"], known["sr"], *r) for r in kernel(of)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kind)

    return cells.mapInArrow(task, out)


def halo(size: int, hop: int, before: int = 0) -> int:
    """The samples to each side that frames of that size need, with so many frames before the cell's own."""
    return size // 2 + 2 + before * hop


def moving_mean(cell: Cell, width: int, x: np.ndarray | None = None) -> np.ndarray:
    """The mean around each of the cell's own values, over an odd width, with zeros beyond the ends. x: the values of the cell and half a width to both sides."""
    half = width // 2
    x = cell.beyond(cell.start - half, cell.end + half) if x is None else x
    total = np.concatenate([[0.0], np.cumsum(x)])
    return (total[width:] - total[:-width]) / width


def scaled(chunks: DataFrame, values: str = "values") -> DataFrame:
    """Chunks over the track's largest value; a track without one above 0 stays as it is."""
    most = chunks.groupBy("track_id").agg(F.max(F.array_max(values)).alias("__most")).withColumn("__most", F.when(F.col("__most") > 0, F.col("__most")).otherwise(1.0))
    return chunks.join(most, "track_id").withColumn(values, F.transform(values, lambda v: v / F.col("__most"))).drop("__most")


_SUMS = ("samples", "power", "frames", "flat", "low", "voice", "whole", "clicks")
_PARTS = "start long, rise array<double>, sums array<double>, mfcc array<double>, peak double"


@lru_cache(maxsize=8)
def _bases(rate: float, size: int, n_mfcc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """What the measures of all cells of a rate need: mel banks for rises and for coefficients, cosines, and which bins the bands have."""
    hertz = np.fft.rfftfreq(size, 1 / rate)
    bands = [(hertz >= a) & (hertz < b) for a, b in ((20, 150), (300, 3400), (20, rate / 2))]
    return spectra.mel_bank(rate, size), spectra.mel_bank(rate, size, 40), spectra.cosines(n_mfcc, 40), bands


def _measured(size: int, hop: int, n_mfcc: int):
    def kernel(cell: Cell) -> list[tuple]:
        bank, voice_bank, basis, bands = _bases(cell.rate, size, n_mfcc)
        first, blocks = cell.magnitudes(size, hop, before=1)
        skip = cell.own_frames(hop) - first
        sums, mfcc, rises, last = np.zeros(len(_SUMS)), np.zeros(n_mfcc), [], None
        for m in blocks:
            mel = np.log1p(1000 * (bank @ m))
            rises.append(np.maximum(0, np.diff(mel, axis=1, prepend=mel[:, :1] if last is None else last)).sum(axis=0))
            last = mel[:, -1:]
            own = m[:, skip:]
            skip = 0
            power = own * own
            sums[2] += own.shape[1]
            sums[3] += (np.exp(np.log(power + 1e-12).mean(axis=0)) / (power + 1e-12).mean(axis=0)).sum()
            sums[4:7] += [power[b].sum() for b in bands]
            mfcc += (basis @ np.log1p(1000 * (voice_bank @ own))).sum(axis=1)
        rise = np.concatenate(rises)[cell.own_frames(hop) - first :] if rises else np.zeros(0)
        x = cell.x[cell.start - cell.at : cell.end - cell.at]
        sums[0], sums[1], sums[7] = len(x), float((x * x).sum()), len(cell_clicks(cell))
        return [(cell.own_frames(hop), rise.tolist(), sums.tolist(), mfcc.tolist(), float(np.abs(x).max(initial=0.0)))]

    return kernel


def _medians(d: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """The median of d around each of the places, half a width to both sides; a million values at a time."""
    windows, block = np.lib.stride_tricks.sliding_window_view(d, 2 * half + 1), max(1, (1 << 20) // (2 * half + 1))
    return np.concatenate([np.zeros(0), *(np.median(windows[at[k : k + block] - half], axis=1) for k in range(0, len(at), block))])


def cell_clicks(cell: Cell, short: float = 0.002, long: float = 0.05, limits: tuple[float, float, float] = (8.0, 12.0, 0.05), louder: float = 1.6) -> np.ndarray:
    """The samples of the cell before which a splice is; see spectra.clicks(). A jump that follows another within 5 ms belongs to that one."""
    rate = cell.rate
    apart, width = max(1, int(0.005 * rate)), max(8, int(0.02 * rate))
    half = [max(3, int(rate * s) | 1) // 2 for s in (short, long)]
    low, high = max(0, cell.start - apart), min(cell.end, cell.total - 1)
    if cell.total < 8 or high <= low:
        return np.zeros(0, int)
    x = cell.beyond(low - half[1], high + half[1] + 2)
    inner = np.arange(low - half[1], high + half[1] + 1)
    d = np.abs(np.diff(x))
    d[inner < 0] = d[inner == 0][0] if (inner < 0).any() else 0  # the differences' own ends are repeated
    if (inner > cell.total - 2).any():
        d[inner > cell.total - 2] = d[inner == cell.total - 2][0]
    own = d[half[1] : half[1] + high - low]
    candidate = np.flatnonzero(own > limits[2])
    for h, limit in zip(half, limits, strict=False):
        candidate = candidate[own[candidate] / (_medians(d, half[1] + candidate, h) + 1e-6) > limit]
    hit = candidate + low
    hit = hit[np.concatenate([[True], np.diff(hit) > apart])] if len(hit) else hit
    hit = hit[(hit >= cell.start) & (hit >= width) & (hit + 1 + width <= cell.total)]
    level = lambda a: np.array([(cell.beyond(k, k + width) ** 2).sum() for k in a])
    return hit[np.sqrt(level(hit + 1)) < louder * np.sqrt(np.maximum(level(hit - width), 1e-12))] if len(hit) else hit


def envelope_peaks(envelope: DataFrame, rate: Column, gap: float = 0.028, cell: int = 1 << 12) -> DataFrame:
    """track_id, frame, strength of the onsets of an envelope in chunks (track_id, sr, start, values); see spectra.onsets(). rate: frames a second, of sr."""
    rows = envelope.join(envelope.groupBy("track_id").agg(F.max(F.array_max("values")).alias("most")), "track_id").withColumn("fps", rate)

    def kernel(c: Cell) -> list[tuple]:
        half, most = (int(0.4 * c.carried["fps"]) | 1) // 2, c.carried["most"]
        if c.total < 3 or most <= 0:
            return []
        e = c.beyond(c.start - 2 * half - 1, c.end + 2 * half + 1, "edge")
        windows = np.lib.stride_tricks.sliding_window_view
        middle = np.median(windows(e, 2 * half + 1), axis=1)  # from start - half - 1 on
        places = np.arange(c.start - half - 1, c.end + half + 1)
        inside = (places >= 0) & (places < c.total)
        spread = np.abs(e[half:-half] - middle)
        spread[places < 0] = spread[inside][0]
        spread[places > c.total - 1] = spread[inside][-1]
        own = e[2 * half + 1 : -2 * half - 1]
        limit = middle[half + 1 : -half - 1] + 1.2 * np.median(windows(spread, 2 * half + 1), axis=1)[1:-1] + 0.02 * most
        left, right = e[2 * half : -2 * half - 2], e[2 * half + 2 : -2 * half]
        at = np.arange(c.start, c.end)
        peak = np.flatnonzero((own > left) & (own >= right) & (own > limit) & (at > 0) & (at < c.total - 1))
        bend = left[peak] - 2 * own[peak] + right[peak]
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (left[peak] - right[peak]) / np.where(bend == 0, 1, bend), 0.0)
        return [(int(c.start + k), float(own[k]), float(c.start + k + np.clip(s, -0.5, 0.5))) for k, s in zip(peak, shift, strict=True)]

    carry = ("most", "fps")
    wide = F.ceil(0.4 * F.col("fps")) + 4
    peaks = kernelled(haloed(rows, cell, wide, wide, "start", "values", carry), cell, kernel, "frame long, strength double, place double", carry)
    apart = F.greatest(F.lit(1), F.round(gap * rate)).cast("long") + 1
    # greedy_apart takes one distance for all: frames are counted in units of their track's own
    rows = peaks.withColumn("unit", apart).withColumn("t", F.col("frame") * 1_000_000 / F.col("unit"))
    chosen = folds.greedy_apart(rows, "track_id", "t", "strength", 999_999.5, also=("sr", "frame", "place"))  # whole frames of a unit are not always whole in floats
    return chosen.select("track_id", "sr", "frame", "strength", "place")


def measured(clips: DataFrame, size: int = spectra.SIZE, hop: int = spectra.HOP, n_mfcc: int = 13, cell: int = CELL) -> DataFrame:
    """For each track: seconds, peak_db, rms_db, flatness, low_share and voice_share (of the power from 20 Hz up: that below 150 Hz, and from 300 to 3400 Hz), onsets and clicks a minute, and the mean mfcc."""
    wide = F.greatest(F.lit(halo(size, hop, 1)), F.ceil(0.05 * F.col("sr")) + 4)
    bench = Workbench(clips.sparkSession)
    parts = bench.put(kernelled(haloed(clips, cell, wide, wide), cell, _measured(size, hop, n_mfcc), _PARTS))  # five steps read them
    fps = F.col("sr") / hop
    found = envelope_peaks(parts.select("track_id", "sr", "start", F.col("rise").alias("values")).where(F.size("values") > 0), fps).groupBy("track_id").agg(F.count("*").alias("found"))
    named = {n: F.sum(F.get("sums", F.lit(k))).alias(n) for k, n in enumerate(_SUMS)}
    coefficients = [F.sum(F.get("mfcc", F.lit(k))) for k in range(n_mfcc)]
    rows = parts.groupBy("track_id").agg(F.first("sr").alias("sr"), *named.values(), F.max("peak").alias("peak"), F.array(*(c / F.greatest(F.sum(F.get("sums", F.lit(2))), F.lit(1.0)) for c in coefficients)).alias("mfcc"))
    rows = rows.join(found, "track_id", "left")
    level = lambda v: 20 * F.log10(F.greatest(v, F.lit(1e-6)))
    minutes = F.greatest(F.col("samples") / F.col("sr") / 60, F.lit(1e-9))
    whole = F.greatest("whole", F.lit(1e-12))
    out = rows.select(
        "track_id", (F.col("samples") / F.col("sr")).alias("seconds"), level(F.col("peak")).alias("peak_db"), level(F.sqrt(F.col("power") / F.col("samples"))).alias("rms_db"), (F.col("flat") / F.col("frames")).alias("flatness"),
        (F.col("low") / whole).alias("low_share"), (F.col("voice") / whole).alias("voice_share"), (F.coalesce("found", F.lit(0)) / minutes).alias("onsets"), (F.col("clicks") / minutes).alias("clicks"), "mfcc",
    )
    out = bench.put(out, keep=True)
    bench.clear()
    return out


def pitched(clips: DataFrame, length: int = 8192, hop: int = 1024, low: float = 35.0, high: float = 180.0, clarity: float = 0.35, cell: int = CELL) -> DataFrame:
    """track_id, frame, seconds, hertz and clarity of the pitch around every hop: the lag of the strongest autocorrelation of a frame, 0 hertz where that is under the clarity wanted, the frame is silent or too short for the lowest pitch."""

    def kernel(c: Cell) -> list[tuple]:
        first, frames = c.frames(length, hop)
        least, most = max(1, int(c.rate / high)), min(length - 2, int(c.rate / low))
        out = []
        for k in range(0, len(frames), 256):
            x = frames[k : k + 256] - frames[k : k + 256].mean(axis=1, keepdims=True)
            spectrum = np.fft.rfft(x, 2 * length, axis=1)
            corr = np.fft.irfft(spectrum * spectrum.conj(), axis=1)[:, :length]
            usable = (corr[:, 0] > 1e-9) & (length >= 4 * int(c.rate / low)) & (most > least + 1)
            span = corr[:, least : max(most, least) + 1] / np.maximum(corr[:, :1], 1e-12)
            lag = span.argmax(axis=1)
            clear = span[np.arange(len(x)), lag]
            lag = lag + least
            a, b, d = (corr[np.arange(len(x)), np.clip(lag + s, 0, length - 1)] for s in (-1, 0, 1))
            bend = a - 2 * b + d
            shift = np.where(np.abs(bend) > 1e-12, np.clip(0.5 * (a - d) / np.where(bend == 0, 1, bend), -0.5, 0.5), 0.0)
            hertz = np.where(usable & (clear >= clarity), c.rate / np.maximum(lag + shift, 1e-9), 0.0)
            out += [(first + k + i, (first + k + i) * hop / c.rate, float(h), float(q if u else 0.0)) for i, (h, q, u) in enumerate(zip(hertz, clear, usable, strict=True))]
        return out

    wide = halo(length, hop)
    return kernelled(haloed(clips, cell, wide, wide), cell, kernel, "frame long, seconds double, hertz double, clarity double").drop("sr")


def levels(clips: DataFrame, size: int, hop: int, cell: int = CELL) -> DataFrame:
    """track_id, sr, start, values: the level of so many samples from each hop on, as far as there are that many."""

    def kernel(c: Cell) -> list[tuple]:
        first, last = -(-c.start // hop), min((c.end - 1) // hop, (c.total - size) // hop)
        if last < first:
            return []
        views = np.lib.stride_tricks.sliding_window_view(c.beyond(first * hop, last * hop + size), size)[::hop]
        return [(first, np.concatenate([np.sqrt((views[k : k + 256] ** 2).mean(axis=1)) for k in range(0, len(views), 256)]).tolist())]

    return kernelled(haloed(clips, cell, 0, size), cell, kernel, "start long, values array<double>")
