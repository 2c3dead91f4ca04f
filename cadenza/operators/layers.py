"""Layers of a recording beside each other: where a voice's syllables begin, and events of one layer that another one doesn't have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import chunks
from cadenza.operators.chunks import CELL, Cell, haloed, kernelled
from cadenza.operators.sections import quantiles, strongest, tops
from cadenza.session import Workbench

# Samples of a level and between them, seconds between syllables, the share of a strong rise that is one, and the parabola through seven levels that smooths them.
SIZE, HOP, GAP, STRONG, SHARE = 1024, 256, 0.10, 0.95, 0.1
SMOOTH = np.array([-2, 3, 6, 7, 6, 3, -2]) / 21
# End of fixed values.


def _smoothed(c: Cell, low: int, high: int) -> np.ndarray:
    """The levels from low to high by the parabola through seven; the three at each end lie on that of the track's first or last seven."""
    out = np.convolve(c.beyond(low - 3, high + 3), SMOOTH, mode="valid")
    for begin, places in ((0, range(3)), (c.total - 7, range(c.total - 3, c.total))):
        at = [p for p in places if low <= p < high]
        if at:
            out[np.array(at) - low] = np.polyval(np.polyfit(np.arange(7), c.beyond(begin, begin + 7), 2), np.array(at) - begin)
    return out


def syllables(clips: DataFrame, size: int = SIZE, hop: int = HOP, cell: int = CELL, frames: int = 1 << 12) -> DataFrame:
    """track_id, frame, seconds, strength of the places where the level of recordings in chunks rises most: at least a tenth of the 95th percentile of all rises, and GAP seconds apart.

    Seconds are those of the middle of what the level adds there. Recordings of fewer than nine levels have none. The tables between the steps are deleted.
    """
    bench = Workbench(clips.sparkSession)
    level = bench.put(chunks.levels(clips, size, hop, cell))

    def rises(c: Cell) -> list[tuple]:
        if c.total < 9:
            return []
        low = max(c.start - 1, 0)
        x = np.diff(_smoothed(c, low, c.end), prepend=np.nan)[c.start - low :]
        return [(c.start, np.maximum(0.0, np.nan_to_num(x)).tolist())]

    found = bench.put(kernelled(haloed(level, frames, 8, 8, "start", "values"), frames, rises, "start long, values array<double>"))
    each = found.select("track_id", "sr", "start", F.posexplode("values").alias("k", "v")).select("track_id", "sr", (F.col("start") + F.col("k")).alias("frame"), "v")
    height = quantiles(each.where("v > 0"), "track_id", "v", STRONG).select("track_id", F.greatest(SHARE * F.col("quantile"), F.lit(1e-9)).alias("height"))
    rates = found.groupBy("track_id").agg(F.first("sr").alias("sr"))
    rows = tops(each.select("track_id", "frame", "v")).join(height, "track_id").where("v >= height").join(rates, "track_id")
    kept = strongest(rows, F.greatest(F.lit(1.0), F.floor(GAP * F.col("sr") / hop)))
    out = bench.put(kept.select("track_id", "frame", ((F.col("frame") * hop + (size - hop) / 2) / F.col("sr")).alias("seconds"), F.col("v").alias("strength")), keep=True)
    bench.clear()
    return out


def apart_from(rows: DataFrame, others: DataFrame, key: str, t: str, tolerance: float, block: float | None = None) -> DataFrame:
    """rows without those that have one of the others (key, t) of their key at most tolerance away, just as far included. Rows without key or time stay.

    Both are read once: time is cut into blocks, an other goes to each block that it can bear on, and within a sorted block the nearest ones
    before and after are carried along. A key of very many rows is dealt out by its blocks. block: their width, 1,000 tolerances if none is given.
    """
    wide = float(block or 1000 * tolerance or 1)
    place = lambda x: F.floor(x / wide)
    none = F.lit(None)
    mine = rows.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.col(t).cast("double").alias("__t"), place(F.col(t).cast("double")).alias("__block"), F.lit(1).alias("__mine"))
    at, reach = F.col(t).cast("double"), F.lit(tolerance) + F.abs(F.col(t).cast("double")) * 1e-12
    theirs = others.where(F.col(key).isNotNull() & at.isNotNull()).select(none.cast(mine.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), at.alias("__t"), F.explode(F.sequence(place(at - reach), place(at + reach))).alias("__block"), F.lit(0).alias("__mine"))
    own = Window.partitionBy("__key", "__block")
    known = F.when(F.col("__mine") == 0, F.col("__t"))
    nearest = lambda line: F.last(known, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    both = mine.unionByName(theirs).select("*", nearest(own.orderBy("__t", "__mine")).alias("__before"), nearest(own.orderBy(F.desc("__t"), "__mine")).alias("__after"))
    near = (F.col("__t") - F.col("__before") <= tolerance) | (F.col("__after") - F.col("__t") <= tolerance)
    return both.where((F.col("__mine") == 1) & ~F.coalesce(near, F.lit(False))).select("__row.*")
