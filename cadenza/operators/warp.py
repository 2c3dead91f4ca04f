"""Warp maps as tables of knots: a detected beat grid pinned onto a target grid, bar one on bar one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a downbeat may be from a bar line and still be on it, in bars.
BAR_TOLERANCE = 1e-3


def knots(beats: DataFrame, grids: DataFrame, key: str) -> DataFrame:
    """key, k, t_in, t_out: where each beat (key, i, t) of a track comes to lie; grids: key, downbeat (0 to 3), bpm (the target's), multiple (target beats for a beat), duration.

    Beats are a constant step apart on the target. The lead-in is the fewest whole bars (two for a source in double time) that hold what
    comes before the first beat, so downbeats fall on downbeats. Head and tail go on at the track's own tempo. Fewer than two
    beats leave the track as it is.
    """
    line, all_of = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key)
    gaps = beats.select(key, "i", "t", (F.lead("t").over(line) - F.col("t")).alias("__gap"), F.count("*").over(all_of).alias("__n"))
    of = gaps.groupBy(key).agg(F.percentile("__gap", F.lit(0.5)).alias("__period"), F.min(F.struct("i", "t"))["t"].alias("__t0"), F.max(F.struct("i", "t"))["t"].alias("__t1"), F.max("__n").alias("__n"))
    g = grids.join(of, key, "left")
    step, rate = F.col("multiple") * 60.0 / F.greatest(F.col("bpm"), F.lit(1e-6)), F.col("__step") / F.greatest(F.col("__period"), F.lit(1e-9))
    grain = F.when(F.col("multiple") < 1.0, 8).otherwise(4)
    g = g.withColumn("__step", step).withColumn("__rate", rate).withColumn("__db", F.greatest(F.lit(0), F.least(F.lit(3), F.col("downbeat"))))
    g = g.withColumn("__lead", grain * F.ceil(F.greatest((F.col("__db") + 1).cast("double"), F.round(F.col("__db") + F.col("__t0") * F.col("__rate") / F.col("__step"), 9)) / grain))
    place = (F.row_number().over(line) - 1 - F.col("__db") + F.col("__lead")) * F.col("__step")
    own = beats.join(g.where("__n > 1"), key).select(key, F.col("t").alias("t_in"), place.alias("t_out"))
    head = F.greatest(F.lit(0.0), (F.col("__lead") - F.col("__db")) * F.col("__step") - F.col("__t0") * F.col("__rate"))
    last = (F.col("__n") - 1 - F.col("__db") + F.col("__lead")) * F.col("__step")
    end = F.greatest(F.col("duration"), F.col("__t1") + F.col("__period"))
    whole = F.coalesce(F.col("__n"), F.lit(0)) > 1
    least = F.greatest(F.col("duration"), F.lit(1.0))
    ends = F.when(whole, F.array(F.struct(F.lit(0.0).alias("t_in"), head.alias("t_out")), F.struct(end.alias("t_in"), (last + (end - F.col("__t1")) * F.col("__rate")).alias("t_out")))).otherwise(F.array(F.struct(F.lit(0.0).alias("t_in"), F.lit(0.0).alias("t_out")), F.struct(least.alias("t_in"), least.alias("t_out"))))
    every = own.unionByName(g.select(key, F.explode(ends).alias("x")).select(key, "x.t_in", "x.t_out"))
    order = Window.partitionBy(key).orderBy("t_in", "t_out")
    rising = F.max("t_out").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return every.select(key, (F.row_number().over(order) - 1).alias("k"), "t_in", rising.alias("t_out"))


def bar_lines(warped: Column, bar: Column) -> Column:
    """The bar line that a warped downbeat lies on; null if it is on none."""
    bars = warped / bar
    return F.when(F.abs(bars - F.round(bars)) < BAR_TOLERANCE, F.round(bars) * bar)


def bars_between(start: Column, end: Column, bar: Column) -> Column:
    """Whole bars of a warped span, one at least."""
    return F.greatest(F.lit(1), F.bround((end - start) / bar).cast("int"))
