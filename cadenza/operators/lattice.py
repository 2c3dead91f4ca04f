"""Measures against a regular lattice of times: no join is needed, the nearest point is arithmetic.

Times are microseconds (long), so that folding is exact; groups are the given columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import Workbench, ship


def phase_error(t: Column, step: int, origin: Column | int = 0) -> Column:
    """Signed distance to the nearest lattice point, in the unit of t; a tie goes to the lower point."""
    rest = F.pmod(t - origin, F.lit(step))
    return F.when(2 * rest <= step, rest).otherwise(rest - step)


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, order: str, at: dict[str, float]) -> DataFrame:
    """keys and one column for each named quantile, interpolated between mid-cumulative weights and clamped at the ends.

    order breaks ties. Weights are at least 1e-12. One shuffle by keys; each quantile is an aggregate over the two rows around it.
    """
    by = Window.partitionBy(*keys)
    line = by.orderBy(value, order)
    w = F.greatest(F.col(weight).cast("double"), F.lit(1e-12))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), w.alias("__w"), (F.sum(w).over(line.rowsBetween(Window.unboundedPreceding, 0)) - w / 2).alias("__c"), F.sum(w).over(by).alias("__total"), F.lead(F.col(value).cast("double")).over(line).alias("__next"), F.lead(w).over(line).alias("__next_w"), F.row_number().over(line).alias("__k"))

    def one(q: float) -> Column:
        target, after = F.col("__total") * q, F.col("__c") + (F.col("__w") + F.col("__next_w")) / 2
        inside = (F.col("__c") <= target) & ((target < after) | F.col("__next").isNull())
        part = F.coalesce((target - F.col("__c")) / (after - F.col("__c")), F.lit(0.0))
        low = (F.col("__k") == 1) & (target < F.col("__c"))
        return F.max(F.when(low, F.col("__v")).when(inside, F.col("__v") + part * (F.coalesce("__next", "__v") - F.col("__v"))))

    return rows.groupBy(*keys).agg(*(one(q).alias(c) for c, q in at.items()))


def free_phase_fraction(rows: DataFrame, keys: list[str], t: str, weight: str, step: int, tolerance: int) -> DataFrame:
    """keys and fraction: the largest share of weight within a window of twice the tolerance, over all phases of the lattice.

    Folded times are repeated once, one step later; a window may begin at the times of the first copy only.
    """
    folded = rows.select(*keys, F.pmod(F.col(t), F.lit(step)).alias("__r"), F.col(weight).cast("double").alias("__w"))
    both = folded.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__copy")).withColumn("__r", F.col("__r") + F.col("__copy") * step)
    window = Window.partitionBy(*keys).orderBy("__r").rangeBetween(0, 2 * tolerance)
    best = both.select(*keys, "__copy", "__w", F.sum("__w").over(window).alias("__in")).groupBy(*keys).agg(F.max(F.when(F.col("__copy") == 0, F.col("__in"))).alias("__best"), F.sum(F.when(F.col("__copy") == 0, F.col("__w"))).alias("__total"))
    return best.select(*keys, F.least(F.lit(1.0), F.col("__best") / F.greatest("__total", F.lit(1e-12))).alias("fraction"))


def circular_mean(angle: Column, weight: Column) -> tuple[Column, Column]:
    """Aggregates: the weighted mean direction in radians, and the length of the resultant, 0 to 1."""
    s, c = F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle))
    return F.atan2(s, c), F.sqrt(s * s + c * c) / F.greatest(F.sum(weight), F.lit(1e-12))


def phase_report(rows: DataFrame, keys: list[str], t: str, weight: str, order: str, step: int, close: int, limits: tuple[float, float, float]) -> DataFrame:
    """For each group: onsets, weighted and plain figures of the distance to the lattice (milliseconds), the list of problems, and ok.

    limits: the largest median and 90th percentile, and the smallest weighted share within the closest distance.
    """
    rows = rows.withColumn("__e", phase_error(F.col(t), step)).withColumn("__a", F.abs("__e") / 1000.0)
    near = F.col("__a") <= close / 1000.0
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("onsets"), (F.sum(F.when(near, F.col(weight)).otherwise(0.0)) / F.greatest(F.sum(weight), F.lit(1e-12))).alias("within"),
        F.percentile("__a", F.lit(0.5)).alias("median_plain"), F.percentile("__a", F.lit(0.9)).alias("p90_plain"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("within_plain"), (F.avg("__e") / 1000.0).alias("mean_signed"),
    )
    out = plain.join(weighted_quantiles(rows, keys, "__a", weight, order, {"median": 0.5, "p90": 0.9}), keys)
    problems = F.filter(F.array(F.when(F.col("median") > limits[0], "median"), F.when(F.col("p90") > limits[1], "p90"), F.when(F.col("within") < limits[2], "within")), lambda x: x.isNotNull())
    return out.withColumn("problems", F.array_join(problems, ",")).withColumn("ok", F.col("problems") == "")


#: Places of a beat that a comb tells apart, and how far it smears an onset.
COMB_BINS, COMB_WIDTH = 480, 8
#: How much stronger the half beat must be than the beat, and how far off the beat still is the grid, as a share of it.
HALF_BEAT, ON_BEAT = 1.35, 0.10


def comb(rows: DataFrame, keys: list[str], t: str, weight: str, beat: int) -> DataFrame:
    """keys, offset (a share of the beat, from -1/4 to 1/4), sharpness, half_ratio, alignment (grid, offset or half-beat): where a comb of beats fits best.

    Onsets are folded into COMB_BINS places of a beat, so a group is one row of that many places at most, however many onsets it has; the comb
    is tried at 121 offsets, for some groups at a time by a matrix product. The first of equal offsets counts; a group without any weight has no offset.
    """
    ship(rows.sparkSession)
    place = F.floor(F.pmod(F.col(t), F.lit(beat)) * COMB_BINS / beat).cast("int")
    folded = rows.groupBy(*keys, place.alias("__p")).agg(F.sum(F.col(weight).cast("double")).alias("__w"))
    groups = folded.groupBy(*keys).agg(F.collect_list(F.when(F.col("__p").isNotNull() & F.col("__w").isNotNull(), F.struct(F.col("__p").alias("p"), F.col("__w").alias("w")))).alias("__places"))
    tried = np.array([*range(-COMB_BINS // 4, COMB_BINS // 4 + 1, COMB_BINS // 240), COMB_BINS // 2])
    away = (np.arange(COMB_BINS)[:, None] - tried) % COMB_BINS
    fit = np.maximum(0.0, 1 - np.minimum(away, COMB_BINS - away) / COMB_WIDTH)
    out = T.StructType([*(groups.schema[k] for k in keys), *T.StructType.fromDDL("__o int, __s double, __mean double, __on double, __half double").fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                places = block.column(len(keys))
                sizes = np.diff(places.offsets.to_numpy())
                own = places.flatten()
                weights = np.zeros((block.num_rows, COMB_BINS))
                weights[np.repeat(np.arange(block.num_rows), sizes), own.field("p").to_numpy(zero_copy_only=False)] = own.field("w").to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore"):
                    scores = weights @ fit
                near, none = np.round(scores[:, :-1], 9), sizes == 0
                best = np.where(np.isnan(near), np.inf, near).argmax(axis=1)  # what is no number is above all, as in Spark
                found = (near[np.arange(len(best)), best], scores[:, :-1].mean(axis=1), np.maximum(scores[:, len(tried) // 2 - 1], 1e-9), scores[:, -1])
                columns = [pa.array(tried[best].astype(np.int32), mask=none), *(pa.array(c, mask=none) for c in found)]
                yield pa.RecordBatch.from_arrays([*(block.column(k) for k in range(len(keys))), *columns], names=out.names)

    sums = groups.select(*keys, "__places").mapInArrow(task, out)
    offset, ratio = F.col("__o") / COMB_BINS, F.col("__half") / F.col("__on")
    where = F.when(ratio > HALF_BEAT, "half-beat").when(F.abs(offset) < ON_BEAT, "grid").otherwise("offset")
    return sums.select(*keys, offset.alias("offset"), ((F.col("__s") - F.col("__mean")) / F.greatest(F.col("__s"), F.lit(1e-9))).alias("sharpness"), ratio.alias("half_ratio"), where.alias("alignment"))


def bar_phase(beats: DataFrame, key: str, i: str, value: str, beats_per_bar: int = 4, window_bars: int = 8) -> DataFrame:
    """key, phase, margin and confidence: which beat is the first of the bar by its mean value, and how many whole windows of bars agree (all of them where there is none). Fewer than two bars tell nothing: 0."""
    window = beats_per_bar * window_bars
    phase = F.pmod(F.col(i), F.lit(beats_per_bar)).alias("phase")
    means = beats.groupBy(key, phase).agg(F.avg(value).alias("s"), F.count("*").alias("n"))
    own = Window.partitionBy(key)
    ranks = means.withColumn("k", F.row_number().over(own.orderBy(F.desc("s"), "phase")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    whole = ranks.groupBy(key).agg(pick(1, "phase").alias("phase"), pick(1, "s").alias("s1"), pick(2, "s").alias("s2"), F.min("s").alias("s4"), (F.sum("n") >= 2 * beats_per_bar).alias("enough"))
    parts = beats.groupBy(key, F.floor(F.col(i) / window).alias("w"), phase).agg(F.avg(value).alias("s"), F.count("*").alias("n"))
    votes = parts.groupBy(key, "w").agg(F.max(F.struct("s", (-F.col("phase")).alias("p"))).alias("m"), F.sum("n").alias("n")).where(F.col("n") == window).select(key, (-F.col("m.p")).alias("vote"))
    hit = F.when(F.col("vote") == F.col("phase"), 1.0).when(F.col("vote").isNotNull(), 0.0)
    agree = whole.join(votes, key, "left").groupBy(key).agg(F.avg(hit).alias("agree"))
    margin = (F.col("s1") - F.col("s2")) / F.greatest(F.abs("s1"), F.col("s1") - F.col("s4"), F.lit(1e-9))
    told = lambda c, other: F.when(F.col("enough"), c).otherwise(other)
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 4 * margin)) * F.coalesce("agree", F.lit(1.0))
    return whole.join(agree, key).select(key, told(F.col("phase"), F.lit(0)).alias("phase"), told(margin, F.lit(0.0)).alias("margin"), told(sure, F.lit(0.0)).alias("confidence"))


#: How concentrated the eighth-note phase must be for a lag to be read from it; bars of a voting window, and syllables in it that count.
LAG_CONCENTRATION, VOTE_BARS, VOTE_LEAST = 0.08, 4, 6


def triplet_evidence(rows: DataFrame, keys: list[str], t: str, weight: str, beat: int, least: int = 8) -> DataFrame:
    """keys, onsets, lag (a share of the beat), triplet_share and triplet_windows: whether off-grid onsets sit on thirds or on quarters of a beat, after a constant lag is taken off, and in how many windows thirds win. Fewer onsets than least say 0, 0.5 and 0."""
    by = Window.partitionBy(*keys)
    w, phase = F.col(weight).cast("double"), F.pmod(F.col(t), F.lit(beat)) / beat
    rows = rows.select(*keys, F.floor(F.col(t) / (VOTE_BARS * 4 * beat)).alias("__b"), w.alias("__w"), phase.alias("__f"))
    turn = 4 * 3.141592653589793 * F.col("__f")
    rows = rows.select("*", F.sum(F.col("__w") * F.sin(turn)).over(by).alias("__y"), F.sum(F.col("__w") * F.cos(turn)).over(by).alias("__x"), F.sum("__w").over(by).alias("__all"), F.count("*").over(by).alias("__n"))
    firm = F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")) > LAG_CONCENTRATION * F.col("__all")
    rows = rows.withColumn("__lag", F.when((F.col("__n") >= least) & firm, F.atan2("__y", "__x") / (4 * 3.141592653589793)).otherwise(0.0))
    place = F.pmod(F.bround(F.pmod(F.col("__f") - F.col("__lag"), F.lit(1.0)) * 12).cast("int"), F.lit(12))
    rows = rows.withColumn("__p", place).withColumn("__third", F.col("__p").isin(4, 8)).withColumn("__quarter", F.col("__p").isin(3, 9))
    own = lambda c: F.sum(F.when(F.col(c), F.col("__w")).otherwise(0.0))
    parts = rows.groupBy(*keys, "__b").agg(own("__third").alias("__t"), own("__quarter").alias("__q"), F.count_if(F.col("__third") | F.col("__quarter")).alias("__c"), F.count("*").alias("__n"), F.first("__lag").alias("__lag"))
    vote = F.when(F.col("__c") >= VOTE_LEAST, (F.col("__t") > F.col("__q")).cast("double"))
    out = parts.groupBy(*keys).agg(F.sum("__n").alias("onsets"), F.first("__lag").alias("lag"), F.sum("__t").alias("__t"), F.sum("__q").alias("__q"), F.avg(vote).alias("__v"))
    enough = (F.col("onsets") >= least) & (F.col("__t") + F.col("__q") > 0)
    return out.select(*keys, "onsets", "lag", F.when(enough, F.col("__t") / (F.col("__t") + F.col("__q"))).otherwise(0.5).alias("triplet_share"), F.when(enough, F.coalesce("__v", F.lit(0.0))).otherwise(0.0).alias("triplet_windows"))


def lattice_shares(rows: DataFrame, keys: list[str], t: str, weight: str, beat: int, tolerance: int) -> DataFrame:
    """keys, straight, triplet, advantage and scatter: the weighted shares within a tolerance of four and of six places in a beat, and the median distance to the four of those that are farther."""
    w, off = F.col(weight).cast("double"), lambda n: F.abs(phase_error(F.col(t), beat // n))
    share = lambda n: F.sum(F.when(off(n) <= tolerance, w).otherwise(0.0)) / F.greatest(F.sum(w), F.lit(1e-12))
    out = rows.groupBy(*keys).agg(share(4).alias("straight"), share(6).alias("triplet"), F.coalesce(F.percentile(F.when(off(4) > tolerance, off(4)), F.lit(0.5)), F.lit(0.0)).alias("scatter"))
    return out.withColumn("advantage", F.col("triplet") - F.col("straight"))


def layer_report(rows: DataFrame, key: str, t: str, weight: str, order: str, beat: int, division: int = 4, close: int = 20_000, limits: tuple[float, float, float] = (12.0, 25.0, 0.85), source: bool = True) -> DataFrame:
    """All measures of a layer of onsets against its grid, and what is wrong with it: phase_report(), comb() and bar_phase() of each group.

    The strength of a beat is the weight of the onsets nearest to it. The 90th percentile and the share within the limit are judged only for a
    source layer; a comb counts if it is sharp, a bar phase if its margin is clear. Each measure is stored, as a task that joins them would hold the sorted rows of all.
    """
    bench = Workbench(rows.sparkSession)
    phase = phase_report(rows, [key], t, weight, order, beat // division, close, limits).drop("problems", "ok")
    near = rows.select(key, F.floor((F.col(t) + beat // 2) / beat).alias("__i"), F.col(weight).cast("double").alias("__w")).groupBy(key, "__i").agg(F.sum("__w").alias("__w"))
    bars = bar_phase(near, key, "__i", "__w").select(key, F.col("phase").alias("bar_phase"), F.col("margin").alias("bar_margin"))
    phase, combed, bars = bench.put(phase), bench.put(comb(rows, [key], t, weight, beat)), bench.put(bars)
    out = phase.join(combed, key).join(bars, key).withColumn("division", F.lit(division))
    judged = lambda c: c if source else F.lit(False)
    found = {
        "median": F.col("median") > limits[0], "p90": judged(F.col("p90") > limits[1]), "within": judged(F.col("within") < limits[2]),
        "beat": (F.col("alignment") != "grid") & (F.col("sharpness") > 0.05), "bar": (F.col("bar_phase") != 0) & (F.col("bar_margin") > 0.08),
    }
    problems = F.filter(F.array(*(F.when(c, k) for k, c in found.items())), lambda x: x.isNotNull())
    out = bench.put(out.withColumn("problems", F.array_join(problems, ",")).withColumn("ok", F.col("problems") == ""), keep=True)
    bench.clear()
    return out


def kick_collision(rows: DataFrame, keys: list[str], t: str, weight: str, beat: int, tolerance: int = 40_000) -> DataFrame:
    """keys, hits, per_bar, on_beat and off_eighth: how often a bass part hits in a bar of its time, and the weighted shares on the beat and off the eighths."""
    w, off = F.col(weight).cast("double"), lambda n: F.abs(phase_error(F.col(t), beat // n))
    total = F.greatest(F.sum(w), F.lit(1e-12))
    bars = F.greatest((F.max(t) - F.min(t)) / (4.0 * beat), F.lit(1e-9))
    return rows.groupBy(*keys).agg(F.count("*").alias("hits"), (F.count("*") / bars).alias("per_bar"), (F.sum(F.when(off(1) <= tolerance, w).otherwise(0.0)) / total).alias("on_beat"), (F.sum(F.when(off(2) > tolerance, w).otherwise(0.0)) / total).alias("off_eighth"))
