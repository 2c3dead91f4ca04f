"""Joins that are not equalities: backward as-of, nearest, intervals, piecewise maps, concurrency of spans, best cosine.

As-of and nearest matches are a union and a window, sorted once by key and time, so each side is shuffled once and nothing is
compared pairwise. Interval matches become equalities on the buckets that an interval covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    a = left.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(F.col(t).alias("t"), *columns)).schema[0].dataType).alias("__hit"))
    b = right.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(F.col(t).alias("t"), *columns).alias("__hit"))
    return a.unionByName(b)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], first_if_none: bool = False) -> DataFrame:
    """left with the columns of the right row of the same keys that is the latest at or before its time; before all of them null, or the first.

    Right rows of one time: the largest of the columns. Both sides have the keys and t.
    """
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__hit")
    rows = _merged(left, right, keys, t, columns)
    hit = F.last("__hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if first_if_none:
        hit = F.coalesce(hit, F.first("__hit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return rows.withColumn("__found", hit).where("__side = 1").select("__row.*", *(F.col(f"__found.{c}").alias(c) for c in columns))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], distance: str = "distance") -> DataFrame:
    """left with the columns of the right row nearest in time, and its signed distance (left less right); a tie goes to the earlier."""
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__hit")
    rows = _merged(left, right, keys, t, columns)
    before = F.last("__hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__hit", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__b", before).withColumn("__a", after).where("__side = 1")
    late = F.col("__b").isNull() | (F.col("__a.t") - F.col("__t") < F.col("__t") - F.col("__b.t"))
    return rows.withColumn("__found", F.when(late, F.col("__a")).otherwise(F.col("__b"))).select("__row.*", *(F.col(f"__found.{c}").alias(c) for c in columns), (F.col("__t") - F.col("__found.t")).alias(distance))


def interval_join(points: DataFrame, spans: DataFrame, t: str, start: str, end: str, bucket: int, how: str = "left", broadcast: bool = False) -> DataFrame:
    """points with the spans whose half-open range [start, end) holds t, matched on buckets of that width. Whole numbers only."""
    b = spans.select("*", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / bucket))).alias("__b"))
    b = F.broadcast(b) if broadcast else b
    p = points.withColumn("__b", F.floor(F.col(t) / bucket))
    return p.join(b, (p["__b"] == b["__b"]) & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end)), how).drop("__b")


def mapped(points: DataFrame, knots: DataFrame, keys: list[str], t: str, source: str, target: str, out: str) -> DataFrame:
    """points with t mapped by the piecewise-linear function through the knots (source strictly rising), clamped outside."""
    line = Window.partitionBy(*keys).orderBy(source)
    k = knots.select(*keys, F.col(source).alias(t), F.col(target).cast("double").alias("__y"), F.lead(F.col(source)).over(line).alias("__x1"), F.lead(F.col(target).cast("double")).over(line).alias("__y1"), F.col(source).alias("__x"))
    rows = asof_backward(points, k, keys, t, ["__x", "__y", "__x1", "__y1"], first_if_none=True)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col("__x")) / (F.col("__x1") - F.col("__x"))))
    return rows.withColumn(out, F.col("__y") + F.coalesce(part, F.lit(0.0)) * (F.coalesce("__y1", "__y") - F.col("__y"))).drop("__x", "__y", "__x1", "__y1")


def concurrency(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end, live: between neighbouring edges the number of half-open spans there. Spans that are empty count nowhere."""
    edges = spans.where(F.col(end) > F.col(start)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    sums = edges.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy(*keys).orderBy("start")
    return sums.select(*keys, "start", F.lead("start").over(line).alias("end"), F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("live")).where("end is not null")


def unit(vector: Column) -> Column:
    """An array of numbers as doubles of length 1; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(size, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best_cosine(windows: DataFrame, bank: DataFrame, vector: str, most: int = 4096) -> DataFrame:
    """windows with best: the largest cosine with a vector of the bank. The bank is a reference set of a fixed size, which is checked, and is broadcast."""
    if bank.limit(most + 1).count() > most:
        raise ValueError(f"a bank has at most {most} vectors")
    one = bank.agg(F.collect_list(unit(F.col(vector))).alias("__bank"))
    rows = windows.withColumn("__u", unit(F.col(vector))).join(F.broadcast(one))
    return rows.withColumn("best", F.array_max(F.transform("__bank", lambda b: dot(F.col("__u"), b)))).drop("__u", "__bank")
