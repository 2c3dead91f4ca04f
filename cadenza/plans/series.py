"""Queries over time series and vectors. Each takes (spark, sf_dir); ORACLES holds their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import folds, lattice, layers, matching, signal
from cadenza.sources.tables import micros, table

SECOND = 1_000_000
HOUR = 3600 * SECOND


def _events(spark, sf_dir, *more) -> DataFrame:
    """event_id, user_id, t (microseconds), value and more columns."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("t"), "value", *more)


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 places."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


E_ = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, event_type, props FROM events)"


@query(f"WITH {E_}, r AS (SELECT *, (t % 3600000000) AS m FROM e) SELECT event_id, user_id, CASE WHEN 2 * m <= 3600000000 THEN m ELSE m - 3600000000 END AS error FROM r")
def lattice_phase_error(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", "user_id", lattice.phase_error(F.col("t"), HOUR).alias("error"))


_REPORT = f"""
WITH {E_}, r AS (SELECT *, (t % 3600000000) AS m FROM e),
     x AS (SELECT *, (CASE WHEN 2 * m <= 3600000000 THEN m ELSE m - 3600000000 END) / 1000.0::DOUBLE AS e, (CASE WHEN 2 * m <= 3600000000 THEN m ELSE m - 3600000000 END) AS err, greatest(value, 1e-12) AS w FROM r),
     a AS (SELECT *, abs(e) AS a FROM x),
     c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) - w / 2 AS c, sum(w) OVER (PARTITION BY user_id) AS total,
                  row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM a),
     p AS (SELECT *, lead(c) OVER (PARTITION BY user_id ORDER BY k) AS c1, lead(a) OVER (PARTITION BY user_id ORDER BY k) AS a1 FROM c),
     q AS (SELECT user_id, q, max(CASE WHEN k = 1 AND q * total < c THEN a WHEN c <= q * total AND c1 IS NULL THEN a
                                       WHEN c <= q * total AND q * total < c1 THEN a + (q * total - c) / (c1 - c) * (a1 - a) END) AS v
           FROM p, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) AS z(q) GROUP BY user_id, q),
     g AS (SELECT user_id, count(*) AS onsets, sum(CASE WHEN a <= 300000 THEN value ELSE 0 END) / greatest(sum(value), 1e-12) AS within, quantile_cont(a, 0.5) AS median_plain,
                  quantile_cont(a, 0.9) AS p90_plain, avg(CASE WHEN a <= 300000 THEN 1.0 ELSE 0.0 END) AS within_plain, avg(err) / 1000 AS mean_signed FROM a GROUP BY user_id),
     j AS (SELECT g.*, m.v AS median, n.v AS p90 FROM g JOIN q m ON m.user_id = g.user_id AND m.q = 0.5 JOIN q n ON n.user_id = g.user_id AND n.q = 0.9),
     l AS (SELECT *, concat_ws(',', CASE WHEN median > 900000 THEN 'median' END, CASE WHEN p90 > 1600000 THEN 'p90' END, CASE WHEN within < 0.15 THEN 'within' END) AS problems FROM j)
SELECT user_id, onsets, round(within, 6) AS within, round(median_plain, 6) AS median_plain, round(p90_plain, 6) AS p90_plain, round(within_plain, 6) AS within_plain,
       round(mean_signed, 6) AS mean_signed, round(median, 6) AS median, round(p90, 6) AS p90, problems, problems = '' AS ok FROM l"""


@query(_REPORT)
def alignment_report(spark, sf_dir):
    return r6(lattice.phase_report(_events(spark, sf_dir), ["user_id"], "t", "value", "event_id", HOUR, 300 * SECOND, (900_000.0, 1_600_000.0, 0.15)))


@query("""
WITH a AS (SELECT l_suppkey, l_extendedprice AS v, greatest(l_quantity, 1e-12) AS w, l_orderkey * 100 + l_linenumber AS o FROM lineitem),
     c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v, o ROWS UNBOUNDED PRECEDING) - w / 2 AS c, sum(w) OVER (PARTITION BY l_suppkey) AS total,
                  row_number() OVER (PARTITION BY l_suppkey ORDER BY v, o) AS k FROM a),
     p AS (SELECT *, lead(c) OVER (PARTITION BY l_suppkey ORDER BY k) AS c1, lead(v) OVER (PARTITION BY l_suppkey ORDER BY k) AS v1 FROM c),
     q AS (SELECT l_suppkey, q, max(CASE WHEN k = 1 AND q * total < c THEN v WHEN c <= q * total AND c1 IS NULL THEN v
                                         WHEN c <= q * total AND q * total < c1 THEN v + (q * total - c) / (c1 - c) * (v1 - v) END) AS x
           FROM p, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS z(q) GROUP BY l_suppkey, q)
SELECT l_suppkey, round(max(CASE WHEN q = 0.1 THEN x END), 6) AS p10, round(max(CASE WHEN q = 0.5 THEN x END), 6) AS p50, round(max(CASE WHEN q = 0.9 THEN x END), 6) AS p90 FROM q GROUP BY l_suppkey""")
def weighted_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"))
    return r6(lattice.weighted_quantiles(rows, ["l_suppkey"], "l_extendedprice", "l_quantity", "o", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@query(f"""
WITH {E_}, d AS (SELECT user_id, t // 604800000000 AS w, t % 3600000000 AS r, value FROM e), n AS (SELECT user_id, w FROM d GROUP BY user_id, w HAVING count(*) >= 4),
     b AS (SELECT d.*, 0 AS copy FROM d SEMI JOIN n USING (user_id, w) UNION ALL SELECT user_id, w, r + 3600000000, value, 1 FROM d SEMI JOIN n USING (user_id, w)),
     s AS (SELECT *, sum(value) OVER (PARTITION BY user_id, w ORDER BY r RANGE BETWEEN CURRENT ROW AND 600000000 FOLLOWING) AS i FROM b),
     f AS (SELECT user_id, w, least(1.0, max(CASE WHEN copy = 0 THEN i END) / greatest(sum(CASE WHEN copy = 0 THEN value END), 1e-12)) AS f, sum(CASE WHEN copy = 0 THEN value END) AS v FROM s GROUP BY user_id, w)
SELECT user_id, count(*) AS windows, round(sum(f * v) / sum(v), 6) AS fraction FROM f GROUP BY user_id""")
def windowed_grid_fraction(spark, sf_dir):
    """Free-phase adherence to the hour in weekly windows of 4 events at least, weighted by the windows' sums."""
    e = _events(spark, sf_dir).withColumn("w", F.floor(F.col("t") / (168 * HOUR)))
    own = Window.partitionBy("user_id", "w")
    e = e.select("*", F.count("*").over(own).alias("n")).where("n >= 4")
    part = lattice.free_phase_fraction(e, ["user_id", "w"], "t", "value", HOUR, 300 * SECOND)
    sums = e.groupBy("user_id", "w").agg(F.sum("value").alias("v"))
    return r6(part.join(sums, ["user_id", "w"]).groupBy("user_id").agg(F.count("*").alias("windows"), (F.sum(F.col("fraction") * F.col("v")) / F.sum("v")).alias("fraction")))


@query(f"""
WITH {E_}, b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, value FROM e), m AS (SELECT user_id, i % 4 AS phase, avg(value) AS s FROM b GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, phase) AS k FROM m),
     g AS (SELECT user_id, max(CASE WHEN k = 1 THEN phase END) AS phase, max(CASE WHEN k = 1 THEN s END) AS s1, max(CASE WHEN k = 2 THEN s END) AS s2, min(s) AS s4 FROM r GROUP BY user_id),
     v AS (SELECT user_id, i // 32 AS w, i % 4 AS phase, avg(value) AS s, count(*) AS n FROM b GROUP BY ALL), x AS (SELECT user_id, w, first(phase ORDER BY s DESC, phase) AS phase FROM v GROUP BY user_id, w HAVING sum(n) = 32),
     a AS (SELECT g.user_id, coalesce(avg(CASE WHEN x.phase = g.phase THEN 1.0 WHEN x.phase IS NOT NULL THEN 0.0 END), 1.0) AS agree FROM g LEFT JOIN x USING (user_id) GROUP BY g.user_id)
SELECT user_id, coalesce(phase, 0) AS phase, round(coalesce((s1 - s2) / greatest(abs(s1), s1 - s4, 1e-9), 0), 6) AS margin, round(coalesce(least(1.0, greatest(0.0, 4 * (s1 - s2) / greatest(abs(s1), s1 - s4, 1e-9))) * agree, 0), 6) AS confidence
FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN (SELECT g.*, agree FROM g JOIN a USING (user_id) WHERE user_id IN (SELECT user_id FROM b GROUP BY user_id HAVING count(*) >= 8)) USING (user_id)""")
def bar_phase_vote(spark, sf_dir):
    """Which of four beats is the first of the bar: the strongest on average, its margin, and how many whole 8-bar windows agree (all of them where there is none). Fewer than two bars tell nothing."""
    beat = _events(spark, sf_dir).select("user_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).alias("i"))
    return r6(lattice.bar_phase(beat, "user_id", "i", "value"))


@query("""
SELECT e.event_id, e.user_id, o.o_orderkey AS found FROM events e ASOF LEFT JOIN
  (SELECT o_custkey, o_orderdate + INTERVAL 9131 DAY - INTERVAL 2700 DAY AS d, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.d""")
def asof_backward(spark, sf_dir):
    """For each event the customer's latest order at or before it (orders moved on by 6431 days, so that they meet)."""
    e = _events(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (micros("o_orderdate") + 6431 * 24 * HOUR).alias("t"), F.col("o_orderkey").alias("found"))
    return matching.asof_backward(e, o, ["user_id"], "t", ["found"]).select("event_id", "user_id", "found")


@query(f"""
WITH {E_}, b AS (SELECT user_id, t, event_id FROM e WHERE event_type = 'signup'), p AS (SELECT user_id, t, event_id FROM e WHERE event_type <> 'signup'),
     c AS (SELECT p.event_id, p.t - b.t AS d, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - b.t), b.t, b.event_id DESC) AS k FROM p JOIN b USING (user_id))
SELECT p.event_id, c.d AS distance FROM p LEFT JOIN c ON c.event_id = p.event_id AND c.k = 1""")
def nearest_snap(spark, sf_dir):
    """Each event's distance to the user's nearest signup."""
    e = _events(spark, sf_dir, "event_type")
    marks = e.where("event_type = 'signup'").select("user_id", "t", F.col("event_id").alias("mark"))
    return matching.nearest(e.where("event_type <> 'signup'"), marks, ["user_id"], "t", ["mark"]).select("event_id", "distance")


@query(f"""
WITH {E_}, k AS (SELECT user_id, t AS x, 60.0 * (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) AS y FROM e WHERE event_type = 'signup'),
     s AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS x1, lead(y) OVER (PARTITION BY user_id ORDER BY x) AS y1, min(x) OVER (PARTITION BY user_id) AS x0 FROM k),
     j AS (SELECT e.event_id, e.t, s.* FROM e JOIN s ON s.user_id = e.user_id AND (e.t >= s.x AND (s.x1 IS NULL OR e.t < s.x1) OR s.x = s.x0 AND e.t < s.x))
SELECT event_id, round(CASE WHEN x1 IS NULL OR t < x THEN y ELSE y + (t - x) / (x1 - x)::DOUBLE * (y1 - y) END, 6) AS warped FROM j""")
def piecewise_warp(spark, sf_dir):
    """Times mapped by the line through a user's signups, which are 60 seconds apart in the target; clamped outside."""
    e = _events(spark, sf_dir, "event_type")
    knots = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("x"), (60.0 * (F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1)).alias("y"))
    return r6(matching.mapped(e, knots, ["user_id"], "t", "x", "y", "warped").where("warped is not null").select("event_id", "warped"))


_FORM = (("intro", 16), ("build", 8), ("drop", 32), ("break", 16), ("build", 8), ("drop", 32), ("outro", 16))


def _slots(spark) -> DataFrame:
    rows, at = [], 0
    for k, (kind, bars) in enumerate(_FORM):
        rows.append((k, kind, at, at + bars))
        at += bars
    return spark.createDataFrame(rows, "slot int, kind string, start_bar long, end_bar long")


_SLOTS = "f AS (SELECT * FROM (VALUES (0, 'intro', 0, 16), (1, 'build', 16, 24), (2, 'drop', 24, 56), (3, 'break', 56, 72), (4, 'build', 72, 80), (5, 'drop', 80, 112), (6, 'outro', 112, 128)) AS s(slot, kind, start_bar, end_bar))"


@query(f"WITH {_SLOTS}, b AS (SELECT event_id, (event_id * 7) % 140 AS bar FROM events) SELECT event_id, bar, slot, kind FROM b LEFT JOIN f ON bar >= start_bar AND bar < end_bar")
def interval_slot_join(spark, sf_dir):
    """The slot of the arrangement whose half-open range of bars holds a mark's bar."""
    marks = table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("event_id") * 7, F.lit(140)).alias("bar"))
    return matching.interval_join(marks, _slots(spark), "bar", "start_bar", "end_bar", 8, broadcast=True).select("event_id", "bar", "slot", "kind")


@query("""
WITH s AS (SELECT o_orderpriority AS p, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 1 + o_orderkey % 5 AS b FROM orders),
     e AS (SELECT p, a AS pos, 1 AS d FROM s UNION ALL SELECT p, b, -1 FROM s), g AS (SELECT p, pos, sum(d) AS d FROM e GROUP BY p, pos),
     l AS (SELECT p, pos, lead(pos) OVER (PARTITION BY p ORDER BY pos) AS nx, sum(d) OVER (PARTITION BY p ORDER BY pos) AS live FROM g)
SELECT p AS priority, max(live)::BIGINT AS most, sum(CASE WHEN live > 1 THEN 1 ELSE 0 END)::BIGINT AS overlaps, sum(CASE WHEN live = 0 THEN 1 ELSE 0 END)::BIGINT AS gaps FROM l WHERE nx IS NOT NULL GROUP BY p""")
def span_concurrency(spark, sf_dir):
    """Orders as spans of days: the most at once, and how many stretches overlap or are empty."""
    day = F.floor(micros("o_orderdate") / (24 * HOUR))
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), day.alias("start"), (day + 1 + F.col("o_orderkey") % 5).alias("end"))
    return matching.concurrency(spans, ["priority"], "start", "end").groupBy("priority").agg(F.max("live").alias("most"), F.count_if(F.col("live") > 1).alias("overlaps"), F.count_if(F.col("live") == 0).alias("gaps"))


@query(f"""
WITH {E_}, n AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 14400000000 THEN 0 ELSE 1 END AS b FROM e),
     r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n),
     i AS (SELECT user_id, run, min(t) AS a, max(t) AS z, count(*) AS n FROM r GROUP BY user_id, run HAVING max(t) - min(t) >= 1800000000)
SELECT user_id, count(*) AS phrases, max(z - a)::BIGINT AS longest, sum(n)::BIGINT AS sounding FROM i GROUP BY user_id""")
def islands_phrases(spark, sf_dir):
    """Runs with gaps of 4 hours at most that last half an hour at least."""
    runs = folds.islands(_events(spark, sf_dir), ["user_id"], "t", 4 * HOUR, HOUR // 2)
    return runs.groupBy("user_id").agg(F.count("*").alias("phrases"), F.max(F.col("end") - F.col("start")).alias("longest"), F.sum("n").alias("sounding"))


@query(f"""
WITH {E_}, p AS (SELECT user_id, (t % 1800000000) / 900000000.0::DOUBLE AS pos FROM e), q AS (SELECT user_id, pos FROM p WHERE pos > 0.5 AND pos < 1.5)
SELECT user_id, round(least(0.66, greatest(-0.2, median(pos) - 1)), 6) AS swing FROM q GROUP BY user_id HAVING count(*) >= 4""")
def swing_fold(spark, sf_dir):
    """How late every second quarter of an hour is: the median place of what is near it."""
    pos = _events(spark, sf_dir).select("user_id", (F.pmod("t", F.lit(HOUR // 2)) / float(HOUR // 4)).alias("pos")).where("pos > 0.5 and pos < 1.5")
    return r6(pos.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("pos", F.lit(0.5)).alias("m")).where("n >= 4").select("user_id", F.least(F.lit(0.66), F.greatest(F.lit(-0.2), F.col("m") - 1)).alias("swing")))


@query(f"""
WITH {E_}, w AS (SELECT user_id, t // 86400000000 AS d, sum(value) AS s FROM e GROUP BY ALL),
     x AS (SELECT *, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS d1, lead(s) OVER (PARTITION BY user_id ORDER BY d) AS s1, max(s) OVER (PARTITION BY user_id) AS best FROM w)
SELECT user_id, min(CASE WHEN s >= 0.5 * best AND s1 >= 0.5 * best AND d1 = d + 1 THEN d END) AS start FROM x GROUP BY user_id""")
def sustained_start(spark, sf_dir):
    """The first of two days in a row that reach half of the user's best day."""
    days = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (24 * HOUR)).alias("d")).agg(F.sum("value").alias("s"))
    line = Window.partitionBy("user_id").orderBy("d")
    enough = 0.5 * F.max("s").over(Window.partitionBy("user_id"))
    days = days.select("user_id", "d", ((F.col("s") >= enough) & (F.lead("s").over(line) >= enough) & (F.lead("d").over(line) == F.col("d") + 1)).alias("ok"))
    return days.groupBy("user_id").agg(F.min(F.when(F.col("ok"), F.col("d"))).alias("start"))


_FLUX = f"""{E_}, u AS (SELECT *, greatest(0.0, value - coalesce(lag(value) OVER w, value)) AS rise FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
     v AS (SELECT *, greatest(0.0, rise - sum(rise) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7) AS l FROM u),
     f AS (SELECT *, l / greatest(max(l) OVER (PARTITION BY user_id), 1e-12) AS onset FROM v)"""


@query(f"WITH {_FLUX} SELECT event_id, round(onset, 6) AS onset FROM f")
def onset_flux(spark, sf_dir):
    return r6(signal.flux(_events(spark, sf_dir), ["user_id"], "t", "value", 3).select("event_id", "onset"))


@query(f"""
WITH {E_}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS l, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS r FROM e), p AS (SELECT user_id, quantile_cont(value, 0.95) AS p FROM e GROUP BY user_id)
SELECT event_id, user_id, value FROM x JOIN p USING (user_id) WHERE value > l AND value >= r AND value >= 0.3 * p""")
def local_peaks(spark, sf_dir):
    return signal.local_peaks(_events(spark, sf_dir), ["user_id"], "t", "value", 0.3).select("event_id", "user_id", "value")


@query()
def peaks_with_suppression(spark, sf_dir):
    """The strongest events first, each a day from all stronger chosen ones at least."""
    return folds.greedy_apart(_events(spark, sf_dir), "user_id", "t", "value", 24 * HOUR)


@query()
def greedy_windows(spark, sf_dir):
    """Up to three events of a user that stand for windows of two days without overlap."""
    return folds.greedy_apart(_events(spark, sf_dir), "user_id", "t", "value", 48 * HOUR, 3)


@query(f"""
WITH {E_}, b AS (SELECT user_id, least(15, (t - min(t) OVER (PARTITION BY user_id)) * 16 // greatest(1, max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id))) AS bucket, value FROM e),
     m AS (SELECT user_id, bucket, max(abs(value)) AS m FROM b GROUP BY ALL)
SELECT user_id, bucket, round(m / greatest(max(m) OVER (PARTITION BY user_id), 1e-9), 6) AS peak FROM m""")
def waveform_buckets(spark, sf_dir):
    """The peak of each sixteenth of a user's time, over the largest."""
    own = Window.partitionBy("user_id")
    low, high = F.min("t").over(own), F.max("t").over(own)
    bucket = F.least(F.lit(15), F.floor((F.col("t") - low) * 16 / F.greatest(F.lit(1), high - low))).cast("long")
    peaks = _events(spark, sf_dir).select("user_id", bucket.alias("bucket"), "value").groupBy("user_id", "bucket").agg(F.max(F.abs("value")).alias("m"))
    return r6(peaks.select("user_id", "bucket", (F.col("m") / F.greatest(F.max("m").over(own), F.lit(1e-9))).alias("peak")))


@query(f"WITH {E_}, b AS (SELECT user_id, t // 259200000000 AS bar, sqrt(avg(value * value)) AS r FROM e GROUP BY ALL) SELECT user_id, bar, round_even(r / greatest(max(r) OVER (PARTITION BY user_id), 1e-9), 4) AS energy FROM b")
def energy_per_bar(spark, sf_dir):
    """The root of the mean square of three days, over the largest, to four places."""
    bars = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (72 * HOUR)).alias("bar")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r"))
    return bars.select("user_id", "bar", F.bround(F.col("r") / F.greatest(F.max("r").over(Window.partitionBy("user_id")), F.lit(1e-9)), 4).alias("energy"))


@query("""
SELECT l_suppkey, round(regr_slope(20 * log10(l_extendedprice), log2(l_quantity)), 6) AS tilt, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS centroid FROM lineitem GROUP BY l_suppkey""")
def regression_tilt(spark, sf_dir):
    """The slope of level against the logarithm of quantity, and the weighted mean quantity."""
    rows = table(spark, sf_dir, "lineitem")
    return r6(rows.groupBy("l_suppkey").agg(F.regr_slope(20 * F.log10("l_extendedprice"), F.log2("l_quantity")).alias("tilt"), (F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_extendedprice")).alias("centroid")))


@query(f"""
WITH {E_}, a AS (SELECT user_id, 2 * pi() * (t % 86400000000) / 86400000000.0::DOUBLE AS a, value AS w FROM e)
SELECT user_id, round(atan2(sum(w * sin(a)), sum(w * cos(a))), 6) AS direction, round(sqrt(sum(w * sin(a)) ** 2 + sum(w * cos(a)) ** 2) / greatest(sum(w), 1e-12), 6) AS strength FROM a GROUP BY user_id""")
def circular_mean(spark, sf_dir):
    """The weighted mean time of day, as an angle."""
    import math

    a = _events(spark, sf_dir).select("user_id", (2 * math.pi * F.pmod("t", F.lit(24 * HOUR)) / float(24 * HOUR)).alias("a"), "value")
    direction, strength = lattice.circular_mean(F.col("a"), F.col("value"))
    return r6(a.groupBy("user_id").agg(direction.alias("direction"), strength.alias("strength")))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings)"


@query(f"WITH {_UNIT}, b AS (SELECT u AS v FROM u WHERE vec_id < 32) SELECT vec_id, round(max(list_dot_product(u, v)), 6) AS best FROM u, b GROUP BY vec_id")
def cosine_bank(spark, sf_dir):
    """The best cosine of each vector with a bank of 32 reference vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return r6(matching.best_cosine(v, v.where("vec_id < 32"), "embedding").select("vec_id", "best"))


#: How strongly each pitch class belongs to a major and a minor key.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


@query(f"""
WITH p AS (SELECT * FROM (VALUES (false, {list(MAJOR_PROFILE)}), (true, {list(MINOR_PROFILE)})) AS x(minor, p)), t AS (SELECT unnest(range(12)) AS tonic),
     k AS (SELECT tonic, minor, list_transform(range(12), lambda i: p[(i - tonic + 12) % 12 + 1]::DOUBLE) AS q FROM p, t),
     e AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)) AS c FROM embeddings),
     x AS (SELECT vec_id, tonic, minor, unnest(c) AS a, unnest(q) AS b FROM e, k), r AS (SELECT vec_id, tonic, minor, corr(a, b) AS r FROM x GROUP BY ALL)
SELECT vec_id, first(tonic ORDER BY round(r, 9) DESC, minor, tonic) AS tonic, first(minor ORDER BY round(r, 9) DESC, minor, tonic) AS minor, round(max(r), 6) AS r FROM r GROUP BY vec_id""")
def profile_correlation(spark, sf_dir):
    """The key whose profile correlates best with 12 values, major before minor and low before high where they tie."""
    keys = [(k, m, [float((MINOR_PROFILE if m else MAJOR_PROFILE)[(i - k) % 12]) for i in range(12)]) for m in (False, True) for k in range(12)]
    c = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))

    def pearson(q: list[float]):
        mean = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / 12
        mq = sum(q) / 12
        dq = [x - mq for x in q]
        top = F.aggregate(F.zip_with("c", F.array(*map(F.lit, dq)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return top / F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) * F.lit(sum(x * x for x in dq)))

    best = F.array_max(F.array(*(F.struct(F.round(pearson(q), 9).alias("r"), (~F.lit(m)).alias("major"), F.lit(-k).alias("low")) for k, m, q in keys)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", c.alias("c")).select("vec_id", best.alias("b"))
    return r6(rows.select("vec_id", (-F.col("b.low")).alias("tonic"), (~F.col("b.major")).alias("minor"), F.col("b.r").alias("r")))


@query(f"""
WITH {E_}, b AS (SELECT user_id, t // 86400000000 AS bar, event_type, sum(value) AS s FROM e GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bar ORDER BY s DESC, event_type) AS k FROM b),
     g AS (SELECT user_id, bar, max(CASE WHEN k = 1 THEN event_type END) AS top, max(CASE WHEN k = 1 THEN s END) AS s1, coalesce(max(CASE WHEN k = 2 THEN s END), 0) AS s2 FROM r GROUP BY user_id, bar),
     c AS (SELECT user_id, bar, CASE WHEN (s1 - s2) / s1 >= 0.25 THEN top END AS chord FROM g)
SELECT user_id, bar, coalesce(last_value(chord IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bar ROWS UNBOUNDED PRECEDING), 'none') AS chord FROM c""")
def template_match_carry(spark, sf_dir):
    """The strongest kind of each day; where it leads by less than a quarter, the day before it decides.

    A lead of just a quarter hangs on the last bit of the sums, so each is added up in the order of its events: the same for any files and partitions, and SQL's sum on one thread.
    """
    e = _events(spark, sf_dir, "event_type").withColumn("bar", F.expr("t div 86400000000")).repartition("user_id", "bar")
    events = Window.partitionBy("user_id", "bar", "event_type").orderBy("event_id", "t", "value")
    sums = F.sum("value").over(events.rowsBetween(Window.unboundedPreceding, 0))
    days = e.select("user_id", "bar", "event_type", sums.alias("s"), F.lead(F.lit(True)).over(events).alias("more")).where("more IS NULL")
    rank = F.row_number().over(Window.partitionBy("user_id", "bar").orderBy(F.desc("s"), F.asc_nulls_last("event_type")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    g = days.withColumn("k", rank).groupBy("user_id", "bar").agg(pick(1, "event_type").alias("top"), pick(1, "s").alias("s1"), F.coalesce(pick(2, "s"), F.lit(0.0)).alias("s2"))
    # a day of no weight has no lead to measure: its first kind stands, as in SQL, where 0 / 0 is no number and above all
    own = F.when(F.col("s1") == 0, F.col("top")).when(F.try_divide(F.col("s1") - F.col("s2"), F.col("s1")) >= 0.25, F.col("top"))
    line = Window.partitionBy("user_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("own", own).select("user_id", "bar", F.coalesce(F.last("own", ignorenulls=True).over(line), F.lit("none")).alias("chord"))


@query(f"""
WITH {_UNIT}, s AS (SELECT a.vec_id, sum(CASE WHEN (b.vec_id <= a.vec_id) = (c.vec_id <= a.vec_id) THEN 1 ELSE -1 END * list_dot_product(b.u, c.u)) AS x
   FROM u a JOIN u b ON b.vec_id BETWEEN a.vec_id - 3 AND a.vec_id + 4 JOIN u c ON c.vec_id BETWEEN a.vec_id - 3 AND a.vec_id + 4 GROUP BY a.vec_id) SELECT vec_id, round(greatest(0, x), 6) AS novelty FROM s""")
def self_similarity_novelty(spark, sf_dir):
    """A checkerboard over the near-diagonal band of the self-similarity: how much the four vectors before differ from the four after."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", matching.unit(F.col("embedding")).alias("u"))
    near = v.select(F.explode(F.sequence(F.col("vec_id") - 4, F.col("vec_id") + 3)).alias("at"), "vec_id", "u")
    total = lambda before: F.when((F.col("vec_id") <= F.col("at")) == F.lit(before), F.col("x"))
    # the sum over pairs of signs times dot products is the squared length of the signed sum of vectors
    sums = near.select("at", "vec_id", F.posexplode("u").alias("d", "x")).groupBy("at", "d").agg(F.coalesce(F.sum(total(True)), F.lit(0.0)).alias("p"), F.coalesce(F.sum(total(False)), F.lit(0.0)).alias("q"))
    out = sums.groupBy("at").agg(F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("x"))
    return r6(v.select("vec_id").join(out, F.col("vec_id") == F.col("at")).select("vec_id", F.greatest(F.lit(0.0), F.col("x")).alias("novelty")))


@query()
def section_distance_groups(spark, sf_dir):
    """Sections (labels, with their mean vectors) whose distance is at most the 30th percentile of all distances; a group's name is its smallest member."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pairs = v.select(F.col("label").alias("a"), "d", "x").join(v.select(F.col("label").alias("b"), "d", F.col("x").alias("y")), "d").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("dist"))
    near = pairs.crossJoin(F.broadcast(pairs.agg(F.percentile("dist", F.lit(0.3)).alias("limit")))).where("dist <= limit").select("a", "b")
    groups = folds.smallest_reached(v.select(F.col("label").alias("node")).distinct(), near)
    return groups.select(F.col("node").alias("label"), "group")


@query()
def dtw_align(spark, sf_dir):
    """Each label's sequence of vectors against the first 96 vectors of the table."""
    v = table(spark, sf_dir, "embeddings")
    reference = [r[0] for r in v.orderBy("vec_id").limit(96).select("embedding").collect()]
    import numpy as np

    return signal.aligned(v, np.array(reference), "label", "vec_id", "embedding", least=8)


@query(f"""
WITH {E_}, w AS (SELECT event_type, user_id % 5 AS part, count(*) AS n, sum(value) AS s, sum(CASE WHEN t % 3600000000 > 900000000 THEN value ELSE 0 END) AS o FROM e GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 5)))
SELECT event_type, part, n, round(s, 4) AS strength, round(o / s, 6) AS off_grid FROM w""")
def two_level_report(spark, sf_dir):
    """A report for each layer as a whole (part null) and for its parts, in one pass."""
    e = _events(spark, sf_dir, "event_type").select("event_type", (F.col("user_id") % 5).alias("part"), "value", (F.pmod("t", F.lit(HOUR)) > HOUR // 4).alias("off"))
    sets = e.groupingSets([["event_type"], ["event_type", "part"]], "event_type", "part").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.when(F.col("off"), F.col("value")).otherwise(0.0)).alias("o"))
    return sets.select("event_type", "part", "n", F.round("s", 4).alias("strength"), F.round(F.col("o") / F.col("s"), 6).alias("off_grid"))


@query("""
SELECT event_type, round(20 * log10(greatest(sqrt(avg(v * v)), 1e-6)), 6) AS rms_db, round(20 * log10(greatest(max(abs(v)), 1e-6)), 6) AS peak_db,
       round(20 * log10(greatest(max(abs(v)), 1e-6)) - 20 * log10(greatest(sqrt(avg(v * v)), 1e-6)), 6) AS crest_db, round(avg(CASE WHEN abs(v) >= 0.9985 THEN 1.0 ELSE 0.0 END), 6) AS clipped
FROM (SELECT event_type, value / 490.0 AS v FROM events) GROUP BY event_type""")
def loudness_stats(spark, sf_dir):
    from cadenza.functions.numeric import decibels, rms

    v = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 490.0).alias("v"))
    level, peak = decibels(rms(F.col("v"))), decibels(F.max(F.abs("v")))
    return r6(v.groupBy("event_type").agg(level.alias("rms_db"), peak.alias("peak_db"), (peak - level).alias("crest_db"), F.avg(F.when(F.abs("v") >= 0.9985, 1.0).otherwise(0.0)).alias("clipped")))


@query(f"""
WITH {E_}, g AS (SELECT user_id, t, event_type, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e)
SELECT user_id, event_type, count(*) AS n, coalesce(sum(t - p), 0)::BIGINT AS waited, coalesce(max(t - p), 0)::BIGINT AS longest FROM g GROUP BY user_id, event_type""")
def phase_timing(spark, sf_dir):
    """How long each phase of a job took: the time since the event before it."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))
    g = _events(spark, sf_dir, "event_type").select("user_id", "event_type", gap.alias("gap"))
    return g.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("gap"), F.lit(0)).alias("waited"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))


@query(f"""
WITH {E_}, q AS (SELECT event_id, user_id, t, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS waits FROM e)
SELECT event_id, (sum(waits) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS position FROM q WHERE waits = 1""")
def queue_positions(spark, sf_dir):
    """The place of each waiting job in its queue."""
    e = _events(spark, sf_dir, "event_type").where("event_type <> 'purchase'")
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).cast("long").alias("position"))


@query(f"""
WITH {E_} SELECT event_id, user_id, t, value FROM e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND abs(o.t - e.t) <= 86400000000)""")
def layer_suppression(spark, sf_dir):
    """Events that no purchase of their user is within a day of."""
    e = _events(spark, sf_dir, "event_type")
    rows = e.where("event_type <> 'purchase'").select("event_id", "user_id", "t", "value")
    return layers.apart_from(rows, e.where("event_type = 'purchase'"), "user_id", "t", 24 * HOUR, 96 * HOUR)
