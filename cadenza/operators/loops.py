"""The stretch of whole bars that loops best: where kicks are strong and even, attacks lie on sixteenths, and the level doesn't drop.

Evidence is summed for each beat where its frames are, cell by cell; bars are sums over beats, and a window of bars is tried by a sliding frame over the
bars, so that starts and lengths share all of it. Only the level that 95 of 100 frames exceed is looked for in the frames of the window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import chunks
from cadenza.operators.beats import ATTACK_LATENCY, FRAMES, Frames, fine_envelopes
from cadenza.operators.chunks import CELL, Cell, haloed, kernelled, scaled
from cadenza.session import Workbench

# Seconds around a sixteenth that count as on it, and around a beat in which its kick is looked for; the share of a median kick that is one; what a score is made of.
NEAR, AROUND, PRESENT = 0.025, 0.05, 0.35
WEAKEST, LATTICE, QUIETEST, QUIET = (0.25, 0.75), (0.4, 0.6), (0.3, 0.7), 0.05
# End of fixed values.

BEATS = 4


def levels(clips: DataFrame, bench: Workbench, frames: Frames = FRAMES, cell: int = CELL) -> DataFrame:
    """track_id, sr, start, values: the level of the samples from each hop of the attack envelope on, over the track's largest."""
    return bench.put(scaled(bench.put(chunks.levels(clips, frames.size, frames.attack_hop, cell))))


def _spans(beats: DataFrame, fine: DataFrame, hop: int) -> DataFrame:
    """The frames of each beat that another one follows: its own (low to high), those of the sixteenths' centres, and those in which its kick may be (from, upto). frames: how many the track has."""
    total = fine.groupBy("track_id").agg(F.max(F.col("start") + F.size("values")).alias("frames"))
    fps, line = F.col("sr") / hop, Window.partitionBy("track_id").orderBy("place")
    rows = beats.select("track_id", "sr", "place", "seconds", F.lead("seconds").over(line).alias("until")).where("until is not null").join(total, "track_id").where("frames >= 8")
    centre = lambda t: F.rint((t + ATTACK_LATENCY) * fps).cast("long")
    rows = rows.withColumn("fps", fps).withColumn("near", F.greatest(F.lit(1.0), F.rint(NEAR * fps)).cast("long")).withColumn("around", F.greatest(F.lit(1.0), F.rint(AROUND * fps)).cast("long"))
    sixteenths = F.array(*(centre(F.col("seconds") + (F.col("until") - F.col("seconds")) * k / 4) for k in range(4)))
    rows = rows.select("*", F.floor(F.col("seconds") * fps).alias("low"), F.floor(F.col("until") * fps).alias("high"), sixteenths.alias("centres"), centre(F.col("seconds")).alias("centre"))
    at = F.greatest(F.lit(0), F.least(F.col("frames") - 1, ((F.col("seconds") + ATTACK_LATENCY) * fps).cast("long")))
    return rows.select("*", at.alias("at"), F.greatest(F.lit(0), F.col("centre") - F.col("around")).alias("from"), F.least("frames", F.col("centre") + F.col("around") + 1).alias("upto"))


def _asked(spans: DataFrame, low: Column, high: Column, cell: int, *names: str) -> DataFrame:
    """track_id, cell and asked: what is asked of each cell that the frames from low to high (exclusive) are in."""
    cells = F.sequence(F.floor(F.greatest(F.lit(0), low) / cell), F.floor(F.greatest(F.lit(0), low, high - 1) / cell))
    return spans.select("track_id", F.explode(cells).alias("cell"), F.struct(*names).alias("a")).groupBy("track_id", "cell").agg(F.collect_list("a").alias("asked"))


def _heard(c: Cell) -> list[tuple]:
    attack, kick = c.beyond(c.start, c.end)[:, :2].T
    sums = np.concatenate([[0.0], np.cumsum(attack)])

    def total(low: int, high: int) -> float:
        low, high = (min(max(k, c.start), c.end) - c.start for k in (low, high))
        return float(sums[high] - sums[low]) if high > low else 0.0

    out = []
    for a in c.carried["asked"]:
        near = [(k - a["near"], k + a["near"] + 1) for k in a["centres"]]
        head, tail = sum(total(lo, min(hi, a["low"])) for lo, hi in near), sum(total(max(lo, a["high"]), hi) for lo, hi in near)
        lo, hi = max(a["from"], c.start) - c.start, min(a["upto"], c.end) - c.start
        peak = lo + int(attack[lo:hi].argmax()) if hi > lo else None
        own = float(kick[a["at"] - c.start]) if c.start <= a["at"] < c.end else None
        found = (None, None, None) if peak is None else (float(kick[lo:hi].max()), float(attack[peak]), c.start + peak)
        out.append((a["place"], total(a["low"], a["high"]), sum(total(*n) for n in near), head, tail, own, *found))
    return out


def _loud(c: Cell) -> list[tuple]:
    x = c.beyond(c.start, c.end)
    cut = ((a["place"], x[max(a["low"] - c.start, 0) : max(a["high"] - c.start, 0)]) for a in c.carried["asked"])
    return [(place, own.tolist()) for place, own in cut if len(own)]


def evidence(fine: DataFrame, level: DataFrame, beats: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """For each beat that another one follows, its frames and times and what is heard there: all attacks (total), those on sixteenths (on), those of these before and after it (head, tail), its kick, the strongest kick and attack near it, and its levels.

    fine, level: envelopes as of beats.fine_envelopes and levels. Frames without a level count as silent.
    """
    cell, carry = frames.cell, ("asked",)
    spans = _spans(beats, fine, frames.attack_hop)
    low = F.least("low", "from", F.array_min("centres") - F.col("near"))
    high = F.least("frames", F.greatest("high", "upto", F.array_max("centres") + F.col("near") + 1))
    asked = _asked(spans, low, high, cell, "place", "low", "high", "near", "centres", "at", "from", "upto")
    heard = kernelled(haloed(fine, cell, 0, 0, "start", "values").join(asked, ["track_id", "cell"]), cell, _heard, "place int, total double, on double, head double, tail double, kick double, most double, peak double, peak_at long", carry)
    sums = heard.groupBy("track_id", "place").agg(*(F.sum(n).alias(n) for n in ("total", "on", "head", "tail")), F.max("kick").alias("kick"), F.max("most").alias("most"), F.max_by("peak_at", F.struct("peak", -F.col("peak_at"))).alias("peak_at"))
    asked = _asked(spans, F.col("low"), F.col("high"), cell, "place", "low", "high")
    loud = kernelled(haloed(level, cell, 0, 0, "start", "values").join(asked, ["track_id", "cell"]), cell, _loud, "place int, values array<double>", carry)
    loud = loud.groupBy("track_id", "place").agg(F.flatten(F.collect_list("values")).alias("levels"))
    rows = spans.join(sums, ["track_id", "place"]).join(loud, ["track_id", "place"], "left")
    known = F.coalesce("levels", F.array().cast("array<double>"))
    silent = F.greatest(F.lit(0), F.col("high") - F.col("low") - F.size(known)).cast("int")
    return rows.withColumn("levels", F.concat(known, F.array_repeat(F.lit(0.0), silent))).drop("near", "around", "centres", "at")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def windows(found: DataFrame, phases: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """track_id, bars, place (of its first beat), begin, end and score of every stretch of so many whole bars, with kicks (strength of all of them with their evenness), lattice, loud and quiet, of which the score is made.

    found: evidence(); phases: track_id, phase (the place of a bar's first beat, 0 to 3). Stretches that begin before 0 or end after the envelopes are none.
    """
    rows = found.join(phases.select("track_id", F.col("phase").cast("int").alias("phase")), "track_id").withColumn("in_bar", F.pmod(F.col("place") - F.col("phase"), F.lit(BEATS)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("in_bar", F.col(c).alias("v")))), lambda s: s["v"])
    bar = F.floor((F.col("place") - F.col("phase")) / BEATS)
    bars = rows.where(F.col("place") >= F.col("phase")).groupBy("track_id", bar.alias("bar")).agg(
        F.min("place").alias("place"), F.min("seconds").alias("begin"), F.max("until").alias("end"), F.count("*").alias("n"), F.first("frames").alias("frames"), F.first("fps").alias("fps"), F.sum("total").alias("total"), F.sum("on").alias("on"),
        F.min_by("head", "in_bar").alias("head"), F.max_by("tail", "in_bar").alias("tail"), ordered("kick").alias("kicks"), F.flatten(F.collect_list("levels")).alias("levels"),
    ).where(F.col("n") == BEATS)
    out = None
    for length in lengths:
        w = Window.partitionBy("track_id").orderBy("bar").rowsBetween(0, length - 1)
        tried = bars.select(
            "track_id", F.lit(length).alias("bars"), "place", "begin", "bar", "frames", "fps", F.last("end").over(w).alias("end"), F.last("bar").over(w).alias("last"), F.sum("total").over(w).alias("total"), (F.sum("on").over(w) - F.col("head") - F.last("tail").over(w)).alias("on"),
            F.flatten(F.collect_list("kicks").over(w)).alias("hits"), F.array_sort(F.flatten(F.collect_list("levels").over(w))).alias("levels"),
        ).where((F.col("last") == F.col("bar") + length - 1) & (F.col("begin") >= 0) & (F.col("end") * F.col("fps") < F.col("frames")))
        out = tried if out is None else out.unionByName(tried)
    out = out.withColumn("mean", _total(F.col("hits")) / F.size("hits")).withColumn("n", F.size("levels"))
    spread = F.sqrt(F.aggregate("hits", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / F.size("hits"))
    some = F.greatest("mean", F.lit(1e-9))
    weakest = F.least(F.array_min("hits") / some, F.lit(1.0))
    kicks = F.when(F.col("mean") <= 0, 0.0).otherwise(F.col("mean") / (1 + spread / some) * (WEAKEST[0] + WEAKEST[1] * weakest))
    lattice = F.when(F.col("total") > 0, F.least(F.col("on") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    place = QUIET * (F.col("n") - 1)
    whole = F.floor(place).cast("int")
    low, next_ = F.get("levels", whole), F.coalesce(F.get("levels", whole + 1), F.get("levels", whole))
    out = out.select("track_id", "bars", "place", "begin", "end", kicks.alias("kicks"), lattice.alias("lattice"), (_total(F.col("levels")) / F.col("n")).alias("loud"), (low + (next_ - low) * (place - whole)).alias("lowest"))
    out = out.withColumn("quiet", F.least(F.lit(1.0), F.col("lowest") / F.greatest("loud", F.lit(1e-9)))).drop("lowest")
    score = F.col("kicks") * (LATTICE[0] + LATTICE[1] * F.col("lattice")) * F.col("loud") * (QUIETEST[0] + QUIETEST[1] * F.col("quiet"))
    return out.withColumn("score", score)


def kick_times(best: DataFrame, found: DataFrame) -> DataFrame:
    """best with kicks: seconds from its begin, one for each beat. A kick is where the attack near the beat is strongest, if one is there and not at the edge; else on the beat."""
    places = best.select("track_id", "bars", "begin", F.explode(F.sequence(F.col("place"), F.col("place") + BEATS * F.col("bars") - 1)).alias("place"))
    rows = places.join(found.select("track_id", "place", "seconds", "fps", "kick", "most", "peak_at", "from", "upto"), ["track_id", "place"])
    near = rows.groupBy("track_id", "bars").agg(F.median("kick").alias("usual"), F.array_sort(F.collect_list(F.struct("place", "seconds", "fps", "most", "peak_at", "from", "upto"))).alias("beats"), F.first("begin").alias("begin"))

    def at(b: Column) -> Column:
        there = (b["most"] >= PRESENT * F.col("usual")) & (b["peak_at"] != b["from"]) & (b["peak_at"] != b["upto"] - 1)
        return F.when(there, b["peak_at"] / b["fps"] - ATTACK_LATENCY - F.col("begin")).otherwise(b["seconds"] - F.col("begin"))

    return best.drop("kicks").join(near.select("track_id", "bars", F.transform("beats", at).alias("kicks")), ["track_id", "bars"])


def best_loops(found: DataFrame, phases: DataFrame, lengths: tuple[int, ...] = (8,), allowed: Column | None = None) -> DataFrame:
    """track_id, bars, place, begin, end, score and kicks of the best stretch of each length of each track in phases: the first of equal ones.

    allowed: a condition on the columns of windows(). A track without such a stretch has place -1, score -1 and no kicks.
    """
    tried = windows(found, phases, lengths)
    tried = tried if allowed is None else tried.where(allowed)
    best = tried.groupBy("track_id", "bars").agg(F.max_by(F.struct("place", "begin", "end", "score"), F.struct("score", -F.col("place"))).alias("b")).select("track_id", "bars", "b.*")
    every = phases.select("track_id", F.explode(F.array(*map(F.lit, lengths))).alias("bars"))
    rows = every.join(kick_times(best, found), ["track_id", "bars"], "left")
    return rows.select("track_id", "bars", F.coalesce("place", F.lit(-1)).alias("place"), "begin", "end", F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("kicks", F.array().cast("array<double>")).alias("kicks"))


def looped(clips: DataFrame, beats: DataFrame, phases: DataFrame, lengths: tuple[int, ...] = (8,), frames: Frames = FRAMES, cell: int = CELL, allowed: Column | None = None) -> DataFrame:
    """best_loops() of clips with known beats (track_id, sr, place, seconds) and phases (track_id, phase). The tables between the steps are deleted."""
    bench = Workbench(clips.sparkSession)
    found = bench.put(evidence(fine_envelopes(clips, bench, frames, cell), levels(clips, bench, frames, cell), beats, frames))
    out = bench.put(best_loops(found, phases, lengths, allowed), keep=True)
    bench.clear()
    return out


def repeated(spans: DataFrame, offsets: str = "kicks") -> DataFrame:
    """spans (low, high: samples, high exclusive; sr, period: samples of a loop; offsets: seconds from its begin) with seconds: the kicks of the loop, repeated from 0 on, that are within. A row for each; spans without kicks or period have none."""
    turns = F.sequence(F.floor(F.col("low") / F.col("period")), F.ceil(F.col("high") / F.col("period")))
    rows = spans.where((F.col("period") > 0) & (F.size(offsets) > 0)).withColumn("__turn", F.explode(turns)).withColumn("__offset", F.explode(offsets))
    rows = rows.withColumn("seconds", F.col("__turn") * (F.col("period") / F.col("sr")) + F.col("__offset"))
    return rows.where((F.col("low") <= F.col("seconds") * F.col("sr")) & (F.col("seconds") * F.col("sr") < F.col("high"))).drop("__turn", "__offset")
