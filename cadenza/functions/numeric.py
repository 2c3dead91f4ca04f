"""Scalar measures as Column expressions: clamping, levels, tempo readings, bars and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible song lengths in seconds, tempo centre and spread, reading limits.
SHORTEST, LONGEST = 120.0, 360.0
TEMPO_CENTRE, TEMPO_SPREAD = 124.0, 0.95
HOUSE_BAND = tuple(range(120, 129))
STRETCH_LIMITS = (0.8, 1.25)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp(x: Column, low, high) -> Column:
    """x between low and high as 0 to 1, clamped; descending ranges are allowed, an empty one gives 0."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(high == low, F.lit(0.0)).otherwise(clamp01((x - low) / F.nullif(high - low, F.lit(0.0))))


def decibels(x: Column) -> Column:
    """Of an amplitude, -120 at the least."""
    return 20.0 * F.log10(F.greatest(F.abs(x), F.lit(1e-6)))


def rms(x: Column) -> Column:
    """Aggregate: the root of the mean square."""
    return F.sqrt(F.avg(x * x))


def tempo_prior(bpm: Column, centre: float = TEMPO_CENTRE, spread: float = TEMPO_SPREAD) -> Column:
    return F.exp(-0.5 * F.pow(F.log2(bpm / centre) / spread, F.lit(2.0)))


def tempo_reading(source: Column, target: Column) -> Column:
    """struct(multiple, ratio, warn): reading the source at double, straight or half time, whichever stretches least; the first of equals."""
    options = [F.struct(F.abs(F.log(m * target / source)).alias("cost"), F.lit(k).alias("pos"), F.lit(m).alias("multiple"), (m * target / source).alias("ratio")) for k, m in enumerate((0.5, 1.0, 2.0))]
    multiple = {0.5: 2.0, 1.0: 1.0, 2.0: 0.5}
    best = F.array_min(F.array(*options))
    name = F.lit(None).cast("double")
    for m, v in multiple.items():
        name = F.when(best["multiple"] == m, v).otherwise(name)
    return F.struct(name.alias("multiple"), best["ratio"].alias("ratio"), (~best["ratio"].between(*STRETCH_LIMITS)).alias("warn"))


def house_tempo(bpm: Column, centre: float = TEMPO_CENTRE) -> Column:
    """The whole tempo of the band with the least octave-folded stretch, and 0.02 for each step off the centre; the first of equals."""
    cost = lambda t: F.least(*(F.abs(F.log2(m * t / bpm)) for m in (1.0, 0.5, 2.0))) + 0.02 * abs(t - centre)
    return F.array_min(F.array(*(F.struct(cost(float(t)).alias("cost"), F.lit(k).alias("pos"), F.lit(float(t)).alias("bpm")) for k, t in enumerate(HOUSE_BAND))))["bpm"]


def chance_level(step: Column, tolerance: float) -> Column:
    """The share of time that a lattice covers."""
    return F.least(F.lit(1.0), 2.0 * tolerance / step)


def duration_fit(seconds: Column) -> Column:
    """1 for a usual song length, falling outside of it; 0.6 where it is unknown."""
    short = F.pow(F.greatest(F.lit(0.05), seconds / SHORTEST), F.lit(1.5))
    long = F.pow(F.greatest(F.lit(0.05), LONGEST / F.nullif(seconds, F.lit(0.0))), F.lit(1.2))
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, 0.6).when(seconds < SHORTEST, short).when(seconds > LONGEST, long).otherwise(1.0)


def bar_of(t: Column, bar: Column) -> Column:
    """The bar of a moment, from 1; 0 without a grid."""
    return F.when(bar > 0, F.floor(t / F.nullif(bar, F.lit(0.0))) + 1).otherwise(F.lit(0)).cast("long")


def note_hz(pitch_class: Column, octave: Column) -> Column:
    """Equal temperament, A4 at 440."""
    return 440.0 * F.pow(F.lit(2.0), (pitch_class - 9) / 12.0 + octave - 4)


def clock(seconds: Column) -> Column:
    """M:SS"""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def length_seconds(text: Column) -> Column:
    """Seconds of 4:30, 4m30s or 270; null for anything else."""
    t = F.trim(text)
    colon = F.regexp_extract(t, r"^(\d+):(\d{1,2})$", 1).try_cast("double") * 60 + F.regexp_extract(t, r"^(\d+):(\d{1,2})$", 2).try_cast("double")
    minutes = F.coalesce(F.regexp_extract(t, r"^(?:(\d+)m)?(?:(\d+)s)?$", 1).try_cast("double"), F.lit(0.0)) * 60 + F.coalesce(F.regexp_extract(t, r"^(?:(\d+)m)?(?:(\d+)s)?$", 2).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(r"^\d+:\d{1,2}$"), colon).when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")).when(t.rlike(r"^(?=.)(\d+m)?(\d+s)?$"), minutes)
