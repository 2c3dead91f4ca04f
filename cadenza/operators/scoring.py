"""Score cards, profiles and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import clamp01, ramp

# Weights of the parts, their anchors (0 and 1), the shares of the measures in each part, the largest clipped share, the range of
# cosines and its score, the cap by groove, headline cuts and verdict limits.
WEIGHTS = {"groove": 0.30, "similarity": 0.22, "clarity": 0.18, "clicks": 0.10, "vocal": 0.10, "loudness": 0.10}
BANDS = {
    "on_grid": (0.55, 0.85), "on_grid_beat": (0.30, 0.65), "pulse": (0.40, 0.90), "bar": (0.35, 0.85), "split": (0.15, 0.65), "density": (3.3, 6.5),
    "mod_depth": (30.0, 120.0), "flatness": (0.035, 0.085), "click_rate": (3.0, 35.0), "vocal_lo": (-20.0, -8.0), "vocal_hi": (2.0, 9.0), "vocal_mod": (0.50, 1.70),
    "rms_lo": (-20.0, -12.0), "rms_hi": (-6.0, -2.0), "crest_lo": (6.0, 10.0), "crest_hi": (16.0, 22.0),
}
SHARES = {
    "groove": {"on_grid": 0.42, "on_grid_beat": 0.20, "pulse": 0.13, "bar": 0.08, "split": 0.17},
    "clarity": {"density": 0.45, "mod_depth": 0.30, "flatness": 0.25},
    "vocal": {"level": 0.6, "modulation": 0.4},
    "loudness": {"rms": 0.45, "crest": 0.30, "clipped": 0.25},
}
CLIPPED, COSINE, COSINE_SCORE = 0.002, (0.606, 0.869), 90.0
CAP = (30.0, 0.9)
CUTS = (82.0, 68.0, 52.0, 35.0)
MATCH, REVIEW = {"vocal": (0.52, 0.15), "chroma": (0.58, 0.18)}, {"vocal": (0.46, 0.12), "chroma": (0.52, 0.14)}
# End of fixed values.


def band(x: Column, name: str) -> Column:
    return ramp(x, *BANDS[name])


def _weighed(part: str, values: dict[str, Column]) -> Column:
    """100 for a part all of whose measures are 1."""
    return 100.0 * sum((SHARES[part][k] * v for k, v in values.items()), F.lit(0.0))


def groove(on_grid: Column, on_grid_beat: Column, pulse: Column, bar: Column, split: Column) -> Column:
    rising = {"on_grid": on_grid, "on_grid_beat": on_grid_beat, "pulse": pulse, "bar": bar}
    return _weighed("groove", {k: band(c, k) for k, c in rising.items()} | {"split": 1.0 - band(split, "split")})


def clarity(density: Column, mod_depth: Column, flatness: Column) -> Column:
    return _weighed("clarity", {"density": 1.0 - band(density, "density"), "mod_depth": band(mod_depth, "mod_depth"), "flatness": 1.0 - band(flatness, "flatness")})


def clicks(rate: Column) -> Column:
    return 100.0 * (1.0 - band(rate, "click_rate"))


def between(x: Column, name: str) -> Column:
    """1 inside of a range, falling to 0 on both sides."""
    return F.least(band(x, f"{name}_lo"), 1.0 - band(x, f"{name}_hi"))


def vocal(level: Column, modulation: Column) -> Column:
    return _weighed("vocal", {"level": between(level, "vocal"), "modulation": band(modulation, "vocal_mod")})


def loudness(rms_db: Column, crest: Column, clipped: Column) -> Column:
    return _weighed("loudness", {"rms": between(rms_db, "rms"), "crest": between(crest, "crest"), "clipped": 1.0 - clamp01(clipped / CLIPPED)})


def similarity(cosine: Column, low: float = COSINE[0], high: float = COSINE[1]) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), COSINE_SCORE * (cosine - low) / (high - low)))


def total(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """The weighted mean of the parts that are not null, and that capped by groove."""
    weight = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    mean = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0)) / F.greatest(weight, F.lit(1e-9))
    return mean, F.least(mean, CAP[0] + CAP[1] * F.coalesce(parts["groove"], F.lit(0.0)))


def headline(score: Column) -> Column:
    """0 for the best of five headlines."""
    out = F.lit(len(CUTS))
    for k in range(len(CUTS) - 1, -1, -1):
        out = F.when(score >= CUTS[k], k).otherwise(out)
    return out


def pair_verdict(score: Column, margin: Column, mode: str = "vocal") -> Column:
    match, review = MATCH[mode], REVIEW[mode]
    return F.when((score >= match[0]) & (margin >= match[1]), "match").when((score >= review[0]) & (margin >= review[1]), "review").otherwise("reject")


def profile(rows: DataFrame, keys: list[str], bpm: str, bars: str, present: str, others: list[str]) -> DataFrame:
    """Medians, the population spread of bpm, the median bars to whole phrases of 8 (0: 8), and the share of rows where present holds."""
    eights = F.rint(F.percentile(bars, F.lit(0.5)) / 8) * 8
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile(bpm, F.lit(0.5)).alias("bpm"), F.stddev_pop(bpm).alias("bpm_spread"), F.when(eights == 0, 8.0).otherwise(eights).cast("long").alias("bars"),
        F.avg(F.when(F.col(present), 1.0).otherwise(0.0)).alias("ratio"), *(F.percentile(c, F.lit(0.5)).alias(c) for c in others),
    )
