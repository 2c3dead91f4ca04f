"""Decisions from measurements as Column expressions: lattices, treatments, bass, vocals, learned values, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import numeric as N

# How many pairs count, when a vocal is chopped, how much more a triplet lattice must explain; limits for bass and vocals.
MIN_PAIRS = 3
CHOP_BEATS, CHOP_RATIO = 2.0, 0.65
TRIPLET_EDGE, FIT_TOLERANCE = 0.06, 0.030
SILENT_DB = -45.0
COLLISION_LIMIT, RHYTHMIC_PER_BAR, BUSY_PER_BAR, BUSY_OFF_EIGHTH = 0.35, 4.0, 10.0, 0.55
TRIPLET_SHARE, TRIPLET_WINDOWS, MIN_DUTY = 0.62, 0.65, 0.05
NOT_A_CRITIC = ("image", "tts", "transcribe", "embedding", "computer-use", "robotics", "customtools", "vision", "gemma", "lyria", "banana", "antigravity", "deep-research")
TIERS = (("flash-lite", 1), ("pro", 3), ("flash", 2))
# End of fixed values.


def lattice_of(straight: Column, triplet: Column, bpm: Column | None = None) -> Column:
    """straight or triplet; with a tempo, what luck alone gives is taken off both shares first. unknown if neither is known."""
    a, b = F.coalesce(straight, F.lit(0.0)), F.coalesce(triplet, F.lit(0.0))
    if bpm is not None:
        known = F.coalesce(bpm, F.lit(0.0)) != 0
        luck = lambda division: N.chance_level(60.0 / F.greatest(bpm, F.lit(1e-6)) / division, FIT_TOLERANCE)
        a, b = F.when(known, a - luck(4)).otherwise(a), F.when(known, b - luck(6)).otherwise(b)
    return F.when(straight.isNull() & triplet.isNull(), "unknown").when(b - a >= TRIPLET_EDGE, "triplet").otherwise("straight")


def treatment_of(phrase: Column, phrase_remix: Column, duty: Column, duty_remix: Column, bpm_remix: Column) -> Column:
    """struct(treatment, phrase_ratio, phrase_beats, vocal_kept): what became of a voice, by the lengths of its phrases and how much of the time it sounds."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratio = F.when(zero(phrase) > 0, zero(phrase_remix) / phrase).otherwise(0.0)
    beats = F.when(zero(bpm_remix) > 0, zero(phrase_remix) / (60.0 / bpm_remix)).otherwise(0.0)
    chopped = (zero(phrase_remix) > 0) & ((beats <= CHOP_BEATS) | ((ratio != 0) & (ratio <= CHOP_RATIO)))
    kept = F.when(zero(duty) > 0, F.bround(F.least(F.lit(1.5), zero(duty_remix) / duty), 3)).otherwise(0.0)
    return F.struct(F.when(chopped, "chopped").otherwise("continuous").alias("treatment"), F.bround(ratio, 3).alias("phrase_ratio"), F.bround(beats, 2).alias("phrase_beats"), kept.alias("vocal_kept"))


def learned_bpm(references: Column, bpm: Column) -> Column:
    """A learned tempo if enough references were measured and it is one; else null."""
    return F.when((references >= MIN_PAIRS) & bpm.between(100.0, 150.0), bpm)


def vocal_threshold(pairs: Column, lock: Column) -> Column:
    """A learned limit of the straight share if enough pairs were measured and it is in a sane band; else null."""
    return F.when((pairs >= MIN_PAIRS) & lock.between(0.5, 0.9), lock)


def bass_mode(rms_db: Column, per_bar: Column, on_beat: Column, off_eighth: Column) -> Column:
    """none, sub (made anew on the grid) or source (kept)."""
    doubled = (per_bar >= RHYTHMIC_PER_BAR) & (on_beat >= COLLISION_LIMIT)
    busy = (per_bar >= BUSY_PER_BAR) & (off_eighth >= BUSY_OFF_EIGHTH)
    return F.when(rms_db < SILENT_DB, "none").when(doubled | busy, "sub").otherwise("source")


def bass_octave(pitch_class: Column) -> Column:
    """The octave that keeps a bass note above 41 Hz."""
    return F.when(N.note_hz(pitch_class, F.lit(1)) >= 41.0, 1).otherwise(2)


def vocal_mode(duty: Column, triplet_share: Column, triplet_windows: Column) -> Column:
    """chop for a triplet flow, else flow."""
    return F.when((duty >= MIN_DUTY) & (triplet_share >= TRIPLET_SHARE) & (triplet_windows >= TRIPLET_WINDOWS), "chop").otherwise("flow")


def frequency_curve(n: Column, start: Column, end: Column) -> Column:
    """n frequencies in even steps of pitch from start to end (1 Hz at least)."""
    a, b = F.log(F.greatest(start, F.lit(1.0))), F.log(F.greatest(end, F.lit(1.0)))
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.exp(a + (b - a) * k / F.greatest(n - 1, F.lit(1))))


def model_rank(name: Column) -> Column:
    """struct(major, minor, tier, released) by which models that can listen are ordered; null for others."""
    version = r"^gemini-(\d+)(?:\.(\d+))?-"
    tier = F.lit(0)
    for word, rank in reversed(TIERS):
        tier = F.when(F.contains(name, F.lit(word)), rank).otherwise(tier)
    number = lambda k: F.coalesce(F.regexp_extract(name, version, k).try_cast("int"), F.lit(0))
    fits = name.rlike(version) & ~name.rlike("|".join(NOT_A_CRITIC))
    return F.when(fits, F.struct(number(1).alias("major"), number(2).alias("minor"), tier.alias("tier"), F.when(F.contains(name, F.lit("preview")), 0).otherwise(1).alias("released")))
