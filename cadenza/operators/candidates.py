"""Candidates for a wanted record: what speaks for and against each, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import numeric as N
from cadenza.functions import titles as T

# Words that say a candidate is not the original recording, and what each one costs; words that say it is, and what each one is worth;
# what a credit to the remixer costs, and a topic channel and the artist's own channel are worth.
PENALTIES = {
    "remix": 0.55, "rmx": 0.45, "bootleg": 0.55, "edit": 0.35, "flip": 0.45,
    "rework": 0.4, "refix": 0.4, "mashup": 0.55, "mash-up": 0.55,
    "sped up": 0.6, "spedup": 0.6, "speed up": 0.5, "slowed": 0.6,
    "reverb": 0.5, "nightcore": 0.7, "8d": 0.6, "9d": 0.6, "16d": 0.6,
    "bass boosted": 0.5, "cover": 0.5, "live": 0.4, "concert": 0.4,
    "karaoke": 0.7, "instrumental": 0.5, "acapella": 0.5, "acappella": 0.5,
    "tiktok": 0.35, "loop": 0.4, "1 hour": 0.8, "one hour": 0.8,
    "10 hours": 0.9, "extended mix": 0.3, "vip": 0.35, "reaction": 0.8,
    "tutorial": 0.8, "type beat": 0.9, "full album": 0.7, "mix 20": 0.5,
    "dj set": 0.8, "mashup mix": 0.6, "chopped": 0.5, "screwed": 0.5,
    "clean version": 0.2, "trailer": 0.6, "teaser": 0.6,
}
BONUSES = {
    "official audio": 0.16, "official video": 0.08, "official music video": 0.08,
    "audio": 0.05, "lyrics": 0.06, "lyric video": 0.06, "original": 0.05,
    "full song": 0.03, "hq": 0.01,
}
CREDITED, TOPIC, OWN_CHANNEL, OWN_CHANNEL_LIKENESS = 0.8, 0.18, 0.10, 0.75
# End of fixed values.

_TOPIC = r"(?i)\s-\s*topic\s*$"


def _named(words: dict[str, float], found) -> tuple[Column, Column]:
    """The words that are found, in their order, and the sum of their values."""
    each = {w: found(w) for w in words}
    names = F.filter(F.array(*(F.when(hit, w) for w, hit in each.items())), lambda x: x.isNotNull())
    return names, sum((F.when(hit, words[w]).otherwise(0.0) for w, hit in each.items()), F.lit(0.0))


def scored(rows: DataFrame) -> DataFrame:
    """rows (title, uploader, seconds, and what is wanted: artist, track, remixer) with similarity, score, penalties and bonuses.

    The base is the similarity of the titles times how fit the duration is. Nulls count as empty, an unknown duration as neither good nor bad.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    haystack = F.lower(F.concat_ws(" ", text("title"), text("uploader")))
    rows = rows.withColumn("__h", haystack).withColumn("similarity", T.similarity(T.tokens(F.concat_ws(" ", text("artist"), text("track"))), T.tokens(text("title"))))
    against, cost = _named(PENALTIES, lambda w: F.col("__h").rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])"))
    credited = (F.char_length(text("remixer")) > 2) & F.regexp_like(F.col("__h"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(text("remixer")), F.lit(r"\E(?![a-z0-9])")))
    favour, worth = _named(BONUSES, lambda w: F.contains(F.col("__h"), F.lit(w)))
    topic = text("uploader").rlike(_TOPIC)
    own = (text("artist") != "") & (T.similarity(T.tokens(text("artist")), T.tokens(text("uploader"))) >= OWN_CHANNEL_LIKENESS)
    extra = lambda hit, name: F.when(hit, F.array(name)).otherwise(F.array().cast("array<string>"))
    value = lambda hit, x: F.when(hit, x).otherwise(0.0)
    base = F.col("similarity") * N.duration_fit(F.coalesce("seconds", F.lit(0.0)))
    return rows.select(
        *(c for c in rows.columns if c != "__h"),
        N.clamp01(base + worth + value(topic, TOPIC) + value(own, OWN_CHANNEL) - cost - value(credited, CREDITED)).alias("score"),
        F.concat(against, extra(credited, F.concat(F.lit("credited to "), text("remixer")))).alias("penalties"),
        F.concat(favour, extra(topic, F.lit("topic channel")), extra(own, F.lit("artist's own channel"))).alias("bonuses"),
    )


def ranked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """scored() with place: best first for each key, then by similarity, duration and order. Of the candidates with one url, or without it one title, the first by order counts; those with neither are none."""
    name = F.lower(F.trim(F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.coalesce("title", F.lit("")))))
    once = rows.withColumn("__name", name).where("__name <> ''").withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__name").orderBy(order))).where("__k = 1").drop("__name", "__k")
    out = scored(once).withColumn("score", F.round("score", 6)).withColumn("similarity", F.round("similarity", 6))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("similarity"), F.coalesce("seconds", F.lit(0.0)), order)).cast("long"))
