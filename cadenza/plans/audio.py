"""Queries over series in chunks. The chunks come from the vectors of `embeddings`: 64 of them after another are a recording of 400 samples a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import tags
from cadenza.operators import beats, chunks, layers, loops, pairs, sections
from cadenza.operators import prints as excerpts
from cadenza.plans.series import r6
from cadenza.sources.tables import micros, table

RATE, VECTORS = 400, 64
#: Frames that fit recordings of ten seconds at this rate.
FRAMES = beats.Frames(size=64, hop=8, attack_size=32, attack_hop=4, cell=128)
CELL = 1024

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def clips(spark, sf_dir) -> DataFrame:
    """track_id, sr, start_sample, samples: each vector is a chunk, at its place in its recording."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / VECTORS).alias("track_id"), F.lit(RATE).alias("sr"), (F.col("vec_id") % VECTORS * F.size("embedding")).alias("start_sample"), F.col("embedding").alias("samples"))


@query
def chunked_measures(spark, sf_dir):
    """Length, level, flatness, shares of bands, onsets, clicks and the first coefficients of each recording, cell by cell."""
    rows = chunks.measured(clips(spark, sf_dir), FRAMES.size, FRAMES.hop, 4, CELL)
    return r6(rows.select("*", *(F.get("mfcc", F.lit(k)).alias(f"mfcc_{k}") for k in range(4))).drop("mfcc"))


@query
def pitch_track(spark, sf_dir):
    """The pitch of frames of a quarter second, ten a second."""
    return r6(chunks.pitched(clips(spark, sf_dir), 100, 40, 17.0, 100.0, 0.35, CELL))


@query
def beat_grids(spark, sf_dir):
    """Tempo, number of beats, first beat and first beat of a bar of each recording."""
    grid, _ = beats.grids(clips(spark, sf_dir), FRAMES, CELL)
    return r6(grid.drop("candidates"))


@query
def beat_times(spark, sf_dir):
    """Every beat of each recording."""
    _, found = beats.grids(clips(spark, sf_dir), FRAMES, CELL)
    return r6(found.select("track_id", "place", "seconds"))


@query
def loop_search(spark, sf_dir):
    """The best loops of one, two and four bars of each recording, a row for each of their kicks."""
    rows = clips(spark, sf_dir)
    grid, found = beats.grids(rows, FRAMES, CELL)
    best = loops.looped(rows, found, grid, (1, 2, 4), FRAMES, CELL)
    return r6(best.select("track_id", "bars", "place", "begin", "end", "score", F.posexplode_outer("kicks").alias("beat", "kick")))


def bars(spark, sf_dir) -> DataFrame:
    """track_id, seconds of the bars of half a second that the sections of a recording keep to."""
    lengths = clips(spark, sf_dir).groupBy("track_id").agg(F.max(F.col("start_sample") + F.size("samples")).alias("n"))
    return lengths.select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") * 2 / RATE).cast("int"))).alias("k")).select("track_id", (F.col("k") / 2 + 0.1).alias("seconds"))


@query
def track_sections(spark, sf_dir):
    """The sections of each recording, with bars of half a second."""
    downs = bars(spark, sf_dir)
    return r6(sections.segmented(clips(spark, sf_dir), downs, downs.select("track_id").distinct().withColumn("bar", F.lit(0.5)), FRAMES, 256, CELL, 8, 2))


@query
def syllable_times(spark, sf_dir):
    """Where the level of each recording rises."""
    return r6(layers.syllables(clips(spark, sf_dir), 32, 8, CELL, 128))


def prints(spark, sf_dir) -> DataFrame:
    """name, bpm, source, frames: a recording's vectors folded to 12 classes, centred, of length 1; the tempo from the mean label."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("name"), "vec_id", "label", F.posexplode("embedding").alias("d", "x"))
    folded = v.groupBy("name", "vec_id", "label", (F.col("d") % 12).alias("c")).agg(F.sum(F.col("x").cast("double")).alias("x"))
    mean = folded.groupBy("name", "c").agg(F.avg("x").alias("mean"))
    centred = folded.join(mean, ["name", "c"]).withColumn("x", F.col("x") - F.col("mean"))
    frames = centred.groupBy("name", "vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("v"))
    size = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    frames = frames.withColumn("v", F.transform("v", lambda x: x / size))
    rows = frames.groupBy("name").agg((100 + 4 * F.avg("label")).alias("bpm"), F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("frames"))
    return rows.withColumn("source", F.when(F.col("name") % 2 == 0, "vocals").otherwise("mix"))


@query
def pair_match(spark, sf_dir):
    """Each recording against itself, the next one and the one after that."""
    names = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / VECTORS).alias("original")).distinct()
    asked = names.select("original", F.explode(F.sequence(F.col("original"), F.col("original") + 2)).alias("remix"))
    known = names.select(F.col("original").alias("remix"))
    return r6(pairs.matched(asked.join(known, "remix"), prints(spark, sf_dir)).drop("note"))


@query
def excerpt_prints(spark, sf_dir):
    """The print of each recording's most voiced six seconds, a row for each of its frames."""
    rows = excerpts.printed(clips(spark, sf_dir), 6.0, FRAMES, 256, CELL)
    frames = rows.select("name", "bpm", "downbeat", "begin", "seconds", F.posexplode("frames").alias("frame", "v"))
    return r6(frames.select("name", "bpm", "downbeat", "begin", "seconds", "frame", *(F.get("v", F.lit(k)).alias(f"class_{k}") for k in range(12))))


def tagged(spark, sf_dir) -> DataFrame:
    """user_id, title, cues and the tag's bytes: each user's first ten events are cues of a recording."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (micros("ts") / 1000).cast("long").alias("ms"), "value")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    cue = F.struct("k", F.col("event_type").alias("name"), (F.col("ms") % 86_400_000).alias("millis"), F.pmod(F.floor("value"), F.lit(256)).cast("int").alias("red"), (F.col("event_id") % 256).cast("int").alias("green"), F.lit(7).alias("blue"))
    rows = e.withColumn("k", k).where("k <= 10").groupBy("user_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    title = F.concat(F.lit("Listener "), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, " Ω").when(F.col("user_id") % 3 == 1, " é").otherwise(""))
    frames = (tags.text_frame("TIT2", title), tags.text_frame("TBPM", F.format_string("%.2f", (100 + F.col("user_id") % 40).cast("double"))), tags.described_frame("TXXX", F.lit("INITIALKEY"), F.lit("Am")), tags.described_frame("COMM", F.lit(""), title, "eng"), tags.object_frame(tags.MARKERS, tags.markers(F.col("cues"))))
    return rows.select("user_id", title.alias("title"), "cues", tags.tag(*frames).alias("bytes"))


@query
def tag_round_trip(spark, sf_dir):
    """Tags written and read again: their digest, and title, key, comment and cues as they come back."""
    rows = tags.with_fields(tagged(spark, sf_dir).select("user_id", "bytes"), "bytes")
    cues = F.transform(F.filter("tag.entries", lambda e: e["kind"] == "cue"), lambda e: F.concat_ws(":", e["index"].cast("string"), e["millis"].cast("string"), e["color"], e["name"]))
    return rows.select("user_id", F.sha2("bytes", 256).alias("digest"), F.col("tag.texts")["TIT2"].alias("title"), F.col("tag.described")["INITIALKEY"].alias("key"), F.col("tag.comments")[""].alias("comment"), F.array_join(cues, ",").alias("cues"), F.col("tag.error").alias("error"))
