"""Files as tables: audio listings and WAV samples, link lists, session documents, manifests, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.session import ship

# Extensions of audio files, and what an export prefers of one name.
AUDIO = ("mp3", "m4a", "wav", "flac", "aiff", "aif", "ogg", "opus", "webm", "mp4")
PREFERRED = ("mp3", "wav", "m4a")
# End of fixed values.

SESSION = """schema INT, file STRING, bpm DOUBLE, first_downbeat_sec DOUBLE, beats_per_bar INT, key STRING, camelot STRING, duration DOUBLE, bars INT,
 cues ARRAY<STRUCT<name: STRING, bar: INT, time: DOUBLE, kind: STRING>>, sections ARRAY<STRUCT<kind: STRING, start_bar: INT, bars: INT, start: DOUBLE, `end`: DOUBLE>>,
 energy_per_bar ARRAY<DOUBLE>, loudness STRUCT<peak_db: DOUBLE, rms_db: DOUBLE>"""
MANIFEST = "name STRING, tracks ARRAY<STRUCT<source: STRING, output: STRING, session: STRING, status: STRING, error: STRING, bpm: DOUBLE, camelot: STRING, duration: DOUBLE>>"
CLIPS = "track_id string, sr int, chunk int, start_sample long, samples array<float>"


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size and changed of audio files directly in a folder, hidden ones not; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*AUDIO) & ~name.startswith(".")).orderBy("path")


def wav_clips(spark: SparkSession, folder: str, chunk: int = 1 << 16, overlap: int = 2048) -> DataFrame:
    """The mono samples of WAV files in overlapping chunks; see CLIPS. A file that can't be read has one row with a null rate."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return wav_samples(files, chunk, overlap)


def wav_samples(files: DataFrame, chunk: int = 1 << 16, overlap: int = 0) -> DataFrame:
    """The same of files (path, content), whose track_id is the path. Kernels over chunks need no overlap, and don't mind it."""
    ship(files.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            for path, content in batch.itertuples(index=False, name=None):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8).reshape(-1, width)
                except (wave.Error, EOFError, ValueError):
                    yield pd.DataFrame({"track_id": [path], "sr": pd.array([None], "Int32"), "chunk": [0], "start_sample": [0], "samples": [None]})
                    continue
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw ^ np.uint8(128) if width == 1 else raw
                x = wide.view("<i4").reshape(-1, channels).mean(axis=1) / 2**31
                rows = [(path, rate, k, at, x[at : at + chunk + overlap].astype(np.float32)) for k, at in enumerate(range(0, max(len(x), 1), chunk))]
                yield pd.DataFrame(rows, columns=["track_id", "sr", "chunk", "start_sample", "samples"])

    return files.select("path", "content").mapInPandas(decode, CLIPS)


def links(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1 within its file) and link: blank and # lines are skipped; of a link only what stands before white space counts."""
    text = F.trim("value")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return rows.where((text != "") & ~text.startswith("#")).select("file", (F.col("line") + 1).alias("line"), F.when(F.lower(text).startswith("http"), F.split(text, r"\s+")[0]).otherwise(text).alias("link"))


def playlist_entries(rows: DataFrame, column: str) -> DataFrame:
    """rows with pos and link for each entry of a JSON playlist that has a link."""
    entries = F.from_json(column, "entries ARRAY<STRUCT<url: STRING, webpage_url: STRING>>")["entries"]
    found = F.filter(F.transform(entries, lambda e: F.coalesce(e["webpage_url"], e["url"])), lambda x: x.isNotNull() & (x != ""))
    return rows.select("*", F.posexplode(found).alias("pos", "link"))


def is_playlist(column: str) -> Column:
    """Whether a JSON probe holds more than one entry with a link."""
    entries = F.from_json(column, "entries ARRAY<STRUCT<url: STRING, webpage_url: STRING>>")["entries"]
    return F.coalesce(F.size(F.filter(entries, lambda e: F.coalesce(e["webpage_url"], e["url"], F.lit("")) != "")) > 1, F.lit(False))


def candidate(column: str, query: Column) -> Column:
    """struct(url, title, uploader, duration, query) of a search result in JSON; null without a link. A bare id is a link of the site that was searched."""
    e = F.from_json(column, "url STRING, webpage_url STRING, id STRING, title STRING, uploader STRING, channel STRING, uploader_id STRING, duration DOUBLE")
    first = lambda *names: F.coalesce(*(F.nullif(e[n], F.lit("")) for n in names), F.lit(""))
    link = F.trim(first("url", "webpage_url"))
    link = F.when((link != "") & ~link.startswith("http"), F.concat(F.lit("https://www.youtube.com/watch?v="), e["id"])).otherwise(link)
    return F.when(link != "", F.struct(link.alias("url"), F.trim(first("title")).alias("title"), F.trim(first("uploader", "channel", "uploader_id")).alias("uploader"), F.coalesce(e["duration"], F.lit(0.0)).alias("duration"), query.alias("query")))


def reference_pairs(files: DataFrame, names: DataFrame, path: str = "path") -> DataFrame:
    """name and path: the first remix in a listing whose file is called like the name, compared by letters and digits only."""
    base, plain = F.element_at(F.split(path, "/"), -1), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    found = files.where(F.contains(base, F.lit(".remix.")) & F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1)).isin(*AUDIO)).select(plain(F.substring_index(base, ".remix.", 1)).alias("__slug"), path)
    first = found.groupBy("__slug").agg(F.min(path).alias("path")).where("__slug <> ''")
    return names.join(first, plain(F.col("name")) == F.col("__slug")).select("name", "path")


def abandoned_uploads(files: DataFrame, now: Column, older: float = 3600.0) -> DataFrame:
    """Of a listing (path, changed) the half-streamed files, and the folders of links, whose latest change is longer ago than that: path and whether it is a folder."""
    parts = F.split("path", "/")
    folder = F.filter(F.transform(parts, lambda p, i: F.when(p.startswith("link-"), F.array_join(F.slice(parts, 1, i + 1), "/"))), lambda p: p.isNotNull())
    rows = files.select(F.coalesce(F.get(folder, F.lit(0)), F.when(F.col("path").endswith(".part"), F.col("path"))).alias("what"), (F.size(folder) > 0).alias("folder"), "changed").where("what is not null")
    latest = rows.groupBy(F.col("what").alias("path"), "folder").agg(F.max("changed").alias("changed"))
    return latest.where(F.unix_micros(now) - F.unix_micros("changed") > int(older * 1e6)).select("path", "folder")


def orphans(files: DataFrame, now: Column, older: float = 6 * 3600.0) -> DataFrame:
    """Folders of a listing (path, changed) that are named by an id, hold no meta.json and haven't changed for that long."""
    folder = F.regexp_extract("path", r"^(.*/[0-9a-f]{16})/", 1)
    rows = files.select(folder.alias("folder"), (F.element_at(F.split("path", "/"), -1) == "meta.json").alias("meta"), "changed").where("folder <> ''")
    own = rows.groupBy("folder").agg(F.max("changed").alias("changed"), F.max("meta").alias("meta"))
    return own.where(~F.col("meta") & (F.unix_micros(now) - F.unix_micros("changed") > int(older * 1e6))).select("folder")


def sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The JSON documents of a folder with stem, those that can't be read left out."""
    rows = spark.read.schema(schema + ", _corrupt_record STRING").json(folder, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.withColumn("stem", stem(F.input_file_name())).where("_corrupt_record is null").drop("_corrupt_record")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session documents with stem (the join key to the audio beside them) and broken (true where one is no JSON)."""
    rows = spark.read.schema(SESSION + ", _corrupt_record STRING").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    name = F.regexp_replace(stem(F.input_file_name()), r"\.session$", "")
    return rows.withColumn("stem", name).withColumn("broken", F.col("_corrupt_record").isNotNull() | F.col("bpm").isNull()).drop("_corrupt_record")


def manifest_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of a set's manifest that are there (ok or skipped), in the set's order, each file name once."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select("name", F.posexplode("tracks").alias("pos", "t")).select("name", "pos", "t.*")
    first = Window.partitionBy("name", F.element_at(F.split("output", "/"), -1)).orderBy("pos")
    return rows.where(F.col("status").isin("ok", "skipped") & (F.coalesce("output", F.lit("")) != "")).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").orderBy("name", "pos")


def preferred_files(files: DataFrame, path: str = "path") -> DataFrame:
    """One file for each stem, by format."""
    kind = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), kind), F.lit(0)), F.lit(99))
    best = Window.partitionBy(stem(F.col(path))).orderBy(place, path)
    return files.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def profiles(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Profiles by name from folders in order of precedence; those without a tempo don't count."""
    rows = None
    for k, folder in enumerate(folders):
        own = spark.read.schema("bpm DOUBLE, bpm_spread DOUBLE, swing DOUBLE, intro_bars INT, breakdown_bars INT, n_refs INT").json(folder, multiLine=True).withColumn("name", stem(F.input_file_name())).withColumn("precedence", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    first = Window.partitionBy("name").orderBy("precedence")
    return rows.where("bpm is not null").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def kits(spark: SparkSession, folder: str) -> DataFrame:
    """Stored kits of a folder, one in each of its folders with meta.json and loop.wav: name, bpm, score and when it was changed, the newest first; documents that can't be read are left out."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    named = listing.select(F.element_at(parts, -2).alias("__folder"), F.element_at(parts, -1).alias("__file"), "content", "modificationTime")
    loops = named.where("__file = 'loop.wav'").select("__folder")
    meta = named.where("__file = 'meta.json'").join(loops, "__folder", "left_semi")
    read = meta.select("__folder", F.from_json(F.decode("content", "UTF-8"), "name STRING, bpm DOUBLE, score DOUBLE, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("m"), F.col("modificationTime").alias("changed"))
    return read.where("m is not null and m._bad is null").select(F.coalesce("m.name", "__folder").alias("name"), "m.bpm", "m.score", "changed").orderBy(F.desc("changed"))


def chosen_kit(found: DataFrame, name: str | None, pinned: str | None = None) -> DataFrame:
    """The kit asked for, else the pinned one, else the newest; none of them for the name none."""
    if (name or "").strip().lower() == "none":
        return found.limit(0)
    wanted = (name or pinned or "").strip().lower()
    return found.where(F.col("name") == wanted) if wanted else found.orderBy(F.desc("changed")).limit(1)
