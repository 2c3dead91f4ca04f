"""Exports: session documents, cue sheets, collections in XML, and the checks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import clock

# The schema's version, the range of tempi, letters of hot cues.
SCHEMA_VERSION, TEMPI, LETTERS = 2, (60.0, 200.0), "ABCDEFGH"
# End of fixed values.


def session_documents(tracks: DataFrame, cues: DataFrame, key: str) -> DataFrame:
    """tracks (one row each) with cues as a sorted array; of several cues of one kind the nth is numbered."""
    own = Window.partitionBy(key, "kind")
    k, n = F.row_number().over(own.orderBy("bar", "time")), F.count("*").over(own)
    named = cues.withColumn("__k", k).withColumn("__n", n).withColumn("name", F.when(F.col("__n") > 1, F.concat_ws(" ", "kind", F.col("__k").cast("string"))).otherwise(F.col("kind")))
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bar", "time", "name", "kind"))).alias("cues"))
    return tracks.join(lists, key, "left").withColumn("cues", F.coalesce("cues", F.array().cast(lists.schema["cues"].dataType))).withColumn("schema", F.lit(SCHEMA_VERSION))


def session_problems(sessions: DataFrame) -> Column:
    """An array of what is wrong with a session: schema, bpm, energy (its length), cues (their order)."""
    bars = F.transform("cues", lambda c: c["bar"])
    checks = {
        "schema": F.coalesce(F.col("schema") != SCHEMA_VERSION, F.lit(True)), "bpm": ~F.coalesce(F.col("bpm").between(*TEMPI), F.lit(False)),
        "energy": F.coalesce(F.size("energy_per_bar") != F.col("bars"), F.lit(True)), "cues": F.coalesce(bars != F.array_sort(bars), F.lit(True)),
    }
    return F.filter(F.array(*(F.when(c, k) for k, c in checks.items())), lambda x: x.isNotNull())


def cue_rows(sessions: DataFrame, key: str) -> DataFrame:
    """One row for each cue: key, n, letter (the first eight that don't end the track), name, kind, bar (from 1), time and clock."""
    rows = sessions.select(key, F.posexplode("cues").alias("pos", "c")).select(key, "pos", "c.*")
    hot = F.sum(F.when(F.col("kind") != "end", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    letter = F.when((F.col("kind") != "end") & (hot <= len(LETTERS)), F.substring(F.lit(LETTERS), hot.cast("int"), F.lit(1)))
    return rows.select(key, (F.col("pos") + 1).alias("n"), letter.alias("letter"), "name", "kind", (F.col("bar") + 1).alias("bar"), F.bround("time", 3).alias("time"), clock(F.col("time")).alias("clock"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def escaped(text: Column) -> Column:
    """For XML attributes; characters that XML doesn't allow go."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://localhost"), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def track_xml(sessions: DataFrame, key: str) -> DataFrame:
    """key and xml: a track's element with its grid's anchor and its cues as marks."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(c.cast("string")), F.lit('"'))
    numbered = F.transform("cues", lambda c, i: F.concat(F.lit("<POSITION_MARK"), attribute("Name", c["name"]), F.lit(' Type="0"'), attribute("Start", F.format_string("%.3f", c["time"])), attribute("Num", F.when((c["kind"] != "end") & (i < 8), i).otherwise(F.lit(-1))), F.lit("/>")))
    head = F.concat(F.lit("<TRACK"), attribute("TrackID", F.xxhash64(key).cast("string")), attribute("Name", F.col(key)), attribute("Location", file_url(F.col("file"))), attribute("AverageBpm", F.format_string("%.2f", F.col("bpm"))), attribute("TotalTime", F.rint("duration").cast("long")), attribute("Tonality", F.col("camelot")), F.lit(">"))
    grid = F.concat(F.lit("<TEMPO"), attribute("Inizio", F.format_string("%.3f", F.col("first_downbeat_sec"))), attribute("Bpm", F.format_string("%.2f", F.col("bpm"))), F.lit(' Metro="4/4" Battito="1"/>'))
    return sessions.select(key, F.concat(head, grid, F.array_join(numbered, ""), F.lit("</TRACK>")).alias("xml"))


def collection_lines(tracks: DataFrame, playlist: str, order: str) -> DataFrame:
    """part, at, xml: the lines of a whole document from tracks (xml, key and an order): a head, each track's element, and a playlist of their keys in that order."""
    count = tracks.agg(F.count("*").cast("string").alias("n"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><DJ_PLAYLISTS Version="1.0.0"><PRODUCT Name="cadenza"/><COLLECTION Entries="'), F.col("n"), F.lit('">'))
    mid = F.concat(F.lit('</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT" Count="1"><NODE Name="'), escaped(F.lit(playlist)), F.lit('" Type="1" KeyType="0" Entries="'), F.col("n"), F.lit('">'))
    number = F.regexp_extract("xml", 'TrackID="([^"]*)"', 1)
    line = lambda part, at, xml: (F.lit(part).alias("part"), at.cast("double").alias("at"), xml.alias("xml"))
    none = F.lit(0)
    rows = [count.select(*line(0, none, head)), tracks.select(*line(1, F.col(order), F.col("xml"))), count.select(*line(2, none, mid))]
    rows += [tracks.select(*line(3, F.col(order), F.concat(F.lit('<TRACK Key="'), number, F.lit('"/>')))), count.select(*line(4, none, F.lit("</NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>")))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_collection(tracks: DataFrame, path: str, playlist: str = "set", order: str = "pos") -> None:
    """Text files whose lines, one file after the other by name, are the document: sorted by ranges, so that no task holds all."""
    collection_lines(tracks, playlist, order).repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("xml").write.mode("overwrite").text(path)


def resized(tracks: DataFrame, sizes: DataFrame) -> DataFrame:
    """tracks (key and xml) whose Size attribute says what the file (key, size) has now; tracks without a file or with that size stay as they are."""
    now = sizes.select(F.col("key").alias("__key"), F.col("size").cast("string").alias("__size"))
    rows = tracks.join(now, F.col("key") == F.col("__key"), "left")
    said = F.regexp_replace("xml", ' Size="[^"]*"', "")
    new = F.concat(F.regexp_extract(said, r"^(<TRACK)", 1), F.lit(' Size="'), F.col("__size"), F.lit('"'), F.regexp_replace(said, r"^<TRACK", ""))
    return rows.select(*(F.when(F.col("__size").isNotNull() & F.col("xml").startswith("<TRACK"), new).otherwise(F.col("xml")).alias("xml") if c == "xml" else F.col(c) for c in tracks.columns))


def with_feedback(sessions: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """sessions with feedback: their markers (key, time, bar, category, note, author, at) by time; nothing else changes, and what was there is replaced."""
    fields = ("time", "bar", "category", "note", "author", "at")
    lists = markers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("__feedback"))
    rows = sessions.drop("feedback").join(lists, key, "left")
    return rows.withColumn("feedback", F.coalesce("__feedback", F.array().cast(lists.schema["__feedback"].dataType))).drop("__feedback")


def comment(bpm: Column, key: Column, camelot: Column, cues: Column) -> Column:
    """A track in one line: tempo, key, and its hot cues with their letters and times."""
    hot = F.slice(F.filter(cues, lambda c: c["kind"] != "end"), 1, len(LETTERS))
    said = F.transform(hot, lambda c, i: F.concat_ws(" ", F.substring(F.lit(LETTERS), i + 1, F.lit(1)), c["name"], clock(c["time"])))
    named = F.trim(F.concat_ws(" ", key, camelot))
    return F.array_join(F.filter(F.concat(F.array(F.concat(F.format_string("%.2f", bpm), F.lit(" BPM")), named), said), lambda x: x != ""), " | ")
