import json
import wave

import numpy as np
from pyspark.sql import functions as F

from cadenza.sinks import exports
from cadenza.sources import files
from cadenza.streaming import jobs


def test_sources(spark, tmp_path):
    folder = tmp_path / "audio"
    folder.mkdir()
    x = (np.sin(np.arange(3000) / 5) * 20000).astype("<i2")
    with wave.open(str(folder / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(x.tobytes())
    (folder / "b.wav").write_bytes(b"broken")
    (folder / ".hidden.wav").write_bytes(b"")
    (folder / "b.mp3").write_bytes(b"x")
    (folder / "note.txt").write_text("x")
    found = files.audio_files(spark, str(folder))
    assert [r["path"].rsplit("/", 1)[-1] for r in found.collect()] == ["a.wav", "b.mp3", "b.wav"]
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in files.preferred_files(found).collect()) == ["a.wav", "b.mp3"]
    clips = {(r["track_id"], r["chunk"]): r for r in files.wav_clips(spark, str(folder), chunk=2000, overlap=100).collect()}
    assert clips["b.wav", 0]["sr"] is None and len(clips["a.wav", 0]["samples"]) == 2100 and len(clips["a.wav", 1]["samples"]) == 1000
    assert np.allclose(clips["a.wav", 0]["samples"][:50], x[:50] / 32768, atol=1e-6)
    (tmp_path / "links.txt").write_text("# no\n\nhttp://a.b/c extra words\nsome title\n")
    assert [(r["line"], r["link"]) for r in files.links(spark, str(tmp_path / "links.txt")).collect()] == [(3, "http://a.b/c"), (4, "some title")]
    rows = spark.createDataFrame([('{"entries": [{"url": "u"}, {"url": ""}, {"webpage_url": "w", "url": "z"}]}',)], "info string")
    assert [r["link"] for r in files.playlist_entries(rows, "info").collect()] == ["u", "w"]


def test_documents(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.session.json").write_text(json.dumps({"schema": 2, "bpm": 124.0, "bars": 2, "cues": [{"name": "intro", "bar": 0, "time": 0.0, "kind": "intro"}], "energy_per_bar": [0.5, 1.0]}))
    (tmp_path / "s/two.session.json").write_text("not json")
    rows = files.sessions(spark, str(tmp_path / "s"))
    assert {(r["stem"], r["broken"]) for r in rows.collect()} == {("one", False), ("two", True)}
    assert rows.where("not broken").select(exports.session_problems(rows)).first()[0] == []
    (tmp_path / "set.json").write_text(json.dumps({"name": "n", "tracks": [{"output": "a/x.mp3", "status": "ok"}, {"output": "b/x.mp3", "status": "ok"}, {"output": "y.mp3", "status": "failed"}, {"output": "z.mp3", "status": "skipped"}]}))
    assert [r["output"] for r in files.manifest_outputs(spark, str(tmp_path / "set.json")).collect()] == ["a/x.mp3", "z.mp3"]
    for k, text in enumerate(('{"bpm": 1.0}', '{"bpm": 2.0}')):
        (tmp_path / f"p{k}").mkdir()
        (tmp_path / f"p{k}/house.json").write_text(text)
    assert [(r["name"], r["bpm"]) for r in files.profiles(spark, [str(tmp_path / "p0"), str(tmp_path / "p1")]).collect()] == [("house", 1.0)]


def test_exports(spark, tmp_path):
    tracks = spark.createDataFrame([("a & b", 124.0, 8, "/x y/a.mp3", 61.5, "8A", 0.25, [0.1] * 8)], "name string, bpm double, bars int, file string, duration double, camelot string, first_downbeat_sec double, energy_per_bar array<double>")
    cues = spark.createDataFrame([("a & b", "drop", 4, 8.0), ("a & b", "intro", 0, 0.0), ("a & b", "drop", 6, 12.0), ("a & b", "end", 8, 16.0)], "name string, kind string, bar int, time double").withColumnRenamed("name", "track")
    docs = exports.session_documents(tracks.withColumnRenamed("name", "track"), cues, "track")
    rows = exports.cue_rows(docs, "track").orderBy("n").collect()
    assert [(r["letter"], r["name"], r["bar"], r["clock"]) for r in rows] == [("A", "intro", 1, "0:00"), ("B", "drop 1", 5, "0:08"), ("C", "drop 2", 7, "0:12"), (None, "end", 9, "0:16")]
    xml = exports.track_xml(docs, "track").first()["xml"]
    assert 'Name="a &amp; b"' in xml and 'Location="file://localhost/x%20y/a.mp3"' in xml and xml.count("<POSITION_MARK") == 4
    exports.write_csv(exports.cue_rows(docs, "track"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    bad = docs.withColumn("bpm", F.lit(10.0)).withColumn("bars", F.lit(3))
    assert bad.select(exports.session_problems(bad)).first()[0] == ["bpm", "energy"]


def test_streams(spark, tmp_path):
    events = [("j", 1, 0, "phase", "load"), ("j", 2, 5, "phase", "mix"), ("j", 2, 5, "phase", "mix"), ("k", 1, 1, "phase", "load"), ("j", 3, 9, "done", None)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"job_id": j, "seq": s, "at": f"2024-01-01T00:00:0{t}Z", "type": kind, "phase": p}) for j, s, t, kind, p in events))
    query = jobs.phase_times(jobs.job_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("phases").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("phases").collect()) == [("j", "load", 5.0, False), ("j", "mix", 4.0, True)]
    rows = spark.createDataFrame([("marker", 1), ("rating", 2), ("marker", 3)], "kind string, x long")
    write = jobs.feedback_writer(str(tmp_path / "out"))
    for _ in range(2):
        write(rows, 0)
    assert spark.read.parquet(str(tmp_path / "out/markers")).count() == 2 and spark.read.parquet(str(tmp_path / "out/ratings")).count() == 1


def test_collections_playlists_and_sizes(spark, tmp_path):
    import xml.etree.ElementTree as ET

    tracks = spark.createDataFrame([(f"t{k}", f'<TRACK TrackID="{k}" Name="t{k}"><TEMPO Bpm="120"/></TRACK>', 30 - k) for k in range(30)], "key string, xml string, pos int").repartition(4)
    exports.write_collection(tracks, str(tmp_path / "c"), "A & B")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    root = ET.fromstring(text)
    assert root.find("COLLECTION").get("Entries") == "30" and [t.get("TrackID") for t in root.find("COLLECTION")] == [str(k) for k in range(29, -1, -1)]
    node = root.find("PLAYLISTS/NODE/NODE")
    assert node.get("Name") == "A & B" and [t.get("Key") for t in node] == [str(k) for k in range(29, -1, -1)]
    sizes = spark.createDataFrame([("t1", 77), ("t9", 5)], "key string, size long")
    once = exports.resized(tracks, sizes)
    got = {r["key"]: r["xml"] for r in exports.resized(once, sizes).collect()}
    assert got["t1"].startswith('<TRACK Size="77" TrackID="1"') and got["t1"].count("Size=") == 1 and "Size" not in got["t2"]


def test_feedback_goes_into_sessions(spark):
    sessions = spark.createDataFrame([("a", 120.0), ("b", 90.0)], "id string, bpm double")
    markers = spark.createDataFrame([("a", 9.0, 5, "good", "", "neel", 1.0), ("a", 2.0, 1, "clash", "x", "gemini", 2.0)], "id string, time double, bar int, category string, note string, author string, at double")
    got = {r["id"]: [m["time"] for m in r["feedback"]] for r in exports.with_feedback(exports.with_feedback(sessions, markers, "id"), markers, "id").collect()}
    assert got == {"a": [2.0, 9.0], "b": []}
    cues = F.array(F.struct(F.lit("Intro").alias("name"), F.lit(0.0).alias("time"), F.lit("intro").alias("kind")), F.struct(F.lit("Drop").alias("name"), F.lit(61.0).alias("time"), F.lit("drop").alias("kind")), F.struct(F.lit("End").alias("name"), F.lit(99.0).alias("time"), F.lit("end").alias("kind")))
    assert spark.range(1).select(exports.comment(F.lit(124.0), F.lit("A minor"), F.lit("8A"), cues)).first()[0] == "124.00 BPM | A minor 8A | A Intro 0:00 | B Drop 1:01"


def test_listings(spark, tmp_path):
    import datetime as dt

    now, old = dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 1)
    rows = [("/u/x.part", old), ("/u/y.part", now), ("/u/link-1/a/b.mp3", old), ("/u/link-2/a.mp3", old), ("/u/link-2/b.mp3", now), ("/u/keep.mp3", old), ("/r/0123456789abcdef/a.mp3", old), ("/r/0123456789abcde0/meta.json", old), ("/r/named/a.mp3", old), ("/r/0123456789abcde1/a.mp3", now)]
    listing = spark.createDataFrame(rows, "path string, changed timestamp")
    assert sorted(tuple(r) for r in files.abandoned_uploads(listing, F.lit(now)).collect()) == [("/u/link-1", True), ("/u/x.part", False)]
    assert [r["folder"] for r in files.orphans(listing, F.lit(now)).collect()] == ["/r/0123456789abcdef"]
    pairs = spark.createDataFrame([("/p/My Song.remix.mp3",), ("/p/my_song.remix.wav",), ("/p/other.original.mp3",), ("/p/x.remix.txt",)], "path string")
    assert [tuple(r) for r in files.reference_pairs(pairs, spark.createDataFrame([("my-song!",), ("x",), ("",)], "name string")).collect()] == [("my-song!", "/p/My Song.remix.mp3")]
    found = spark.createDataFrame([('{"id": "abc", "url": "abc", "title": " t ", "channel": "c", "duration": 3}',), ('{"title": "none"}',), ("broken",)], "j string").select(files.candidate("j", F.lit("q")).alias("c")).collect()
    assert found[0]["c"]["url"].endswith("v=abc") and found[0]["c"]["uploader"] == "c" and found[0]["c"]["title"] == "t" and found[1]["c"] is None and found[2]["c"] is None
    lists = spark.createDataFrame([('{"entries": [{"url": "a"}, {"url": "b"}]}',), ('{"entries": [{"url": "a"}, {"url": ""}]}',), ("{}",)], "j string")
    assert [r[0] for r in lists.select(files.is_playlist("j")).collect()] == [True, False, False]
    (tmp_path / "one.json").write_text('{"score": 0.5}')
    (tmp_path / "two.json").write_text("broken")
    assert [(r["stem"], r["score"]) for r in files.sidecars(spark, str(tmp_path), "score DOUBLE").collect()] == [("one", 0.5)]


def test_kits(spark, tmp_path):
    import os

    for k, (name, meta, loop) in enumerate([("old", '{"bpm": 120.0}', True), ("new", '{"name": "own", "bpm": 124.0}', True), ("half", '{"bpm": 1.0}', False), ("bad", "no", True)]):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(meta)
        os.utime(tmp_path / name / "meta.json", (1000 + k, 1000 + k))
        if loop:
            (tmp_path / name / "loop.wav").write_bytes(b"x")
    found = files.kits(spark, str(tmp_path))
    assert [(r["name"], r["bpm"]) for r in found.collect()] == [("own", 124.0), ("old", 120.0)]
    pick = lambda *a: [r["name"] for r in files.chosen_kit(found, *a).collect()]
    assert pick(None) == ["own"] and pick(None, "old") == ["old"] and pick(" None ") == [] and pick("OLD") == ["old"]
