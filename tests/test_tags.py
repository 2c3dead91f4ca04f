"""Tags of audio files: bytes against a plain writer, and cut or foreign ones."""

import base64
import hashlib
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from cadenza.functions import tags
from cadenza.plans import audio

DATA = "/root/testdata/sf0.001"


def plain_text(text):
    return (b"\0" + text.encode("latin-1"), b"\0") if all(ord(c) < 256 for c in text) else (b"\1\xff\xfe" + text.encode("utf-16-le"), b"\0\0")


def plain_frame(name, body):
    return name.encode() + struct.pack(">I", len(body)) + b"\0\0" + body


def plain_described(name, description, text, before=b""):
    if all(ord(c) < 256 for c in description + text):
        return plain_frame(name, b"\0" + before + description.encode("latin-1") + b"\0" + text.encode("latin-1"))
    return plain_frame(name, b"\1" + before + b"\xff\xfe" + description.encode("utf-16-le") + b"\0\0\xff\xfe" + text.encode("utf-16-le"))


def plain_markers(cues, color=(255, 255, 255), locked=False):
    entry = lambda name, body: name + b"\0" + struct.pack(">I", len(body)) + body
    out = b"\1\1" + entry(b"COLOR", b"\0" + bytes(color))
    for k, (name, millis, *rgb) in enumerate(cues[:8]):
        out += entry(b"CUE", b"\0" + bytes([k]) + struct.pack(">I", millis) + b"\0" + bytes(rgb) + b"\0\0" + name.encode() + b"\0")
    coded = base64.b64encode(out + entry(b"BPMLOCK", bytes([locked])) + b"\0")
    return b"\1\1" + b"\n".join(coded[k : k + 72] for k in range(0, len(coded), 72)) + b"\0"


def plain_tag(title, bpm, cues):
    body = plain_frame("TIT2", plain_text(title)[0]) + plain_frame("TBPM", plain_text(bpm)[0]) + plain_described("TXXX", "INITIALKEY", "Am") + plain_described("COMM", "", title, b"eng")
    body += plain_frame("GEOB", b"\0application/octet-stream\0\0Serato Markers2\0" + plain_markers(cues)) + bytes(1024)
    n = len(body)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_tags_of_whole_tables(spark):
    want = {}
    for r in audio.tagged(spark, DATA).collect():
        cues = [(c["name"], c["millis"], c["red"], c["green"], c["blue"]) for c in r["cues"]]
        whole = plain_tag(r["title"], f"{100 + r['user_id'] % 40:.2f}", cues)
        assert bytes(r["bytes"]) == whole
        read = ",".join(f"{k}:{ms}:{bytes(rgb).hex()}:{name}" for k, (name, ms, *rgb) in enumerate(cues[:8]))
        want[r["user_id"]] = (hashlib.sha256(whole).hexdigest(), r["title"], "Am", r["title"], read, None)
    assert {r["user_id"]: tuple(r)[1:] for r in audio.tag_round_trip(spark, DATA).collect()} == want and len(want) > 5


def test_random_cues_come_back(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        cues = [("".join(rng.choices("ab é日", k=rng.randint(0, 30))), rng.randrange(1 << 31), *(rng.randrange(256) for _ in range(3))) for _ in range(rng.randint(0, 10))]
        rows.append((k, cues if k else None, tuple(rng.randrange(256) for _ in range(3)), rng.random() < 0.5))
    df = spark.createDataFrame(rows, "k int, cues array<struct<name: string, millis: long, red: int, green: int, blue: int>>, c struct<red: int, green: int, blue: int>, locked boolean")
    for r in df.withColumn("m", tags.markers(F.col("cues"), F.col("c"), F.col("locked"))).collect():
        _, cues, color, locked = rows[r["k"]]
        assert bytes(r["m"]) == plain_markers(cues or [], color, locked)
        found, error = tags.marker_entries(bytes(r["m"]))
        assert error is None and [(e["name"], e["millis"], e["color"]) for e in found if e["kind"] == "cue"] == [(n, ms, bytes(rgb).hex()) for n, ms, *rgb in (cues or [])[:8]]
        assert found[0] == {"kind": "color", "color": bytes(color).hex()} and found[-1]["kind"] == ("locked" if locked else "free")


def test_cut_and_foreign_bytes_give_a_row(spark):
    whole = plain_tag("Ω title", "120.00", [("drop", 1000, 1, 2, 3)])
    rng = random.Random(3)
    cases = [whole[:k] for k in range(0, len(whole) - 1024, 7)] + [bytes(rng.randrange(256) for _ in range(200)) for _ in range(20)]
    cases += [b"ID3\3\0\0\0\0\x10\0" + bytes(rng.randrange(256) for _ in range(200)) for _ in range(40)] + [None, b"", b"\xff\xfbmp3"]
    got = tags.with_fields(spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(cases)], "k int, data binary"), "data").orderBy("k").collect()
    assert len(got) == len(cases)
    for r, c in zip(got, cases, strict=True):
        own = r["tag"]
        if not c or c[:3] != b"ID3":
            assert own["texts"] == {} and own["entries"] == [] and own["error"] is None
        elif c == whole[: len(c)]:
            assert own["error"] and " at " in own["error"]


def test_the_sound_behind_a_tag_stays(spark):
    sound = b"\xff\xfb" + bytes(range(256))
    cases = [plain_tag("t", "1", []) + sound, sound, b"", b"ID3", b"ID3\4\0\x10\0\0\0\x02ab" + bytes(10) + sound]
    got = [bytes(r[0]) for r in spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, d binary").orderBy("k").select(tags.without_tag(F.col("d"))).collect()]
    assert got == [sound, sound, b"", b"ID3", sound]
