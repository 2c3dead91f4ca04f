"""Tags of audio files as binary columns: frames and cue markers are written by expressions, and read back row by row with what is wrong and where.

A tag is "ID3", version 3, a size in four bytes of 7 bits, and frames: a name of four letters, a size in 32 bits, two flag bytes and a body. Texts
stand in ISO-8859-1 if that has all their characters, else in UTF-16 with a byte order mark. Markers lie in a frame for objects, as base64 in lines, and hold entries of their own: a name, a size, a body.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import ship

# Names of the formats, line length of markers, most cues that a deck shows.
MARKERS, MIME, LINE, MOST_CUES = "Serato Markers2", "application/octet-stream", 72, 8
# End of fixed values.


def raw(text: str) -> Column:
    return F.unhex(F.lit(text.encode("latin-1").hex()))


def number(n: Column) -> Column:
    """32 bits, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def sevens(n: Column) -> Column:
    """A size of up to 28 bits in four bytes of 7."""
    n = n.cast("long")
    part = lambda mask, by: F.shiftleft(n.bitwiseAND(F.lit(mask)), by)
    return number(part(0x0FE00000, 3).bitwiseOR(part(0x1FC000, 2)).bitwiseOR(part(0x3F80, 1)).bitwiseOR(part(0x7F, 0)))


def _narrow(*texts: Column) -> Column:
    out = F.lit(True)
    for t in texts:
        out = out & ~t.rlike(r"[^\x{00}-\x{FF}]")
    return out


def _wide(text: Column) -> Column:
    return F.concat(F.unhex(F.lit("fffe")), F.encode(text, "UTF-16LE"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def frame(name: str, body: Column) -> Column:
    return _let(body, lambda b: F.concat(raw(name), number(F.octet_length(b)), raw("\0\0"), b))


def text_frame(name: str, text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return frame(name, F.when(_narrow(text), F.concat(raw("\0"), F.encode(text, "ISO-8859-1"))).otherwise(F.concat(raw("\1"), _wide(text))))


def described_frame(name: str, description: Column, text: Column, before: str = "") -> Column:
    """A frame of a described text: TXXX, or COMM with its language before. Both texts have one encoding."""
    description, text = F.coalesce(description, F.lit("")), F.coalesce(text, F.lit(""))
    narrow = F.concat(raw("\0" + before), F.encode(description, "ISO-8859-1"), raw("\0"), F.encode(text, "ISO-8859-1"))
    return frame(name, F.when(_narrow(description, text), narrow).otherwise(F.concat(raw("\1" + before), _wide(description), raw("\0\0"), _wide(text))))


def object_frame(description: str, data: Column) -> Column:
    return frame("GEOB", F.concat(raw(f"\0{MIME}\0\0{description}\0"), data))


def _entry(name: str, body: Column) -> Column:
    return _let(body, lambda b: F.concat(raw(name + "\0"), number(F.octet_length(b)), b))


def markers(cues: Column, color: Column | None = None, locked: Column | None = None) -> Column:
    """The markers' bytes from cues (name, millis, red, green, blue), of which eight are written, the track's color (red, green, blue; white) and whether its tempo is locked."""
    byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    rgb = lambda c: F.concat(byte(c["red"]), byte(c["green"]), byte(c["blue"]))
    cue = lambda c, i: _entry("CUE", F.concat(raw("\0"), byte(i), number(c["millis"]), raw("\0"), rgb(c), raw("\0\0"), F.encode(F.coalesce(c["name"], F.lit("")), "UTF-8"), raw("\0")))
    nothing = F.unhex(F.lit(""))
    entries = F.coalesce(F.aggregate(F.transform(F.slice(cues, 1, MOST_CUES), cue), nothing, lambda a, c: F.concat(a, c)), nothing)
    own = _entry("COLOR", F.concat(raw("\0"), rgb(color) if color is not None else raw("\xff\xff\xff")))
    lock = F.when(F.coalesce(locked, F.lit(False)), raw("\1")).otherwise(raw("\0")) if locked is not None else raw("\0")
    payload = F.concat(raw("\1\1"), own, entries, _entry("BPMLOCK", lock), raw("\0"))
    lines = F.regexp_replace(F.regexp_replace(F.base64(payload), r"[\r\n]", ""), f"(.{{{LINE}}})(?=.)", "$1\n")
    return F.concat(raw("\1\1"), F.encode(lines, "ISO-8859-1"), raw("\0"))


def tag(*frames: Column, padding: int = 1024) -> Column:
    """The tag of these frames, with room to grow. Frames that are null are left out."""
    body = F.concat(*(F.coalesce(f, F.unhex(F.lit(""))) for f in frames), F.unhex(F.lit("00" * padding)))
    return _let(body, lambda b: F.concat(raw("ID3\3\0\0"), sevens(F.octet_length(b)), b))


def without_tag(data: Column) -> Column:
    """The bytes behind a leading tag, if there is one. data: binary."""
    at = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int")
    size = F.shiftleft(at(7), 21) + F.shiftleft(at(8), 14) + F.shiftleft(at(9), 7) + at(10)
    footer = F.when(at(6).bitwiseAND(F.lit(0x10)) > 0, 10).otherwise(0)
    tagged = (F.octet_length(data) >= 10) & (F.substring(data, 1, 3) == raw("ID3"))
    return F.when(tagged, F.substring(data, F.lit(11) + size + footer, F.octet_length(data))).otherwise(data)


def _text(encoding: int, data: bytes) -> str:
    return data.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(encoding, "utf-8"), "replace").rstrip("\0")


def _cut(encoding: int, data: bytes) -> tuple[bytes, bytes]:
    """What stands before the first terminator and behind it; everything and nothing if there is none."""
    if encoding in (1, 2):
        at = next((k for k in range(0, len(data) - 1, 2) if data[k : k + 2] == b"\0\0"), None)
        return (data, b"") if at is None else (data[:at], data[at + 2 :])
    head, _, rest = data.partition(b"\0")
    return head, rest


def marker_entries(data: bytes) -> tuple[list[dict], str | None]:
    """The cues, colors and locks in markers, and what is wrong, if anything is: what was read before it counts."""
    if data[:2] != b"\1\1":
        return [], "markers: unknown version at 0"
    coded = data[2:].split(b"\0", 1)[0].replace(b"\n", b"").replace(b"\r", b"")
    try:
        payload = base64.b64decode(coded + b"=" * (-len(coded) % 4))
    except binascii.Error:
        return [], "markers: no base64 at 2"
    if payload[:2] != b"\1\1":
        return [], "markers: unknown version of entries at 0"
    out, at = [], 2
    while at < len(payload):
        end = payload.find(b"\0", at)
        if end in (-1, at):
            return out, None if end == at else f"markers: entry without a name at {at}"
        name, body = payload[at:end].decode("ascii", "replace"), payload[end + 5 :]
        size = int.from_bytes(payload[end + 1 : end + 5], "big")
        if len(payload) < end + 5 or len(body) < size:
            return out, f"markers: {name} is cut at {at}"
        body, at = body[:size], end + 5 + size
        if name == "CUE" and size >= 12:
            out.append({"kind": "cue", "index": body[1], "millis": int.from_bytes(body[2:6], "big"), "color": body[7:10].hex(), "name": body[12:].split(b"\0", 1)[0].decode("utf-8", "replace")})
        elif name == "COLOR" and size >= 4:
            out.append({"kind": "color", "color": body[1:4].hex()})
        elif name == "BPMLOCK" and size:
            out.append({"kind": "locked" if body[0] else "free"})
    return out, None


def tag_fields(data: bytes | None) -> dict:
    """texts, described, comments, entries of a tag, and its first error with its place; a file without a tag has none of them."""
    out: dict = {"texts": {}, "described": {}, "comments": {}, "entries": [], "error": None}
    if data is None or data[:3] != b"ID3":
        return out
    if len(data) < 10:
        return out | {"error": "header is cut at 0"}
    size = 0
    for b in data[6:10]:
        size = size << 7 | (b & 0x7F)
    body, at, error = data[10 : 10 + size], 0, None
    if len(body) < size:
        error = f"tag is cut at {len(data)}"
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
        name, n = body[at : at + 4].decode("latin-1"), int.from_bytes(body[at + 4 : at + 8], "big")
        own = body[at + 10 : at + 10 + n]
        if len(own) < n or not own:
            error = error or f"{name} is {'cut' if len(own) < n else 'empty'} at {10 + at}"
        if own:
            encoding = own[0]
            if name in ("TXXX", "COMM"):
                head, rest = _cut(encoding, own[1 if name == "TXXX" else 4 :])
                out["described" if name == "TXXX" else "comments"][_text(encoding, head)] = _text(encoding, rest)
            elif name == "GEOB":
                _, rest = _cut(0, own[1:])
                _, rest = _cut(encoding, rest)
                head, rest = _cut(encoding, rest)
                if _text(encoding, head) == MARKERS:
                    out["entries"], wrong = marker_entries(rest)
                    error = error or (wrong and f"GEOB at {10 + at}: {wrong}")
            elif name.startswith("T"):
                out["texts"][name] = _text(encoding, own[1:])
        at += 10 + n
    return out | {"error": error}


FIELDS = "texts map<string,string>, described map<string,string>, comments map<string,string>, entries array<struct<kind: string, index: int, millis: long, color: string, name: string>>, error string"


def with_fields(rows: DataFrame, column: str) -> DataFrame:
    """rows with the column `tag`: what tag_fields() reads from a binary column. Nulls and files without a tag have empty fields."""
    ship(rows.sparkSession)
    kind = T.StructType.fromDDL(FIELDS)

    @F.arrow_udf(kind)
    def read(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in data:
            found = [tag_fields(x.as_py()) for x in batch]
            yield pa.array([{k: list(v.items()) if isinstance(v, dict) else v for k, v in f.items()} for f in found], to_arrow_type(kind))

    return rows.withColumn("tag", read(F.col(column)))
