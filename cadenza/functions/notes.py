"""Listening notes and a critic's replies as Column expressions: categories, authors, times, markers, issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import records as R

# The categories of a listener's notes with their labels, the critic's categories, and the authors that have a name.
CATEGORIES = {
    "off-beat": "Off-beat",
    "vocal-buried": "Vocal buried",
    "drums-fake": "Drums fake",
    "clash": "Clash / wrong notes",
    "transition": "Rough transition",
    "too-loud": "Too loud",
    "too-quiet": "Too quiet",
    "boring": "Boring / repetitive",
    "good": "Good",
}
CRITIC_CATEGORIES = ("off_beat", "vocal_buried", "drums_fake", "wrong_notes", "rough_transition", "too_loud", "too_quiet", "repetitive", "artifact", "good")
AUTHORS = {"neel": "Neel", "gemini": "Gemini"}
DEFAULT_AUTHOR = "neel"
# End of fixed values.

#: What a marker may hold; each tool writes some of it, numbers as numbers or as text.
MARKER = "struct<author:string,category:string,note:string,time:string,bar:string,at:string,ts:string,slot:string,slot_bars:string>"
#: What a critic's reply may hold; its issues are read one by one, so that one that is none loses no other.
REPLY = "struct<overall_score:string,verdict:string,issues:string,sections:map<string,string>,vs_reference:struct<reference_does_better:string,biggest_gap:string>>"

ISSUE = "struct<time_sec:string,category:string,severity:string,note:string>"


def _number(text: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _lookup(code: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for k, label in table.items():
        out = F.when(code == k, label).otherwise(out)
    return out


def category(text: Column) -> Column:
    """A category of notes, in small letters; null for what is none."""
    code = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(code.isin(*CATEGORIES), code)


def category_label(code: Column) -> Column:
    words = F.trim(F.regexp_replace(F.coalesce(code, F.lit("unknown")), "[-_]+", " "))
    return _lookup(code, CATEGORIES, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)))


def author_label(slug: Column) -> Column:
    name = F.when(F.coalesce(slug, F.lit("")) == "", DEFAULT_AUTHOR).otherwise(slug)
    return _lookup(slug, AUTHORS, F.initcap(F.replace(name, F.lit("-"), F.lit(" "))))


def stamped(at: Column, ts: Column) -> Column:
    """Seconds since 1970: a positive number, else a time in UTC as text, else 0."""
    number = _number(at)
    return F.when(number > 0, number).otherwise(F.coalesce(F.when(ts.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"), F.unix_micros(F.try_to_timestamp(F.replace(ts, F.lit("Z"), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))) / 1e6), F.lit(0.0)))


def marker(m: Column) -> Column:
    """A marker (see MARKER) as it is read: every field is there and of one type, whoever wrote it."""
    code = F.lower(F.trim(F.coalesce(m["category"], F.lit(""))))
    return F.struct(
        R.author(m["author"], DEFAULT_AUTHOR).alias("author"), F.when(code == "", "unknown").otherwise(code).alias("category"), R.tidy(m["note"]).alias("note"),
        F.coalesce(F.bround(_number(m["time"]), 3), F.lit(0.0)).alias("time"), F.greatest(F.lit(0), F.coalesce(F.trim(m["bar"]).try_cast("int"), F.lit(0))).alias("bar"),
        stamped(m["at"], m["ts"]).alias("at"), F.coalesce(m["slot"], F.lit("")).alias("slot"), F.coalesce(m["slot_bars"], F.lit("")).alias("slot_bars"),
    )


def markers(document: Column) -> Column:
    """The markers of a feedback document (JSON); empty for what can't be read."""
    return F.coalesce(F.transform(F.from_json(document, f"struct<markers:array<{MARKER}>>")["markers"], marker), F.array().cast("array<struct<author:string,category:string,note:string,time:double,bar:int,at:double,slot:string,slot_bars:string>>"))


def bar_seconds(beat_seconds: Column, beats_per_bar: Column, bpm: Column) -> Column:
    """How long a bar is by a session's own numbers; 0 where they don't say."""
    beats = F.when(F.coalesce(beats_per_bar, F.lit(0.0)) != 0, beats_per_bar).otherwise(4.0)
    return F.when(beat_seconds > 0, beat_seconds * beats).when(bpm > 0, 60.0 / bpm * beats).otherwise(0.0)


def slot_label(kind: Column, start_bar: Column, bars: Column) -> Column:
    """Empty where there is no slot."""
    return F.when(start_bar.isNull(), "").otherwise(F.concat(F.coalesce(kind, F.lit("slot")), F.lit(" bars "), (start_bar + 1).cast("string"), F.lit("-"), (start_bar + bars).cast("string")))


def issue(x: Column, duration: Column | None = None) -> Column:
    """An issue of a critic as it counts: a known category, a time in the record, a severity from 1 to 3."""
    code = F.replace(F.lower(F.trim(F.coalesce(x["category"], F.lit("")))), F.lit(" "), F.lit("_"))
    t = F.greatest(F.lit(0.0), F.coalesce(_number(x["time_sec"]), F.lit(0.0)))
    if duration is not None:
        t = F.when(duration > 0, F.least(t, duration)).otherwise(t)
    severity = F.coalesce(F.bround(_number(x["severity"])).try_cast("int"), F.lit(2))
    return F.struct(F.bround(t, 2).alias("time_sec"), F.when(code.isin(*CRITIC_CATEGORIES), code).otherwise("artifact").alias("category"), F.least(F.lit(3), F.greatest(F.lit(1), severity)).alias("severity"), F.trim(F.coalesce(x["note"], F.lit(""))).alias("note"))


def critique(reply: Column, duration: Column | None = None) -> Column:
    """struct(overall_score, verdict, issues, sections, better, gap) of a critic's reply, with fences and prose around its JSON; null if there is none."""
    none = F.array().cast("array<struct<time_sec:double,category:string,severity:int,note:string>>")

    def read(data: Column) -> Column:
        said = F.trim(F.coalesce(data["verdict"], F.lit("")))
        better = data["vs_reference"]["reference_does_better"]
        points = F.coalesce(F.from_json(better, "array<string>"), F.when(F.coalesce(better, F.lit("")) != "", F.array(better)).otherwise(F.array().cast("array<string>")))
        own = F.filter(F.from_json(data["issues"], "array<string>"), lambda x: x.startswith("{"))
        return F.when(data.isNotNull(), F.struct(
            R.score_100(data["overall_score"]).alias("overall_score"), F.when(said == "", "(no verdict returned)").otherwise(said).alias("verdict"),
            F.coalesce(F.transform(own, lambda x: R.once(F.from_json(x, ISSUE), lambda i: issue(i, duration))), none).alias("issues"),
            F.coalesce(data["sections"], F.create_map().cast("map<string,string>")).alias("sections"), F.when(data["vs_reference"].isNotNull(), points).alias("better"), F.trim(data["vs_reference"]["biggest_gap"]).alias("gap"),
        ))

    # each JSON is parsed once: without that every field of the struct would parse it again
    return R.once(F.from_json(R.reply_object(reply), REPLY), read)
