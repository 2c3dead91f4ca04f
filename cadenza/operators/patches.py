"""A reply's partial instructions over a plan's slots: each field of each instruction is taken or refused on its own, with a reason, and later ones stand over earlier ones.

Whether a field is taken depends on the plan alone, so what a slot becomes is the last one taken of each field: an aggregate, with no reply read in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of drums, and how much of a label and a note is kept.
PATTERNS = ("drop", "drop_var", "intro", "intro_full", "build", "breakdown", "outro")
LABEL, NOTE = 32, 200
# End of fixed values.

FIELDS = ("drum_pattern", "source_gain", "source_start", "source_label")


def reply_object(text: Column) -> Column:
    """The JSON object of a reply, from its first brace to its last, as a variant; null if there is none."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def _got(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: str) -> Column:
    """The text of the variant column of that name, whose schema is in __<v>; null for anything else."""
    return F.when(F.col(f"__{v}") == "STRING", _got(F.col(v), "$", "string"))


def _number(v: str) -> Column:
    """A number, or a boolean as 0 or 1; null for anything else."""
    kind = F.col(f"__{v}")
    return F.when(kind == "BOOLEAN", _got(F.col(v), "$", "boolean").cast("double")).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), _got(F.col(v), "$", "double"))


def _index(number: Column, text: Column) -> Column:
    """A number without its fraction, a boolean, or a text of a whole number."""
    return F.coalesce(F.when(F.abs(number) < 9e18, number.cast("long")), F.when(text.isNotNull(), F.regexp_extract(text, r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("long")))


def _typed(items: DataFrame, key: str) -> DataFrame:
    """key, k, slot, and of each field whether it is there (has_), its text or its number: each part of an item is read once, in a step of its own."""
    names = ("index", *FIELDS)
    rows = items.select(key, "k", *(_got(F.col("item"), f"$.{n}", "variant").alias(n) for n in names))
    rows = rows.select("*", *(F.schema_of_variant(n).alias(f"__{n}") for n in names))
    kinds = {"drum_pattern": _text, "source_gain": _number, "source_start": _number, "source_label": _text}
    rows = rows.select(key, "k", _number("index").alias("__number"), _text("index").alias("__text"), *(F.col(n).isNotNull().alias(f"has_{n}") for n in FIELDS), *(kinds[n](n).alias(n) for n in FIELDS))
    return rows.withColumn("slot", _index(F.col("__number"), F.col("__text"))).drop("__number", "__text")


def instructions(replies: DataFrame, slots: DataFrame, plans: DataFrame, key: str, text: str = "reply") -> DataFrame:
    """key, k (the instruction's place), slot, field, value, number, taken and reason of each field of each instruction.

    replies: key, text. slots: key, slot (a whole number). plans: key, duration, bar (seconds) and grain (bars of the source's lines); one row each. An instruction without a known slot is one
    row without a field; so is one that has none of the fields, which counts as taken. Replies that can't be read, and those of unknown plans, give no rows.
    """
    read = replies.select(key, reply_object(F.col(text)).alias("o"))
    items = read.select(key, F.posexplode(_got(F.col("o"), "$.slots", "array<variant>")).alias("k", "item"))
    line = F.greatest(F.lit(1), F.col("grain").cast("int")) * F.col("bar")
    asked = _typed(items, key).join(plans.select(key, "duration", "bar", "grain"), key)
    asked = asked.withColumn("line", line).withColumn("moved", F.when(F.col("line") > 0, F.rint(F.col("source_start") / F.col("line")) * F.col("line")).otherwise(0.0))

    pattern, gain, start, label, moved = (F.col(c) for c in (*FIELDS, "moved"))
    within = lambda x: (x >= 0) & (x < F.col("duration"))
    # of each field what it becomes, and what speaks against it
    values = dict(zip(FIELDS, (pattern, gain, moved, F.substring(label, 1, LABEL)), strict=True))
    against = {
        "drum_pattern": ((pattern.isNull(), "no text"), (~pattern.isin(*PATTERNS), "no such pattern")),
        "source_gain": ((gain.isNull(), "no number"), (~gain.between(0.0, 1.0), "not from 0 to 1")),
        "source_start": ((start.isNull(), "no number"), (~within(start), "outside of the source"), (~within(moved), "no line of the source there")),
        "source_label": ((label.isNull(), "no text"), (label == "", "empty")),
    }

    def refusal(field: str) -> Column:
        """Which reason is the first against a field; null where it is taken, or not there."""
        number = F.lit(None).cast("int")
        for i, (when, _) in reversed([*enumerate(against[field], 1)]):
            number = F.when(F.coalesce(when, F.lit(True)), i).otherwise(number)
        return F.when(F.col(f"has_{field}"), number)

    def said(field: str) -> Column:
        reason = F.lit(None).cast("string")
        for i, (_, what) in enumerate(against[field], 1):
            reason = F.when(F.col(f"no_{field}") == i, what).otherwise(reason)
        value, number = (F.col(field), F.lit(None)) if field in ("drum_pattern", "source_label") else (F.lit(None), F.col(field))
        parts = (F.lit(field).alias("field"), value.cast("string").alias("value"), number.cast("double").alias("number"), reason.alias("reason"))
        return F.when(F.col(field).isNotNull() | F.col(f"no_{field}").isNotNull(), F.struct(*parts))

    # fields are taken or refused before slots are looked up: what they were read from, what is refused and what the plan says of itself aren't shuffled
    asked = asked.select("*", *(refusal(f).alias(f"no_{f}") for f in FIELDS))
    kept = (F.when(F.col(f"has_{f}") & F.col(f"no_{f}").isNull(), values[f]).alias(f) for f in FIELDS)
    asked = asked.select(key, "k", "slot", *kept, *(f"no_{f}" for f in FIELDS))
    # slot gets the type that it has in asked, so that the rows of distinct() lie as the join needs them
    there = slots.select(key, F.col("slot").cast("long").alias("slot")).distinct().withColumn("known", F.lit(True))
    known = asked.join(there, [key, "slot"], "left")
    fields = F.filter(F.array(*map(said, FIELDS)), lambda f: f.isNotNull())
    rows = known.withColumn("fields", F.when(F.col("known"), fields).otherwise(F.array().cast("array<struct<field: string, value: string, number: double, reason: string>>")))
    rows = rows.select(key, "k", "slot", "known", F.explode_outer("fields").alias("f"))
    reason = F.when(F.col("slot").isNull(), "no slot").when(F.col("known").isNull(), "no such slot").otherwise(F.col("f.reason"))
    taken = reason.isNull()
    return rows.select(key, "k", "slot", "f.field", F.when(taken, F.col("f.value")).alias("value"), F.when(taken, F.col("f.number")).alias("number"), taken.alias("taken"), reason.alias("reason"))


def patched(slots: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """slots (key, slot, drum_pattern, source_gain, source_start, source_label, ...) after instructions(), with how many of its fields were taken and refused."""
    last = lambda field, c: F.max_by(F.when((F.col("field") == field) & F.col("taken"), F.col(c)), F.when((F.col("field") == field) & F.col("taken"), F.col("k")))
    columns = dict(zip(FIELDS, ("value", "number", "number", "value"), strict=True))
    own = found.where("field is not null").groupBy(key, "slot").agg(*(last(f, c).alias(f"__{f}") for f, c in columns.items()), F.count_if("taken").alias("taken"), (F.count("taken") - F.count_if("taken")).alias("refused"))
    rows = slots.join(own, [key, "slot"], "left")
    changed = {f: F.coalesce(f"__{f}", f).alias(f) for f in FIELDS}
    return rows.select(*(changed.get(c, F.col(c)) for c in slots.columns), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("refused", F.lit(0)).alias("refused"))


def notes(replies: DataFrame, found: DataFrame, key: str, text: str = "reply") -> DataFrame:
    """key, note and usable: the reply's note, empty where no instruction had a known slot."""
    usable = found.where("reason is null or field is not null").select(key).distinct().withColumn("usable", F.lit(True))
    rows = replies.join(usable, key, "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    note = _got(reply_object(F.col(text)), "$.note", "string")
    return rows.select(key, F.when(F.col("usable"), F.substring(F.coalesce(note, F.lit("")), 1, NOTE)).otherwise("").alias("note"), "usable")
