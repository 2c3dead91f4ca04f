"""Arrangements as tables: forms of sections in whole phrases, scaled to a length, laid out on bars, fed from a song's sections, and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.records import once

# The forms (kind, bars), and the kinds that may be scaled.
FORMS = {
    "club": (("intro", 16), ("build", 8), ("drop", 32), ("breakdown", 16), ("build", 8), ("drop", 32), ("outro", 16)),
    "radio": (("intro", 8), ("build", 8), ("drop", 24), ("breakdown", 8), ("build", 8), ("drop", 24), ("outro", 8)),
    "tool": (("intro", 32), ("build", 8), ("drop", 32), ("breakdown", 16), ("build", 8), ("drop", 32), ("outro", 32)),
}
SCALABLE = ("intro", "drop", "breakdown", "outro")
PHRASE = 8
# End of fixed values.

_FORM = "array<struct<kind:string,bars:int>>"


def form(name: Column) -> Column:
    """The form of a name; club for an unknown one."""
    some = lambda f: F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("bars")) for k, n in f)).cast(_FORM)
    out = some(FORMS["club"])
    for k, f in FORMS.items():
        out = F.when(name == k, some(f)).otherwise(out)
    return out


def _total(parts: Column, scalable: bool | None = None) -> Column:
    own = parts if scalable is None else F.filter(parts, lambda x: x["kind"].isin(*SCALABLE) if scalable else ~x["kind"].isin(*SCALABLE))
    return F.aggregate(own, F.lit(0), lambda s, x: s + x["bars"])


def shortest(parts: Column) -> Column:
    """The fewest bars that a form can have: fixed parts as they are, the others one phrase each."""
    return _total(parts, False) + PHRASE * F.size(F.filter(parts, lambda x: x["kind"].isin(*SCALABLE)))


def scaled(parts: Column, bars: Column) -> Column:
    """A form scaled to so many bars: fixed parts stay, the others are whole phrases, one at least. What rounding leaves is put on or taken off the longest of them, phrase by phrase; a length that can't be reached is left."""
    free = lambda x: x["kind"].isin(*SCALABLE)
    known = F.struct(parts.alias("parts"), bars.cast("int").alias("bars"), _total(parts, False).alias("fixed"), _total(parts, True).alias("flexible"), F.size(F.filter(parts, free)).alias("n"))

    def fitted(k: Column) -> Column:
        room = F.greatest(k["bars"] - k["fixed"], PHRASE * k["n"])
        return once(room / F.greatest(k["flexible"], F.lit(1)), lambda factor: F.transform(k["parts"], lambda x: F.when(free(x), F.greatest(F.lit(PHRASE), (F.bround(x["bars"] * factor / PHRASE) * PHRASE).cast("int"))).otherwise(0)))

    def step(s: Column, _: Column) -> Column:
        by = lambda most: F.when(s["gap"] > 0, PHRASE).when((s["gap"] < 0) & (most > PHRASE), -PHRASE).otherwise(0)
        move = once(F.array_max(s["own"]), lambda most: F.struct((F.array_position(s["own"], most).cast("int") - 1).alias("at"), by(most).alias("by")))
        return once(move, lambda m: F.struct(F.transform(s["own"], lambda x, i: x + F.when(i == m["at"], m["by"]).otherwise(0)).alias("own"), (s["gap"] - m["by"]).alias("gap")))

    def levelled(k: Column, own: Column) -> Column:
        """own after as many steps as there are phrases too few or too many, and one more if that is odd: later steps would come in pairs that undo each other."""
        total = F.aggregate(own, F.lit(0), lambda s, x: s + x)
        state = F.struct(own.alias("own"), (k["bars"] - k["fixed"] - total).alias("gap"), (total - PHRASE * k["n"]).alias("most"))
        steps = lambda s: F.when(k["n"] > 0, 2 * F.ceil(F.when(s["gap"] > 0, s["gap"]).otherwise(F.least(-s["gap"], s["most"])) / (2 * PHRASE)).cast("int")).otherwise(0)
        return once(state, lambda s: F.aggregate(F.array_repeat(F.lit(0), steps(s)), F.struct(s["own"].alias("own"), s["gap"].alias("gap")), step, lambda t: t["own"]))

    def form_(k: Column) -> Column:
        return F.zip_with(k["parts"], once(fitted(k), lambda own: levelled(k, own)), lambda x, n: F.struct(x["kind"].alias("kind"), F.when(free(x), n).otherwise(x["bars"]).cast("int").alias("bars"))).cast(_FORM)

    return once(known, form_)


def for_length(parts: Column, seconds: Column, bar_seconds: Column) -> Column:
    """The form scaled to the whole phrases nearest to a length, but not below its shortest; the form itself where no length is asked for."""
    bars = F.greatest(shortest(parts), (F.bround(seconds / bar_seconds / PHRASE) * PHRASE).cast("int"))
    return F.when(F.coalesce(seconds, F.lit(0.0)) > 0, scaled(parts, bars)).otherwise(parts)


def grain(beat_multiple: Column) -> Column:
    """The target bars of a source bar: more than one for a source in half time."""
    return F.when(beat_multiple >= 1.5, F.greatest(F.lit(1), F.bround(beat_multiple).cast("int"))).otherwise(1)


def samples(bars: Column, bar_seconds: Column, rate: Column) -> Column:
    return F.bround(bars * bar_seconds * rate).cast("long")


def phrases(bars: Column) -> Column:
    return F.ceil(bars / float(PHRASE)).cast("int")


def laid_out(plans: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each slot: the columns of plans but parts, slot (from 0), kind, bars, start_bar, nth (of its kind, from 0)."""
    rows = plans.select(*(c for c in plans.columns if c != parts), F.posexplode(parts).alias("slot", "__x"), F.col(parts).alias("__all"))
    before = F.aggregate(F.slice("__all", F.lit(1), F.col("slot")), F.lit(0), lambda s, x: s + x["bars"])
    nth = F.size(F.filter(F.slice("__all", F.lit(1), F.col("slot")), lambda x: x["kind"] == F.col("__x.kind")))
    return rows.select(*(c for c in plans.columns if c != parts), "slot", F.col("__x.kind").alias("kind"), F.col("__x.bars").alias("bars"), before.alias("start_bar"), nth.alias("nth"))


def picked(sections: DataFrame, key: str, order: str) -> DataFrame:
    """For each track and want (drop, breakdown, intro) the section that feeds it. sections: key, order, start, end, label, energy.

    Drops take the hook with the most energy over its first 40 seconds, or any section if there is no hook; breakdowns the quietest verse, breakdown or
    intro, or any; intros the quietest of all. The first of equals counts.
    """
    length = F.least(F.col("end") - F.col("start"), F.lit(40.0))
    wants = {
        "drop": (F.col("label") != "hook", -F.col("energy") * length),
        "breakdown": (~F.col("label").isin("verse", "breakdown", "intro"), F.col("energy")),
        "intro": (F.lit(False), F.col("energy")),
    }
    # all wants are chosen over one row of each section; there is a row for each only where the choice is made
    first = lambda other, cost: F.min(F.struct(other.alias("other"), cost.cast("double").alias("cost"), order, "start", "end", "label", "energy"))
    best = sections.groupBy(key).agg(*(first(*w).alias(f"__{want}") for want, w in wants.items()))
    each = best.select(key, F.explode(F.array(*(F.struct(F.lit(want).alias("want"), F.col(f"__{want}").alias("m")) for want in wants))).alias("w"))
    return each.select(key, "w.want", *(F.col(f"w.m.{c}").alias(c) for c in (order, "start", "end", "label", "energy")))


def hook(sections: DataFrame, key: str, order: str) -> DataFrame:
    """The section of each track that drops are built from: the longest hook, or else the one with the most energy times duration."""
    length = F.col("end") - F.col("start")
    cost = F.when(F.col("label") == "hook", -length).otherwise(-F.col("energy") * length)
    best = sections.groupBy(key).agg(F.min(F.struct((F.col("label") != "hook").alias("other"), cost.alias("cost"), order, "start", "end", "label")).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in (order, "start", "end", "label")))


def labelled(sections: DataFrame, key: str, order: str, group: str, energy: str) -> DataFrame:
    """sections with label: the group with the most mean energy, more if it comes back, is the hook, the next one the verse; others are breakdowns where they are quiet. A quiet first or last section that isn't the hook is intro or outro."""
    line = Window.partitionBy(key).orderBy(order)
    sums = sections.groupBy(key, group).agg(F.round(F.avg(energy) * (1 + 0.35 * (F.count("*") - 1)), 9).alias("__score"), F.min(order).alias("__first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__score"), "__first"))
    rows = sections.join(sums.withColumn("__place", place).select(key, group, "__place"), [key, group])
    quiet = F.col(energy) < 0.7
    first, last = F.row_number().over(line) == 1, F.lead(order).over(line).isNull()
    only = first & last
    plain = F.when(F.col("__place") == 1, "hook").when(F.col("__place") == 2, "verse").when(F.col(energy) < 0.45, "breakdown").otherwise("section")
    label = F.when(plain == "hook", "hook").when(last & quiet & ~only, "outro").when(first & quiet, "intro").otherwise(plain)
    return rows.withColumn("label", label).select(*sections.columns, "label")


def problems(slots: DataFrame, key: str, total: str, bar: str, source_grain: str) -> DataFrame:
    """key and the list of what is wrong with a plan's slots (slot, kind, start_bar, bars, source_start, source_bars; total bars, seconds of a bar and grain for each row)."""
    line = Window.partitionBy(key).orderBy("slot")
    expected = F.coalesce(F.sum("bars").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = F.col("source_start") / (F.col(bar) * F.greatest(F.lit(1), F.col(source_grain)))
    rows = slots.select(key, "slot", total, "bars", (F.col("start_bar") != expected).alias("moved"), (F.col("bars") <= 0).alias("empty"), (F.abs(lines - F.round(lines)) > 1e-4).alias("off"), (F.col("source_bars") <= 0).alias("unfed"))
    said = lambda c, what: F.when(F.col(c), F.concat(F.lit(f"{what} "), F.col("slot").cast("string")))
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.filter(F.array(said("moved", "start"), said("empty", "bars"), said("off", "line"), said("unfed", "source")), lambda x: x.isNotNull()).alias("said")))), lambda x: x["said"]))
    out = rows.groupBy(key).agg(every.alias("own"), F.sum("bars").alias("sum"), F.first(total).alias("total"))
    whole = F.filter(F.array(F.when(F.col("sum") != F.col("total"), "sum"), F.when(F.col("total") % PHRASE != 0, "phrase")), lambda x: x.isNotNull())
    return out.select(key, F.concat("own", whole).alias("problems"))
