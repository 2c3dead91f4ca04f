"""Musical keys on the mixing wheel. A key is its pitch class (0 to 11 from C) and whether it is minor; a code is like 8B or 5A."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wheel numbers of pitch classes C to B, and the largest shift in semitones that is made unasked.
MAJOR = (8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1)
MINOR = (5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10)
LARGEST_SHIFT = 3


def _literal(values) -> Column:
    return F.array(*map(F.lit, values))


def code_of(pitch_class: Column, minor: Column) -> Column:
    at = pitch_class.cast("int") + 1
    return F.concat(F.when(minor, F.element_at(_literal(MINOR), at)).otherwise(F.element_at(_literal(MAJOR), at)).cast("string"), F.when(minor, "A").otherwise("B"))


def key_of(code: Column) -> Column:
    """struct(pitch_class, minor), or null for what is no code."""
    text = F.upper(F.trim(code))
    n = F.regexp_extract(text, "^([0-9]{1,2})[AB]$", 1).try_cast("int")
    minor = text.endswith("A")
    places = [_literal([row.index(k) for k in range(1, 13)]) for row in (MINOR, MAJOR)]
    at = F.greatest(F.least(n, F.lit(12)), F.lit(1))
    return F.when(n.between(1, 12), F.struct(F.when(minor, F.element_at(places[0], at)).otherwise(F.element_at(places[1], at)).alias("pitch_class"), minor.alias("minor")))


def neighbours(code: Column) -> Column:
    """The code itself, one step either way, and the other mode."""
    text = F.upper(F.trim(code))
    n, letter = F.regexp_extract(text, "^([0-9]{1,2})", 1).try_cast("int"), F.right(text, F.lit(1))
    other = F.when(letter == "A", "B").otherwise("A")
    return F.array(text, F.concat((n % 12 + 1).cast("string"), letter), F.concat((F.pmod(n - 2, F.lit(12)) + 1).cast("string"), letter), F.concat(n.cast("string"), other))


def semitone_shift(source: Column, target: Column) -> Column:
    """The smallest signed shift between two pitch classes; six goes up."""
    up = F.pmod(target - source, F.lit(12))
    return F.when(up > 6, up - 12).otherwise(up)


def shifted(code: Column, semitones: Column) -> Column:
    key = key_of(code)
    return code_of(F.pmod(key["pitch_class"] + semitones, F.lit(12)), key["minor"])


def shifts(largest: int = LARGEST_SHIFT) -> list[int]:
    """From the smallest to the largest, down before up."""
    return sorted(range(-largest, largest + 1), key=abs)


def nearest_compatible(code: Column, other: Column, largest: int = LARGEST_SHIFT) -> Column:
    """The first shift that takes a code into the other's neighbourhood, or null."""
    wanted = neighbours(other)
    return F.coalesce(*(F.when(F.array_contains(wanted, shifted(code, F.lit(s))), F.lit(s)) for s in shifts(largest)))


def triad(chroma: Column) -> Column:
    """struct(root, minor, margin) of the triad that holds most of 12 pitch classes: major before minor and low before high where they tie. margin: its lead over the next, as a share; null for silence."""
    shares = [(root, minor, sum((F.element_at(chroma, (root + step) % 12 + 1) for step in (0, 3 if minor else 4, 7)), F.lit(0.0)) / 3) for minor in (False, True) for root in range(12)]
    total = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x)
    order = F.sort_array(F.array(*(F.struct(F.round(v / total, 9).alias("s"), F.lit(-k).alias("first"), F.lit(root).alias("root"), F.lit(minor).alias("minor")) for k, (root, minor, v) in enumerate(shares))), asc=False)
    lead = lambda o: F.struct(o[0]["root"].alias("root"), o[0]["minor"].alias("minor"), ((o[0]["s"] - o[1]["s"]) / F.greatest(o[0]["s"], F.lit(1e-9))).alias("margin"))
    return F.when(total > 0, F.get(F.transform(F.array(order), lead), F.lit(0)))
