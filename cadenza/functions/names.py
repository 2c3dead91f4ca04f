"""Names of files, ids and formats as Column expressions. A name that may not be used is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are taken, names that mean something else, export formats and those that are written unasked, letters of hot cues.
UPLOADS = (".mp3", ".m4a", ".wav", ".flac", ".aiff", ".aif")
RESERVED = ("default", "none", "newest", "auto")
FORMATS = ("rekordbox", "serato", "csv", "tags")
DEFAULT_FORMATS = ("rekordbox", "csv")
HOT_CUE_LETTERS = "ABCDEFGH"
# End of fixed values.


def _base(path: Column) -> Column:
    """The last part of a path."""
    return F.coalesce(F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "/"), -1), F.lit(""))


def file_title(text: Column, default: str = "track", most: int = 80) -> Column:
    """A title as a safe and short file name."""
    cut = lambda c: F.regexp_replace(c, r"^[ .\-_]+|[ .\-_]+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w \-.,'()&+]", " "), r"\s+", " ")
    name = cut(F.substring(cut(plain), 1, most))
    return F.when(name == "", default).otherwise(name)


def shown(path: Column, most: int = 120) -> Column:
    """A file's name as text to show."""
    name = F.substring(F.trim(F.regexp_replace(F.replace(_base(path), F.lit("\x00"), F.lit("")), r"[\r\n\t]", " ")), 1, most)
    return F.when(F.trim(F.regexp_replace(F.replace(_base(path), F.lit("\x00"), F.lit("")), r"[\r\n\t]", " ")) == "", "untitled").otherwise(name)


def row_title(path: Column, most: int = 80) -> Column:
    """A file's name as the title of a row: without its extension, marks as spaces."""
    name = shown(path)
    stem = F.when(name.rlike(r"^.+\.[^.]*[^.]$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    title = F.substring(F.trim(F.translate(stem, "_-", "  ")), 1, most)
    return F.when(title == "", "Untitled").otherwise(title)


def own_id(text: Column) -> Column:
    """One of the ids given here, 16 digits of base 16; else null."""
    return F.when(text.rlike(r"\A[0-9a-f]{16}\z"), text)


def upload_extension(path: Column) -> Column:
    """The extension of a file that may be uploaded; else null."""
    found = F.lower(F.regexp_extract(_base(path), r"^.+(\.[^.]+)$", 1))
    return F.when(found.isin(*UPLOADS), found)


def kit_name(text: Column) -> Column:
    """The canonical name of a kit; null for what is none or means something else."""
    name = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(name.rlike(r"\A[a-z0-9][a-z0-9_-]{0,63}\z") & ~name.isin(*RESERVED), name)


def formats(wanted: Column) -> Column:
    """A list of formats, each of which may be a list between commas, in the order asked for and without repeats; `all` stands for all. Nothing asked for: the default ones. Null if one is unknown."""
    some = lambda names: F.array(*map(F.lit, names))
    parts = F.filter(F.flatten(F.transform(wanted, lambda w: F.transform(F.split(w, ","), lambda p: F.lower(F.trim(p))))), lambda p: p != "")
    every = F.flatten(F.transform(parts, lambda p: F.when(p == "all", some(FORMATS)).otherwise(F.array(p))))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, some(DEFAULT_FORMATS)).when(F.forall(every, lambda f: f.isin(*FORMATS)), F.array_distinct(every))


def taken_stem(path: Column) -> Column:
    """The name that a file of a pair takes: without its extension, and without .remix or .original."""
    stem = F.regexp_replace(_base(path), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"\.(?:remix|original)$", "")
