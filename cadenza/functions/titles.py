"""Titles as Column expressions: normal form, noise, tokens, similarity, credits."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as noise in a title, which words make a bracketed group a credit, and which only qualify one.
NOISE = (
    r"\bwww\.\S+", r"https?://\S+",
    r"buy\s*=\s*free\s*(download|dl)", r"free\s*(download|dl)\b",
    r"\bfree\b(?=\s*[\]\)\|]|$)", r"\bklickaud\b", r"\bklick\s*aud\b",
    r"download\s+in\s+(the\s+)?(description|bio|link)", r"\bout\s+now\b",
    r"\bofficial\s+(music\s+)?video\b", r"\bofficial\s+audio\b",
    r"\bofficial\s+visuali[sz]er\b", r"\bofficial\s+lyric\s+video\b",
    r"\blyrics?\s+video\b", r"\bvisuali[sz]er\b", r"\baudio\s+only\b",
    r"\bfull\s+(song|version|album)\b", r"\bhq\b", r"\bhd\b", r"\b4k\b",
    r"\bncs\s+release\b", r"\bno\s+copyright\b", r"\bcopyright\s+free\b",
    r"\bre-?upload\b", r"\bpitched\b", r"\bfree\s+to\s+use\b",
    r"\bsupport\s+the\s+artist\b", r"\bplease\s+support\b",
    r"\bsubscribe\b", r"\bnew\s+song\b", r"\btiktok\s+(song|version)\b",
    r"#\w+", r"\bprod\.?\s*by\s+[\w .'&-]+",
)
KEYWORDS = ("remix", "rmx", "edit", "bootleg", "flip", "rework", "refix", "remake", "mashup", "mash-up", "bounce", "dub", "vip", "remaster", "cover", "mix")
QUALIFIERS = (
    "extended", "radio", "club", "festival", "private", "official", "original", "vip", "dub", "instrumental", "acapella", "acappella", "house", "afro",
    "tech", "techno", "trance", "dnb", "drum", "bass", "jersey", "drill", "hard", "hardstyle", "bounce", "uk", "garage", "amapiano", "baile",
    "slowed", "sped", "up", "reverb", "nightcore", "version", "master", "mastered", "cut", "full", "long", "short", "intro", "outro", "clean",
    "dirty", "free", "dl", "download", "bootleg", "edit", "remix", "mix", "rmx", "flip", "rework", "refix", "remake", "mashup", "remaster", "cover",
    "2023", "2024", "2025", "2026",
)
AUTHORED = ("remix", "rmx", "edit", "bootleg", "flip", "rework", "refix", "remake", "mashup", "mash-up", "bounce", "vip")
PREFIXES = ("premiere", "premier", "exclusive", "free download", "free dl", "out now", "new", "video premiere", "first play", "klickaud", "fd", "free")
EXTENSIONS = "mp3|m4a|wav|flac|aiff?|ogg|opus|webm|mp4"
# End of fixed values.

_EDGES = r"^[ \-|·•,]+|[ \-|·•,]+$"
_DASH = r"\s+[-~]+\s+"
_GROUP = r"[(\[{][^()\[\]{}]*[)\]}]"
_KEYWORD = rf"(?i)\b({'|'.join(KEYWORDS)})\b"
_FEATURING = r"(?i)\b(?:feat\.?|ft\.?|featuring)\s+(.+)$"


def _plain_letters() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and combining marks, up to the end of the basic plane, and that letter."""
    pairs = {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]):
        own = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if own != c and len(own) == 1:
            pairs[c] = own
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain_letters()


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def without_accents(text: Column) -> Column:
    """Letters without their accents and compatibility forms as what they stand for; loose combining marks fall away. Forms of several letters (ligatures) stay."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")).otherwise(text)


def normalised(title: Column) -> Column:
    """Without an audio extension; underscores are spaces where they prevail; plain dashes and quotes; single spaces."""
    text = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), rf"(?i)\.({EXTENSIONS})$", "")
    text = F.translate(text, "｜：＂“”", '|:"""')
    under, spaces = (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in "_ ")
    text = F.when((under > 0) & (under >= spaces), F.replace(text, F.lit("_"), F.lit(" "))).otherwise(text)
    return F.trim(F.regexp_replace(F.translate(text, "–—―", "---"), r"\s+", " "))


def without_noise(text: Column) -> Column:
    for pattern in NOISE:
        text = F.regexp_replace(text, f"(?i){pattern}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[(\[{]\s*[)\]}]", " "), r"\|\s*(?=\||$)", " ")
    return F.regexp_replace(F.regexp_replace(F.translate(text, "*«»", "   "), r"\s+", " "), _EDGES, "")


def tokens(text: Column) -> Column:
    """Words for comparing: without noise and accents, in lower case."""
    text = normalised(text)
    for pattern in (*NOISE, r"\s-\s*topic\s*$"):
        text = F.regexp_replace(text, f"(?i){pattern}", " ")
    return F.regexp_extract_all(F.lower(without_accents(text)), F.lit("[a-z0-9']+"), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """F1 of two token arrays as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def dashed_slug(text: Column, most: int = 48) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(without_accents(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def credit(group: Column) -> Column:
    """Who is named by a credit: qualifying words are taken off its end; empty if nothing is left."""
    words = F.filter(F.split(F.trim(group), r"\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.lower(w), r"^[.,'\"]+|[.,'\"]+$", "")
    known = F.array(*map(F.lit, QUALIFIERS))
    kept = F.aggregate(F.reverse(words), F.array().cast("array<string>"), lambda s, w: F.when((F.size(s) == 0) & F.array_contains(known, plain(w)), s).otherwise(F.concat(F.array(w), s)))
    return bound(F.regexp_replace(F.array_join(kept, " "), r"^[ \-,&]+|[ \-,&]+$", ""), lambda name: F.when(F.array_contains(known, F.lower(name)), "").otherwise(name))


def _stripped(text: Column, edges: str = _EDGES) -> Column:
    return F.regexp_replace(text, edges, "")


def _dashed(text: Column) -> Column:
    """The parts between dashes, without empty ones."""
    return F.filter(F.transform(F.split(text, _DASH), _stripped), lambda p: p != "")


def without_groups(text: Column) -> Column:
    return _stripped(F.regexp_replace(F.regexp_replace(text, _GROUP, " "), r"\s+", " "))


def without_prefix(text: Column) -> Column:
    """Without labels, premieres and shouts before a colon or a pipe, up to three of them.

    A short name before a pipe is the label if an artist and a track follow; if a track and a credit follow, it is the artist.
    """
    cut = r"(?s)^\s*([^:|]{1,40}?)\s*([:|])\s*(.+)$"

    def judged(x: Column) -> Column:
        head, rest = x["head"], x["rest"]
        low = _stripped(F.lower(head), r"^[ .\-]+|[ .\-]+$")
        known = low.rlike("^(?:" + "|".join(PREFIXES) + ")")
        shouted = (F.upper(head) == head) & (F.lower(head) != head)
        named = (F.size(F.split(head, r"\s+")) <= 4) & ~head.rlike(_DASH) & rest.rlike(_DASH) & (shouted | (x["mark"] == "|"))
        artist = bound(_dashed(rest), lambda parts: named & ~known & (F.size(parts) == 2) & without_groups(F.element_at(parts, -1)).rlike(_KEYWORD))
        out = F.when(artist, F.concat(head, F.lit(" - "), rest)).when((known | named) & (rest != ""), rest).otherwise(x["text"])
        return F.struct(out.alias("text"), (artist | ~((known | named) & (rest != ""))).alias("done"))

    def step(s: Column, _: Column) -> Column:
        groups = F.struct(s["text"].alias("text"), *(F.trim(F.regexp_extract(s["text"], cut, k)).alias(c) for k, c in ((1, "head"), (2, "mark"), (3, "rest"))))
        return F.when(s["done"] | ~s["text"].rlike(cut), F.struct(s["text"].alias("text"), F.lit(True).alias("done"))).otherwise(bound(groups, judged))

    return F.trim(F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.struct(text.alias("text"), F.lit(False).alias("done")), step, lambda s: s["text"]))


def without_tail(text: Column) -> Column:
    """Without what follows the last pipe, if it is short."""
    cut = F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"\s*\|\s*[^|]{0,30}$", "")).otherwise(text)
    return _stripped(F.regexp_replace(cut, r"\s+", " "))


def kind_of(text: Column) -> Column:
    """The first word in a text that makes it a credit; an original mix is none."""
    kind = F.lower(F.regexp_extract(text, _KEYWORD, 1))
    return F.when((kind == "mix") & text.rlike(r"(?i)\boriginal\s+mix\b"), "").otherwise(kind)


def _run_before(words: Column, at: Column, fits: Callable[[Column], Column]) -> Column:
    """How many words right before a place fit, without a gap."""
    step = lambda s, w: F.struct((s["on"] & fits(w)).alias("on"), (s["n"] + (s["on"] & fits(w)).cast("int")).alias("n"))
    return F.aggregate(F.reverse(F.slice(words, 1, at)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step, lambda s: s["n"])


def bare_credit(track: Column) -> Column:
    """struct(remixer, track, fallbacks) of a title whose credit has no brackets: one name before the first credit word and its qualifiers, more if
    it is written small, and partners joined by & or x. A fallback leaves one more word of the track to the credit."""
    known = F.array(*map(F.lit, QUALIFIERS))
    qualifies = lambda w: F.array_contains(known, _stripped(F.lower(w), r"^[.,'\"]+|[.,'\"]+$"))
    small = lambda w: (F.substring(w, 1, 1) != F.upper(F.substring(w, 1, 1))) & ~F.array_contains(known, F.lower(w))
    joins = F.array(*map(F.lit, ("&", "x", "and", "+")))
    names = lambda words, at: at - _run_before(words, at, small)

    def cut(words: Column) -> Column:
        first = F.array_position(F.transform(words, lambda w: _stripped(w, r"^[.,!?'\"]+|[.,!?'\"]+$").rlike(rf"(?i)^(?:{'|'.join(KEYWORDS)})$")), F.lit(True)).cast("int") - 1

        def ended(end: Column) -> Column:
            start = bound(names(words, end - 1), lambda s: F.when(s <= 0, end - 1).otherwise(s))
            partner = lambda s, _: F.when((s > 1) & F.array_contains(joins, F.lower(F.get(words, s - 1))), names(words, s - 2)).otherwise(s)
            start = F.aggregate(words, start, partner)
            join = lambda a, n: F.array_join(F.slice(words, a + 1, F.greatest(n, F.lit(0))), " ")
            guess = bound(start, lambda s: F.struct(join(s, end - s).alias("remixer"), join(F.lit(0), s).alias("track"), F.when(s > 1, F.array(join(F.lit(0), s - 1))).otherwise(F.array().cast("array<string>")).alias("fallbacks")))
            none = F.struct(F.lit("").alias("remixer"), F.when(end > 0, join(F.lit(0), end)).otherwise(track).alias("track"), F.array().cast("array<string>").alias("fallbacks"))
            return F.when(end <= 1, none).otherwise(guess)

        whole = F.struct(F.lit("").alias("remixer"), track.alias("track"), F.array().cast("array<string>").alias("fallbacks"))
        return F.when(first < 0, whole).otherwise(bound(first - _run_before(words, first, qualifies), ended))

    return bound(F.filter(F.split(track, r"\s+"), lambda w: w != ""), cut)


def parsed(title: Column, uploader: Column | None = None) -> Column:
    """struct(artist, track, remixer, kind, feat, credits, ambiguous, fallbacks) of a title.

    Bracketed credits and features come first, then the dash between artist and track, then credits behind further dashes. A title without a
    dash has no artist and is ambiguous, and so is a credit that had to be guessed. A credit that names nobody is the uploader's.
    """
    in_group = r"(?i)^(?:feat\.?|ft\.?|featuring|with)\s+(.+)$"
    edges = r"^[ \-,&]+|[ \-,&]+$"
    uploader = F.trim(F.coalesce(uploader, F.lit(""))) if uploader is not None else F.lit("")
    first = lambda xs: F.coalesce(F.get(F.filter(xs, lambda x: x != ""), F.lit(0)), F.lit(""))
    features = lambda t: F.struct(_stripped(F.regexp_replace(t, _FEATURING, ""), r"^[ \-,]+|[ \-,]+$").alias("text"), F.regexp_extract(t, _FEATURING, 1).alias("feat"))

    def read(text: Column) -> Column:
        groups = F.transform(F.regexp_extract_all(text, F.lit(r"[(\[{]([^()\[\]{}]*)[)\]}]"), F.lit(1)), lambda g: F.trim(g))
        body = without_groups(text)
        return bound(F.struct(text.alias("text"), groups.alias("groups"), body.alias("body"), _dashed(body).alias("parts")), split)

    def split(x: Column) -> Column:
        marks = F.transform(x["parts"], lambda p, i: F.when(p.rlike(_KEYWORD), 0).otherwise(i + 1))
        keep = F.when(F.size(x["parts"]) > 2, F.greatest(F.array_max(marks), F.lit(2))).otherwise(F.size(x["parts"]))
        return bound(F.struct(x["text"].alias("text"), x["groups"].alias("groups"), x["body"].alias("body"), F.slice(x["parts"], 1, keep).alias("parts"), F.reverse(F.slice(x["parts"], keep + 1, F.size(x["parts"]))).alias("tails")), named)

    def named(x: Column) -> Column:
        parts, groups = x["parts"], x["groups"]
        credits = F.concat(F.filter(groups, lambda g: g.rlike(_KEYWORD) & ~g.rlike(in_group)), x["tails"])
        two = F.size(parts) >= 2
        track = F.when(two, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(F.coalesce(F.get(parts, F.lit(0)), x["body"]))
        artist = F.when(two, F.get(parts, F.lit(0))).otherwise("")
        return bound(F.struct(
            x["text"].alias("text"), (F.size(parts) == 1).alias("alone"), features(track).alias("track"), features(artist).alias("artist"), F.transform(credits, kind_of).alias("kinds"),
            F.filter(F.transform(credits, credit), lambda n: n != "").alias("credits"), F.transform(F.filter(groups, lambda g: g.rlike(in_group)), lambda g: F.trim(F.regexp_extract(g, in_group, 1))).alias("feats"),
        ), guessed)

    def guessed(x: Column) -> Column:
        bare = (F.size(x["credits"]) == 0) & x["track"]["text"].rlike(_KEYWORD)
        none = F.struct(F.lit("").alias("remixer"), x["track"]["text"].alias("track"), F.array().cast("array<string>").alias("fallbacks"))
        return bound(F.struct(x.alias("x"), F.when(bare, bare_credit(x["track"]["text"])).otherwise(none).alias("g"), first(F.concat(x["kinds"], F.array(kind_of(x["text"])))).alias("kind")), finished)

    def finished(y: Column) -> Column:
        x, g, kind = y["x"], y["g"], y["kind"]
        own = F.when(g["remixer"] != "", g["remixer"]).otherwise(F.coalesce(F.get(x["credits"], F.lit(0)), F.lit("")))
        remixer = F.when((own == "") & kind.isin(*AUTHORED) & (uploader != ""), uploader).otherwise(own)
        artist, track = _stripped(x["artist"]["text"], edges), _stripped(F.when(g["track"] != "", g["track"]).otherwise(x["track"]["text"]), edges)
        lone = (track == "") & (artist != "")
        return F.struct(
            F.when(lone, "").otherwise(artist).alias("artist"), F.when(lone, artist).otherwise(track).alias("track"), remixer.alias("remixer"), kind.alias("kind"),
            first(F.concat(x["feats"], F.array(F.trim(x["track"]["feat"]), F.trim(x["artist"]["feat"])))).alias("feat"), x["credits"].alias("credits"),
            (x["alone"] | (g["remixer"] != "") | lone).alias("ambiguous"), g["fallbacks"].alias("fallbacks"),
        )

    return bound(without_tail(without_noise(without_prefix(normalised(title)))), read)


def search_queries(p: Column, most: int = 5) -> Column:
    """What to search for, best first, from a parsed title: the artist's official upload, the plain pair, lyrics; where it was guessed, shorter and reversed forms too. Repeated ones, but for case, come once."""
    artist, track = F.trim(p["artist"]), F.trim(p["track"])
    said = lambda *x: F.concat_ws(" ", *(F.lit(v) if isinstance(v, str) else v for v in x))
    pair = F.array(said(artist, track, "official audio"), said(artist, "-", track), said(track, artist, "lyrics"))
    alone = F.array(said(track, "official audio"), said(track, "original song"), said(track, "lyrics"))
    short = F.transform(p["fallbacks"], lambda s: said(artist, s, "official audio"))
    turned = F.when(p["ambiguous"] & (artist != "") & (track != ""), F.array(said(track, artist, "official audio"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.when(track == "", F.array().cast("array<string>")).when(artist == "", alone).otherwise(pair), short, turned)
    clean = F.filter(F.transform(every, lambda q: F.trim(F.regexp_replace(q, r"\s+", " "))), lambda q: q != "")
    once = F.aggregate(clean, F.array().cast("array<string>"), lambda s, q: F.when(F.exists(s, lambda o: F.lower(o) == F.lower(q)), s).otherwise(F.concat(s, F.array(q))))
    return F.slice(once, 1, most)


def label_of(p: Column) -> Column:
    """Artist - Track (Remixer Remix)."""
    head = F.when(p["artist"] != "", F.concat_ws(" - ", p["artist"], p["track"])).otherwise(p["track"])
    kind = F.when(p["kind"].isin("", "remix"), "Remix").otherwise(p["kind"])
    return F.when(p["remixer"] != "", F.concat(head, F.lit(" ("), p["remixer"], F.lit(" "), kind, F.lit(")"))).otherwise(head)


def pair_slug(p: Column) -> Column:
    """A file name for a pair: artist-track-remixer."""
    own = F.concat_ws(" ", *(F.nullif(p[c], F.lit("")) for c in ("artist", "track", "remixer")))
    out = dashed_slug(own, 56)
    return F.when(out == "", "remix").otherwise(out)
