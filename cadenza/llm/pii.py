"""Operator 3: personal data by weak supervision. DataFrame functions only.

1. Candidates: regular expressions find, for each kind, the leftmost non-overlapping matches of the base patterns, and
   wider ones (numbers without a plus, e-mail addresses that are spelled out, base matches that fail their check).
2. Labelers vote yes, no or nothing on each candidate: `regex` (the kind's check: octets, Luhn, digits), `gazetteer` (top-level
   domains, reserved networks, issuer prefixes, country codes), `context` (cue words before it) and `edges` (what it touches).
3. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each candidate
   pattern's probability. There are at most 3^4 patterns for each of the kinds, so what is collected has a fixed size.
4. A logistic regression, trained on those probabilities over votes and shape (length, digits, separators), decides.
   Base matches that pass their check always stay; the classifier adds others. Wider candidates that overlap those are none;
   what overlaps base matches that fail is judged too, and of what the classifier takes, spans inside another one are dropped.

Patterns use possessive loops and begin at run starts, so very long texts take linear time and no deep stack. Offsets are code
points. Null and empty texts have no spans. Repeated rows are read each, rows without doc_id too. Spans that begin at one place come in
the order of KINDS, then by their end. Empty tables give no rows. Only doc_id and text are read, so other columns can't clash;
redacted() hands on all columns, whatever their names, and changes only text and n_chars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "edges")
#: Candidates that a labeler is taken to have judged rightly before any is seen, against one wrongly.
TRUST = (16.0, 3.0, 4.0, 2.0)
#: Characters before a candidate that are searched for cues.
CONTEXT = 40
_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, pattern, what a text must hold to have a match)
PATTERNS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
WIDER = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)++", r"[\[(](?i:at)[\])]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", r"[0-9]{3}[.-][0-9]{4}"),
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|app|dev|eu|uk|us|ca|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|gr|cz|ru|ua|tr|jp|cn|kr|in|au|nz|br|mx|ar|cl|za"
_RESERVED = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
_COUNTRIES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6][0-9]|29[0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
_CUES = {
    "email": r"(?i)e-?mail|contact|write|correo|courriel|kontakt|mailto",
    "ip": r"(?i)\bip\b|host|server|address|adresse|login|from",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta|pay|account",
    "phone": r"(?i)tel|phone|call|mobil|fax|cell|t[eé]l[eé]|llam|anruf|whatsapp",
}
_AGAINST = r"(?i)version|release|isbn|issn|order|serial|invoice|page|build|#\s*$"
_SPAN = "struct<kind:string,rank:int,start:int,end:int,base:boolean,pattern:string>"


def _contains(text: Column, gate: str) -> Column:
    return F.contains(text, F.lit(gate)) if len(gate) == 1 else text.rlike(gate)


def _cut(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<before, found, after>>: each match, the text between it and the match before it, the character after it."""
    whole, kind = F.lit(rf"(?s)\G(.*?)({pattern})(?=(.?))"), "array<struct<before:string,found:string,after:string>>"
    all_of = F.arrays_zip(*(F.regexp_extract_all(text, whole, F.lit(k)).alias(c) for k, c in enumerate(("before", "found", "after"), 1)))
    return F.when(_contains(text, gate), all_of.cast(kind)).otherwise(F.array().cast(kind))


def _ends(cut: Column) -> Column:
    """The code-point offset at which each match ends; only integers are carried along, so that many matches stay cheap."""

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.char_length(x["before"]) + F.char_length(x["found"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(end)).alias("out"))

    return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The check of a base match."""
    n = F.char_length(_digits(found))
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def _votes(kind: str, found: Column, before: Column, after: Column, base: Column) -> Column:
    """The four labelers' votes, and the shape, as one short text."""
    digits = _digits(found)
    if kind == "email":
        known = found.rlike(rf"(?i)(?:\.|[\])]\x20?)(?:{_DOMAINS})$")
    elif kind == "ip":
        known = ~found.rlike(_RESERVED)
    elif kind == "card":
        known = digits.rlike(_ISSUERS)
    else:
        known = F.when(found.startswith("+"), digits.rlike(_COUNTRIES)).otherwise(digits.rlike("^[2-9][0-9]{2}[2-9]"))
    open_edges = ~before.rlike(r"[\pL\pN_]$") & ~after.rlike(r"^[\pL\pN_]")
    n = F.char_length(digits)
    shape = [
        F.when(F.char_length(found) < 12, "s").when(F.char_length(found) < 24, "m").otherwise("l"),
        F.when(n < 7, "a").when(n < 13, "b").when(n < 20, "c").otherwise("d"),
        F.when(found.rlike(r"[\x20()\[\]]"), "p").otherwise("q"),
    ]
    return F.concat(_vote(base, ~base), _vote(known, ~known), _vote(before.rlike(_CUES[kind]), before.rlike(_AGAINST)), _vote(open_edges, ~open_edges), *shape)


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `found`: an array of kind, rank, start, end, base (a base span), pattern (votes and shape)."""
    plans = [*((k, p, g, False) for k, p, g in PATTERNS), *((k, p, g, True) for k, p, g in WIDER)]
    own = [f"__p{k}" for k in range(len(plans))]
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    rows = rows.select("*", *(_cut(F.col("__text"), p, g).alias(c) for c, (_, p, g, _) in zip(own, plans, strict=True)))
    rows = rows.select(*keep, *own, *(_ends(F.col(c)).alias(f"{c}e") for c in own))

    def spans(c: str, kind: str, wider: bool) -> Column:
        def one(x: Column, i: Column) -> Column:
            base = F.lit(False) if wider else passes(kind, x["found"])
            before, end = F.substring(x["before"], -CONTEXT, CONTEXT), F.get(F.col(f"{c}e"), i)
            return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), (end - F.char_length(x["found"])).alias("start"), end.alias("end"), base.alias("base"), _votes(kind, x["found"], before, x["after"], base).alias("pattern"))

        out = F.transform(F.col(c), one)
        if kind == "card":  # fewer than 13 digits are no candidate
            out = F.filter(out, lambda x: ~x["pattern"].rlike("^.{5}[ab]"))
        return out.cast(f"array<{_SPAN}>")

    base_list = F.concat(*(spans(c, k, w) for c, (k, _, _, w) in zip(own, plans, strict=True) if not w))
    wide_list = F.concat(*(spans(c, k, w) for c, (k, _, _, w) in zip(own, plans, strict=True) if w))
    rows = rows.select(*keep, base_list.alias("__base"), wide_list.alias("__wide"))
    clear = F.filter("__wide", lambda x: ~F.exists("__base", lambda b: b["base"] & (b["start"] < x["end"]) & (x["start"] < b["end"])))
    found = F.array_sort(F.transform(F.concat("__base", clear), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), x["pattern"].alias("pattern"))))
    return rows.select(*keep, found.alias("found"))


def pattern_counts(found: DataFrame) -> list[tuple[str, str, int]]:
    """(kind, pattern, candidates with it). At most kinds x 3^4 x 24 rows."""
    rows = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.pattern").agg(F.count("*").alias("n"))
    return sorted((r["kind"], r["pattern"], r["n"]) for r in rows.collect())


def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[str, tuple[float, list[dict[str, tuple[float, float]]]]]:
    """By expectation-maximisation for each kind: the share of true candidates, and for each labeler P(vote | false), P(vote | true)."""
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        votes: dict[str, int] = {}
        for k, p, n in counts:
            if k == kind:
                votes[p[:4]] = votes.get(p[:4], 0) + n
        true = {v: (1 + v.count("y")) / (2 + v.count("y") + v.count("n")) for v in votes}
        for _ in range(rounds):
            total = sum(votes.values())
            prior = (1 + sum(votes[v] * true[v] for v in votes)) / (2 + total)
            tables = []
            for j in range(len(LABELERS)):
                table = {}
                for x in "yn-":
                    agree = 1.0 if x == "-" else TRUST[j]
                    no = sum(votes[v] * (1 - true[v]) for v in votes if v[j] == x) + (agree if x != "y" else 1.0)
                    yes = sum(votes[v] * true[v] for v in votes if v[j] == x) + (agree if x != "n" else 1.0)
                    table[x] = (no, yes)
                sums = [sum(t[k] for t in table.values()) for k in (0, 1)]
                tables.append({x: (t[0] / sums[0], t[1] / sums[1]) for x, t in table.items()})
            true = {v: _posterior(v, prior, tables) for v in votes}
        out[kind] = (prior, tables)
    return out


def _posterior(votes: str, prior: float, tables: list[dict[str, tuple[float, float]]]) -> float:
    log = math.log(prior) - math.log(1 - prior) + sum(math.log(t[v][1] / t[v][0]) for v, t in zip(votes, tables, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))


def _features(kind: str, pattern: str) -> list[str]:
    return ["1", kind, *(f"{kind}{j}{v}" for j, v in enumerate(pattern))]


def classifier(counts: list[tuple[str, str, int]], rounds: int = 300, rate: float = 1.0, ridge: float = 0.01) -> dict[str, float]:
    """Weights of the logistic regression, trained on the patterns' probabilities, weighted by the logarithm of their counts."""
    known = reliabilities(counts)
    rows = [(_features(k, p), _posterior(p[:4], *known[k]), math.log1p(n)) for k, p, n in counts]
    weights = {f: 0.0 for fs, _, _ in rows for f in fs}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = {f: ridge * w for f, w in weights.items()}
        for fs, y, n in rows:
            g = (score(fs, weights) - y) * n / total
            for f in fs:
                slope[f] += g
        for f, g in slope.items():
            weights[f] -= rate * g
    return weights


def score(features: list[str], weights: dict[str, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in features)))))


def accepted(counts: list[tuple[str, str, int]], least: float = 0.5) -> list[str]:
    """kind:pattern of the candidates that the classifier takes."""
    weights = classifier(counts)
    return [f"{k}:{p}" for k, p, _ in counts if score(_features(k, p), weights) >= least]


def _taken(found: Column, take: list[str]) -> Column:
    known = F.array(*map(F.lit, take)).cast("array<string>")
    return _outermost(F.filter(found, lambda x: x["base"] | F.array_contains(known, F.concat_ws(":", x["kind"], x["pattern"]))))


def _outermost(found: Column) -> Column:
    """Without the spans inside one before them, base spans aside: those of found come by start. No text is uncovered by it."""

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    before = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])
    pairs = F.zip_with(found, before, lambda x, at: F.struct(x.alias("x"), at.alias("at")))
    return F.transform(F.filter(pairs, lambda p: p["x"]["base"] | (p["x"]["end"] > p["at"])), lambda p: p["x"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, found (all spans: start, rank, end, kind, base, pattern), and n_* of the base spans by kind."""
    found = stored(candidates(docs), "pii-candidates")
    rows = found.select("doc_id", _taken(F.col("found"), accepted(pattern_counts(found))).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), "found")


def digested(docs: DataFrame) -> DataFrame:
    """detected() with base_sha256 and spans in place of found."""
    rows = detected(docs).withColumn("base", F.filter("found", lambda x: x["base"]))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets, and n_chars, if it is there, counted anew. Null texts stay null."""
    take = accepted(pattern_counts(candidates(docs)))
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("row"), F.col("text"))  # all other columns in one, so that none clashes
    rows = candidates(whole, keep=("row", "text")).select("row", "text", _taken(F.col("found"), take).alias("found"))

    covered = F.aggregate("found", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
    rows = rows.withColumn("covered", F.when(F.size("found") > 0, covered))

    def piece(x: Column, i: Column) -> Column:
        done = F.get(F.col("covered.out"), i)
        return F.when(x["end"] > done, F.concat(F.substring(F.col("text"), done + 1, F.greatest(x["start"] - done, F.lit(0))), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")

    tail = F.substring(F.col("text"), F.col("covered.at") + 1, F.char_length(F.col("text")))
    rows = rows.withColumn("text", F.when(F.size("found") > 0, F.concat(F.array_join(F.transform("found", piece), ""), tail)).otherwise(F.col("text")))
    own = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in names))
