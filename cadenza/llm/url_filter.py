"""Operator 6: URL filters by gradient-boosted trees on lexical features. DataFrame functions and Spark's own trees only.

Rules label the URLs that they fit; the others are judged by a boosted ensemble that learns from those labels. Features are
lexical: lengths, depth, shares of digits and marks, entropy of characters, parameters, and statistics of the host's
suffix: how common it is, and which share of its labelled URLs the rules block. Suffixes are hashed into a fixed number of
bins, so their statistics can be broadcast; they are taken over all rows. The trees are fitted on the labelled rows with the
smallest hash of their URL, TRAIN_ROWS at most; learned and scored by the executors.

A null URL and one without :// have an empty host and path, fit no rule and are judged by their features. Ties (a score of one
half) are blocked. Where the rules label nothing, or all alike, that label (or else allow) is the verdict. Repeated rows are
judged each. Very long URLs are read whole. Empty tables give no rows. Only page_id and url are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
SUFFIX_BINS = 1024
TREES, DEPTH = 10, 4
FEATURES = ("n_url", "n_host", "n_path", "n_query", "labels", "depth", "longest", "digits", "marks", "upper", "hyphens", "entropy", "parameters", "encoded", "numbered", "secure", "fragment", "suffix_share", "suffix_blocked")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, pattern, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _share(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]", "")) / F.greatest(F.char_length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.char_length(text).cast("double")
    share = lambda c: F.greatest(n - F.char_length(F.replace(text, c, F.lit(""))), F.lit(1.0)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))).otherwise(0.0)


def featured(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, label (null where no rule fits), suffix (a bin) and the features but for those of the suffix."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"))
    url, query = F.col("url"), F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    count = lambda text, what: F.regexp_count(text, F.lit(what))
    made = {
        "n_url": F.char_length(url), "n_host": F.char_length("host"), "n_path": F.char_length("path"), "n_query": F.char_length(query), "labels": count(F.col("host"), r"\.") + 1,
        "depth": count(F.col("path"), "/"), "longest": F.array_max(F.transform(F.split("path", "[/._-]"), F.char_length)), "digits": _share(url, "0-9"), "marks": _share(url, r"!-/:-@\[-`{-~"), "upper": _share(url, "A-Z"),
        "hyphens": count(F.col("host"), "-"), "entropy": entropy(url), "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "encoded": count(url, "%[0-9A-Fa-f]{2}"),
        "numbered": F.char_length(F.regexp_extract("path", "([0-9]+)", 1)), "secure": url.startswith("https:"), "fragment": F.contains(url, F.lit("#")),
    }
    suffix = F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_BINS)).cast("int")
    return rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("label"), suffix.alias("suffix"), *(c.cast("double").alias(k) for k, c in made.items()))


def judged(pages: DataFrame, most: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> DataFrame:
    """For each row: page_id, host, path, rule, verdict and score (the probability of block; of a rule's verdict 0 or 1)."""
    rows = stored(featured(pages), "url-features")
    labelled, blocked = F.count("label"), F.count(F.when(F.col("label") == "block", 1))
    sums = stored(rows.groupBy("suffix").agg(F.count("*").alias("n"), labelled.alias("known"), blocked.alias("bad")), "url-suffixes")  # SUFFIX_BINS rows at most
    total = sums.agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad")).first()
    if not total["known"] or total["bad"] in (0, total["known"]):
        only = "block" if total["known"] and total["bad"] else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("label", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("score"))
    base = total["bad"] / total["known"]
    own = F.when(F.col("label").isNotNull(), 1).otherwise(0)  # a row's own label is no part of its features, or learning would see what it is to tell
    share = (F.col("bad") - F.when(F.col("label") == "block", 1).otherwise(0) + 10 * base) / (F.col("known") - own + 10)
    counted = rows.join(F.broadcast(sums), "suffix").withColumn("suffix_share", F.col("n") / total["n"]).withColumn("suffix_blocked", share)
    full = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted.drop("n", "known", "bad"))
    learn = full.where("label is not null").withColumn("place", F.xxhash64("url", "page_id")).orderBy("place").limit(most)
    learn = stored(learn.select("features", (F.col("label") == "block").cast("double").alias("target")), "url-sample")
    if learn.select("target").distinct().count() < 2:
        score = F.lit(base)
        out = full.withColumn("guess", score)
    else:
        model = GBTClassifier(featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, cacheNodeIds=False).fit(learn)
        from pyspark.ml.functions import vector_to_array

        out = model.transform(full).withColumn("guess", vector_to_array("probability")[1])
    score = F.when(F.col("label").isNotNull(), (F.col("label") == "block").cast("double")).otherwise(F.col("guess"))
    return out.select("page_id", "host", "path", "rule", F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"), score.alias("score"))
