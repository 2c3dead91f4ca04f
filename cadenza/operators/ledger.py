"""A ledger of links as a table: lookups, names that are still free, and what becomes of a link. Rows are put in by folds.upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may have become of a link, what a second run leaves alone, and the score below which a candidate isn't looked at.
STATUSES = ("done", "needs_review", "standalone", "failed", "pending")
SETTLED = ("done", "standalone", "needs_review")
# End of fixed values.


def by_url(ledger: DataFrame, url: str) -> DataFrame:
    return ledger.where(F.col("url") == (url or "").strip())


def by_slug(ledger: DataFrame, slug: str) -> DataFrame:
    return ledger.where(F.col("slug") == slug)


def of_status(ledger: DataFrame, *statuses: str) -> DataFrame:
    return ledger.where(F.col("status").isin(*statuses))


def to_do(links: DataFrame, ledger: DataFrame) -> DataFrame:
    """The links (url) that are not settled yet, each once."""
    return links.dropDuplicates(["url"]).join(of_status(ledger, *SETTLED).select("url"), "url", "left_anti")


def free_slugs(new: DataFrame, taken: DataFrame, slug: str, order: str, name: str = "free") -> DataFrame:
    """new with a name of its own for each row: its slug, or the slug with the next number from 2 that neither taken (slug) nor a row before it has.
    A number that is part of another row's own slug is left to that row.

    Rows of one slug are numbered in their order, and each gets the free number of its place: the free numbers are counted between
    the taken ones, so a slug that very many rows share is no group of one task but for its window.
    """
    own = F.regexp_extract(F.col("slug"), r"^(.*)-([0-9]+)$", 1)
    number = F.regexp_extract(F.col("slug"), r"^(.*)-([0-9]+)$", 2).try_cast("long")
    used = taken.select("slug").distinct()
    numbered = used.union(new.select(F.col(slug).alias("slug"))).distinct().where(number >= 2).where(F.regexp_extract(F.col("slug"), r"-([0-9]+)$", 1) == number.cast("string")).select(own.alias("__slug"), number.alias("__used"))
    used = used.select(F.col("slug").alias("__slug"), F.lit(1).cast("long").alias("__used")).union(numbered)
    # the k-th free number is k plus as many used ones as there are up to it: of the used numbers u_1 < u_2 ... those with u_i - i < k
    gaps = used.withColumn("__i", F.row_number().over(Window.partitionBy("__slug").orderBy("__used"))).withColumn("__free", F.col("__used") - F.col("__i"))
    steps = gaps.groupBy("__slug", "__free").agg(F.max("__i").alias("__i"))
    rows = new.withColumn("__slug", F.col(slug)).withColumn("__k", F.row_number().over(Window.partitionBy(slug).orderBy(order)).cast("long"))
    # both are put in one line for each slug: steps before the places that come after them, and the last step counts
    line = Window.partitionBy("__slug").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.select("__slug", F.col(order).alias("__order"), F.col("__k").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__skip"))
    both = both.unionByName(steps.select("__slug", F.lit(None).cast(new.schema[order].dataType).alias("__order"), (F.col("__free") + 1).alias("__at"), F.lit(0).alias("__kind"), F.col("__i").cast("long").alias("__skip")))
    placed = both.withColumn("__n", F.col("__at") + F.coalesce(F.last("__skip", ignorenulls=True).over(line), F.lit(0))).where("__kind = 1")
    named = placed.select(F.col("__slug"), F.col("__order"), F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", F.col("__n").cast("string"))).alias(name))
    return rows.join(named, (rows["__slug"] == named["__slug"]) & (rows[order] == named["__order"])).select(*(rows[c] for c in new.columns), name)


def judged(links: DataFrame, compared: DataFrame, least: float = 0.0) -> DataFrame:
    """What becomes of each link (url, error): url, status, original_url, score.

    compared: url, place, original_url, candidate_score, score, verdict for its candidates in the order in which they are tried. Trying
    ends with the first match: done. Else the best score decides: needs_review if that is its verdict, standalone otherwise. A link with an error is failed.
    """
    # of a verdict only this counts: whether it is a match or needs review, and between equals which is the last by name
    verdict, review = F.col("verdict"), "needs_review"
    rank = F.when(verdict == "match", 3).when(verdict > review, 2).when(verdict == review, 1).when(verdict < review, 0)
    # dealt out before they are summed up: a link's candidates seldom lie together, and then sums before the shuffle are wider than they are
    tried = compared.where(F.col("candidate_score") >= least).select("url", "place", "original_url", "score", rank.alias("rank")).repartition("url")
    # a match that comes first ends the trying, and only without one do the others count: neither needs them in order
    match = F.coalesce(F.col("rank") == 3, F.lit(False))
    hit = F.min(F.when(match, F.struct("place", "original_url", "score")))
    rest = F.max(F.when(~match, F.struct(F.col("rank").isNotNull().alias("said"), "score", (-F.col("place")).alias("first"), "original_url", "rank")))
    best = tried.groupBy("url").agg(hit.alias("hit"), rest.alias("rest"))
    status = F.when(F.coalesce("error", F.lit("")) != "", "failed").when(F.col("hit").isNotNull(), "done").when(F.col("rest.rank") == 1, "needs_review").otherwise("standalone")
    kept = F.col("status").isin("done", "needs_review")
    of = lambda c: F.when(F.col("hit").isNotNull(), F.col(f"hit.{c}")).otherwise(F.col(f"rest.{c}"))
    return links.select("url", "error").join(best, "url", "left").withColumn("status", status).select("url", "status", F.when(kept, of("original_url")).alias("original_url"), F.when(F.col("status") != "failed", of("score")).alias("score"))


def decided(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger (slug, status, verdict, original_url, ...) after decisions by hand (slug, decision: accept or reject; original_url to accept another one, or null).

    Accepting needs an original and files the pair; rejecting keeps the remix on its own. Decisions of unknown slugs change nothing.
    """
    d = decisions.select(F.col("slug").alias("__slug"), F.col("decision").alias("__decision"), F.col("original_url").alias("__url"))
    rows = ledger.join(d, F.col("slug") == F.col("__slug"), "left")
    link = F.coalesce(F.col("__url"), F.col("original_url"))
    accepted, rejected = (F.col("__decision") == "accept") & (F.coalesce(link, F.lit("")) != ""), F.col("__decision") == "reject"
    new: dict[str, Column] = {
        "status": F.when(accepted, "done").when(rejected, "standalone").otherwise(F.col("status")),
        "verdict": F.when(accepted, "accepted by hand").when(rejected, "rejected by hand").otherwise(F.col("verdict")),
        "original_url": F.when(accepted, link).when(rejected, "").otherwise(F.col("original_url")),
    }
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in ledger.columns))
