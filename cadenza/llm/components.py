"""Connected components of an edge table, by alternating large and small stars. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node that it reaches) for each node of the edges (a, b), longs without nulls.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones likewise; the rounds end
    when nothing changes, after about log(longest path) of them. Every round is written to the shared folder, so a lost
    executor costs no more than its round. Minima are aggregated before the shuffle, so a node of many edges is no hot group;
    joins are left to adaptive execution, which splits skewed ones. Self-links and repeated links do no harm.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = links.where("a > b")
        both = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        next_links = stored(small_star.where("a > b").distinct(), "links")
        now = next_links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        links, mark = next_links, now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
