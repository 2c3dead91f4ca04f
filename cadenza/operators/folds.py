"""What depends on order: runs, upserts, ordered folds, greedy choices, early stops, upkeep of unique names."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import keys as K
from cadenza.session import checkpointed, ship


def islands(rows: DataFrame, keys: list[str], t: str, gap: int, least: int = 0) -> DataFrame:
    """keys, start, end, n: runs of times whose gaps are at most gap; runs shorter than least are dropped."""
    line = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(line) <= gap, 0).otherwise(1)
    runs = rows.select(*keys, t, F.sum(new).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("__run"))
    return runs.groupBy(*keys, "__run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n")).drop("__run").where(F.col("end") - F.col("start") >= least)


def upserted(rows: DataFrame, key: str, order: list[str], added: str, kept: list[str]) -> DataFrame:
    """One row for each key: kept columns of its last row by order, added (the first value) and updated (the last)."""
    last = F.max(F.struct(*order, *kept))
    return rows.groupBy(key).agg(F.min(added).alias("added"), F.max(added).alias("updated"), F.count("*").alias("writes"), last.alias("__last")).select(key, "added", "updated", "writes", *(F.col(f"__last.{c}").alias(c) for c in kept))


def latest_known(value: Column, order: Column) -> Column:
    """Aggregate: the last value by order that is not null."""
    return F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]


def first_reaching(rows: DataFrame, keys: list[str], order: str, value: str, enough: float) -> DataFrame:
    """The rows of each group up to and with the first whose value is enough; all rows where none is."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.where(rows[value].isNotNull()).withColumn("__best", F.max(value).over(before)).where(F.coalesce(F.col("__best") < enough, F.lit(True))).drop("__best")


_FLOW = "shift int, code string, compatible boolean"


def key_flow(rows: DataFrame, group: str, order: str, code: str, largest: int = K.LARGEST_SHIFT) -> DataFrame:
    """group, order, source, shift, code, compatible: each track takes the first shift that lands in the neighbourhood of the key before it.

    A fold, since each choice depends on the one before it: tracks of a set come sorted, and the state of a set is its last
    key. Sets are streamed within sorted partitions, so none is held whole. Unreadable codes pass through and change nothing.
    """
    ship(rows.sparkSession)
    kind = {c: rows.schema[c].dataType.simpleString() for c in (group, order)}
    wheel = {(m, n): pc for m, row in ((True, K.MINOR), (False, K.MAJOR)) for pc, n in enumerate(row)}
    order_of = K.shifts(largest)

    def name(pc: int, minor: bool) -> str:
        return f"{(K.MINOR if minor else K.MAJOR)[pc % 12]}{'A' if minor else 'B'}"

    def near(code_: str) -> set[str]:
        n, letter = int(code_[:-1]), code_[-1]
        return {code_, f"{n % 12 + 1}{letter}", f"{(n - 2) % 12 + 1}{letter}", f"{n}{'B' if letter == 'A' else 'A'}"}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = None, None
        for batch in batches:
            out = []
            for g, o, c in batch.itertuples(index=False, name=None):
                if g != at:
                    at, before = g, None
                c = (c or "").strip().upper()
                key = wheel.get((c[-1:] == "A", int(c[:-1]))) if c[:-1].isdigit() and c[-1:] in "AB" else None
                if key is None:
                    out.append((g, o, c, 0, c, False))
                    continue
                minor = c[-1] == "A"
                shift = 0 if before is None else next((s for s in order_of if name(key + s, minor) in near(before)), None)
                before = name(key + (shift or 0), minor)
                out.append((g, o, c, shift or 0, before, shift is not None))
            yield pd.DataFrame(out, columns=[group, order, "source", "shift", "code", "compatible"])

    own = rows.select(group, order, F.col(code).alias("source")).repartition(group).sortWithinPartitions(group, order)
    return own.mapInPandas(fold, f"{group} {kind[group]}, {order} {kind[order]}, source string, {_FLOW}")


def greedy_apart(rows: DataFrame, key: str, t: str, value: str, apart: float, most: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """key, t, value: the strongest rows of each group that are apart from all stronger chosen ones; most of them at the most. Ties: the earlier. also: columns that are handed on.

    Rows on two sides of a gap of that width don't bear on each other, so the runs between gaps are dealt out and streamed in sorted
    partitions; a run is what is held, not a group.
    """
    ship(rows.sparkSession)
    line = Window.partitionBy(key).orderBy(t)
    gap = F.coalesce((F.col(t) - F.lag(t).over(line) >= apart).cast("int"), F.lit(0))
    own = rows.select(key, t, value, *also).withColumn("__gap", gap)
    own = own.withColumn("__run", F.sum("__gap").over(line.rowsBetween(Window.unboundedPreceding, 0))).select(key, t, value, *also, "__run")

    def choose(found: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        """Of some runs at once, run by run; run: the number of each row's."""
        order = found.assign(__run=run).sort_values(["__run", value, t], ascending=[True, False, True], kind="stable")
        taken: list = []
        keep, before = [], None
        for i, r, x in zip(order.index.tolist(), order["__run"].tolist(), order[t].tolist(), strict=True):
            if r != before:
                taken, before = [], r
            k = bisect.bisect_left(taken, x)
            if (k == 0 or x - taken[k - 1] >= apart) and (k == len(taken) or taken[k] - x >= apart):
                taken.insert(k, x)
                keep.append(i)
        return found.loc[keep].drop(columns="__run")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rest = batch.reset_index(drop=True) if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rest):
                continue
            names = pd.factorize(rest[key])[0]  # a null is a name of its own
            run = np.cumsum(np.concatenate([[0], (np.diff(names) != 0) | (np.diff(rest["__run"].to_numpy()) != 0)]))
            last = int(np.searchsorted(run, run[-1]))
            held = rest.iloc[last:]
            if last:
                yield choose(rest.iloc[:last], run[:last])
        if held is not None:
            yield choose(held, np.zeros(len(held), int))

    out = own.repartition(key, "__run").sortWithinPartitions(key, "__run", t).mapInPandas(stream, own.drop("__run").schema)
    if most is None:
        return out
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), t))
    return out.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def smallest_reached(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, group: the smallest node that each of nodes (node) reaches over links (a, b) in either direction, itself at least.

    Each round takes the smallest name among the neighbours, then the name that this name has; rounds end when nothing changes.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    groups = checkpointed(nodes.select("node", F.col("node").alias("group"), F.lit(True).alias("moved")))
    while groups.where("moved").first() is not None:
        named = lambda rows: rows.select(F.col("node").alias("of"), F.col("group").alias("name"))
        near = both.join(named(groups), F.col("b") == F.col("of")).groupBy("a").agg(F.min("name").alias("near"))
        spread = groups.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("group").alias("was"), F.least("group", "near").alias("group"))
        spread = checkpointed(spread)
        further = F.least("group", "name")
        groups = checkpointed(spread.join(named(spread), F.col("group") == F.col("of"), "left").select("node", further.alias("group"), (further < F.col("was")).alias("moved")))
    return groups.select("node", "group")


def unique_names(rows: DataFrame, name: str, tag: str, order: str) -> DataFrame:
    """rows with out: the name, with the tag where another row has it but for case, and a number where that is not enough."""
    clash = Window.partitionBy(F.lower(name))
    tagged = F.when(F.count("*").over(clash) > 1, F.concat(name, F.lit(" ("), tag, F.lit(")"))).otherwise(F.col(name))
    rows = rows.withColumn("out", tagged)
    k = F.row_number().over(Window.partitionBy(F.lower("out")).orderBy(order))
    return rows.withColumn("__k", k).withColumn("out", F.when(F.col("__k") > 1, F.concat("out", F.lit("-"), F.col("__k").cast("string"))).otherwise(F.col("out"))).drop("__k")
