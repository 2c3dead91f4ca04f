"""Queries on rows that the small tables don't have, against their SQL, and operators at sizes at which they were once too slow."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import arrangement, chunks, folds
from cadenza.plans.catalogue import ORACLES, QUERIES
from tests.test_queries import plain


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query on given tables (name: DuckDB query), after they were held against its SQL."""

    def run(name: str, **tables: str):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        got = df.select(*columns).collect()
        assert sorted(repr(tuple(map(plain, r))) for r in got) == sorted(repr(tuple(map(plain, r))) for r in cursor.fetchall())
        return got

    return run


def test_template_match_carry_takes_days_of_no_weight(against_sql):
    rows = "(0, 0, 'click', 0.0), (1, 1, 'view', 3.0), (2, 1, 'click', 2.9), (3, 2, 'click', 0.0), (4, 2, 'buy', 0.0), (5, 3, 'view', 1.0), (6, 4, 'buy', -1.0), (7, 4, 'view', 0.0), (8, 5, 'buy', NULL)"
    got = against_sql("template_match_carry", events=f"SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01 01:00:00' + INTERVAL 1 DAY * d AS ts, 7::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {rows}) AS x(i, d, k, v)")
    assert [r["chord"] for r in sorted(got, key=lambda r: r["bar"])] == ["click", "click", "buy", "view", "view", "view"]


def test_template_match_carry_adds_in_the_order_of_events(spark, tmp_path):
    """Leads of just a quarter hang on the last bit of the sums, and here the first event of each kind is in a file of its own."""
    days = [
        ((2.55, 57.92, 61.21), (91.26,)), ((23.1, 12.73, 102.69), (38.34, 42.36, 23.19)), ((70.92,), (28.41, 16.93, 7.73, 0.12)), ((103.84,), (5.59, 56.65, 8.05, 7.59)),
        ((1.52, 34.39, 21.41), (42.99,)), ((149.52,), (57.46, 7.75, 46.93)), ((92.77, 38.87), (30.84, 45.46, 22.43)), ((59.8, 5.46, 24.14), (67.05,)),
    ]
    events = [(place, user, kind, x) for user, kinds in enumerate(days) for kind, xs in zip(("view", "click"), kinds) for place, x in enumerate(xs)]
    con, folder = duckdb.connect(), tmp_path / "events.parquet"
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")
    folder.mkdir()
    for part, rows in enumerate(([e for e in events if e[0] == 0], [e for e in events if e[0] > 0])):
        rows = ", ".join(f"({p}, {u}, '{k}', {x})" for p, u, k, x in rows)
        con.execute(f"COPY (SELECT (1000 * p + 10 * u + (k = 'view')::INT)::BIGINT AS event_id, TIMESTAMP '2024-01-01 01:00:00' + INTERVAL 1 HOUR * p AS ts, u::BIGINT AS user_id, k AS event_type, x::DOUBLE AS value, '' AS props FROM (VALUES {rows}) AS x(p, u, k, x)) TO '{folder}/{part}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet' ORDER BY event_id")
    got = {r["user_id"]: r["chord"] for r in QUERIES["template_match_carry"](spark, str(tmp_path)).collect()}
    assert got == {u: chord for u, _, chord in con.execute(ORACLES["template_match_carry"]).fetchall()}
    assert [got[u] for u in range(8)] == ["view", "none", "none", "view", "view", "none", "view", "none"]


def test_template_match_carry_before_1970_and_without_a_kind(against_sql):
    rows = "(0, '1969-12-31 12:00:00', 'view', 1.0), (1, '1970-01-01 12:00:00', 'click', 2.0), (2, '1970-01-02 12:00:00', NULL, 0.0), (3, '1970-01-02 13:00:00', 'buy', 0.0), (4, '1970-01-03 12:00:00', NULL, 5.0)"
    got = against_sql("template_match_carry", events=f"SELECT i::BIGINT AS event_id, t::TIMESTAMP AS ts, 7::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {rows}) AS x(i, t, k, v)")
    assert [(r["bar"], r["chord"]) for r in sorted(got, key=lambda r: r["bar"])] == [(0, "click"), (1, "buy"), (2, "buy")]


def test_forms_of_fixed_parts_and_far_lengths(spark):
    rows = spark.createDataFrame([(0, [("build", 8), ("break", 4)], 40), (1, [("intro", 0), ("build", 8), ("outro", 0)], 1000), (2, [("intro", 16), ("drop", 16)], 36), (3, [("intro", 16), ("drop", 16)], 60), (4, [], 8)], "k int, parts array<struct<kind:string,bars:int>>, bars int")
    got = {r["k"]: [x["bars"] for x in r["p"]] for r in rows.select("k", arrangement.scaled(F.col("parts"), F.col("bars")).alias("p")).collect()}
    assert got == {0: [8, 4], 1: [984, 8, 8], 2: [16, 16], 3: [24, 40], 4: []}


def test_many_forms_are_scaled_in_time(spark):
    n, k = 24_000, F.col("id")
    forms = arrangement.form(F.when(k % 3 == 0, "club").when(k % 3 == 1, "radio").otherwise("tool"))
    plans = spark.range(0, n, 1, 1).select("id", forms.alias("form"), (60.0 + k % 500).alias("seconds"), (240.0 / (120 + k % 9)).alias("bar"))
    plans = plans.select("id", arrangement.for_length(F.col("form"), F.col("seconds"), F.col("bar")).alias("parts"))
    begin = time.monotonic()
    assert arrangement.laid_out(plans).agg(F.sum((F.col("bars") % 8 == 0).cast("long"))).first()[0] == 7 * n
    assert time.monotonic() - begin < 30  # it was 3.7 ms a form, in one task


def _events(rows: str) -> str:
    """Events (user, minute, value)."""
    return f"SELECT row_number() OVER ()::BIGINT AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * m AS ts, u::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {rows}) AS x(u, m, v)"


def test_combs_hold_one_row_of_places_for_each_group(spark, against_sql, tmp_path):
    """User 1 has no weight at all, 2 has none near any offset, 3 has some below 0, 4 ties, 5 is on the half hour."""
    got = against_sql("layer_comb", events=_events("(1, 3, NULL), (1, 70, NULL), (2, 22, 4.0), (3, 0, -2.0), (3, 61, -1.5), (4, 5, 1.0), (4, 7, NULL), (4, 50, 1.0), (5, 30, 3.0), (5, 61, 1.0), (NULL, 4, 2.0)"))
    assert {r["user_id"]: (r["offset"], r["alignment"]) for r in got if r["user_id"] in (1, 2, 5)} == {1: (None, "offset"), 2: (-0.25, "offset"), 5: (0.016667, "half-beat")}
    # the 121 offsets are no rows: their sums were a table of groups x offsets in every task
    assert "Generate" not in QUERIES["layer_comb"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_layer_report_combs_without_rows_by_offset(spark, tmp_path):
    duckdb.connect().execute(f"COPY ({_events('(1, 3, NULL), (2, 22, 4.0), (2, 62, 1.0), (2, 200, 1.0)')}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["layer_report"](spark, str(tmp_path))
    assert "Generate" not in df._jdf.queryExecution().toString()
    assert {r["user_id"]: r["offset"] for r in df.collect()} == {1: None, 2: 0.033333}


def test_each_json_of_a_reply_is_parsed_once(spark, tmp_path):
    duckdb.connect().execute(f"COPY ({_events('(1, 3, 2.0), (2, 22, 4.0)')}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["json_issues"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 4 and df.count() == 4  # the reply, its list of issues, an issue, and the points of its comparison


def test_measures_of_cells_are_worked_out_once(spark):
    rows = [(t, 400, k * 64, np.random.default_rng(9 * t + k).normal(size=64).tolist()) for t in range(3) for k in range(40)]
    df = chunks.measured(spark.createDataFrame(rows, "track_id long, sr int, start_sample long, samples array<double>"), 64, 8, 4, 1024)
    assert "MapInArrow" not in df._jdf.queryExecution().toString() and df.count() == 3  # five steps read them, and each worked them out


def test_clicks_take_medians_at_once(monkeypatch):
    x, calls, median = np.random.default_rng(3).normal(size=3000), [], np.median
    monkeypatch.setattr(np, "median", lambda *a, **b: calls.append(1) or median(*a, **b))
    cell = chunks.Cell(x, 0, 0, len(x), len(x), 400.0, {})
    got = chunks.cell_clicks(cell, limits=(1.5, 2.0, 0.05), louder=9.0)
    assert 0 < len(calls) <= 4  # it was two for each of the jumps, which in noise are nearly all samples
    d = np.abs(np.diff(x))
    d_ = np.pad(d, 10, mode="edge")
    hit = [k for k in range(len(d)) if d[k] > 0.05 and d[k] / (median(d_[k + 9 : k + 12]) + 1e-6) > 1.5 and d[k] / (median(d_[k : k + 21]) + 1e-6) > 2.0]
    first = [k for j, k in enumerate(hit) if not j or k - hit[j - 1] > 2]
    level = lambda k: np.sqrt((x[k : k + 8] ** 2).sum())
    assert got.tolist() == [k for k in first if k >= 8 and k + 9 <= len(x) and level(k + 1) < 9.0 * level(k - 8)] and len(got) > 50


def test_greedy_choices_over_batches_runs_and_nulls(spark):
    rng = random.Random(7)
    rows = sorted({(g, rng.randrange(4000)): None for g in (None, 1, 2, 3) for _ in range(250)}, key=repr)
    rows = [(g, t, float(rng.randrange(9)), f"{g}:{t}") for g, t in rows]
    want = set()
    for g in (None, 1, 2, 3):
        taken: list[int] = []
        for _, t, _, name in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if all(abs(t - x) >= 12 for x in taken):
                taken.append(t)
                want.add(name)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (before, "7"):
            spark.conf.set(size, n)
            got = [r["name"] for r in folds.greedy_apart(spark.createDataFrame(rows, "g long, t long, v double, name string"), "g", "t", "v", 12, also=("name",)).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set(size, before)


def test_each_part_of_an_instruction_is_read_once(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE l_orderkey < 40) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df = QUERIES["plan_patches"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") <= 16 and df.count() > 0  # 13, eight of them in a filter on the index; it was 36, as each condition read its part anew


def test_layer_report_stores_its_measures(spark, tmp_path):
    duckdb.connect().execute(f"COPY ({_events('(1, 3, 1.0), (2, 22, 4.0), (2, 62, 1.0)')}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES["layer_report"](spark, str(tmp_path))
    assert "Window" not in df._jdf.queryExecution().toString() and df.count() == 2  # one task held the sorted rows of all measures


def test_sections_are_picked_without_a_row_for_each_want(spark):
    rng = random.Random(5)
    some = lambda *c: rng.choice(c)
    columns = ("track", "o", "start", "end", "label", "energy")
    rows = [(some(None, 1, 2, 3, 4), some(None, 1, 2, 3), some(0.0, 10.0, None), some(30.0, 60.0, 90.0, None), some("hook", "verse", "section", "", None), some(0.0, 0.2, 0.9, 0.9, -0.1, None, float("nan"))) for _ in range(60)]
    rows = [*rows, *rows[:7], (5, 1, 0.0, 9.0, "section", 0.5), (5, 1, 0.0, 9.0, "section", 0.5)]  # sections that come twice
    df = arrangement.picked(spark.createDataFrame(rows, "track long, o long, start double, end double, label string, energy double"), "track", "o")

    up = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)  # noqa: E731  as Spark orders: nulls first, NaN last
    of = lambda x, f: None if x is None else f(x)

    def cost(want, _, __, start, end, label, energy):
        length = 40.0 if start is None or end is None else min(end - start, 40.0)  # least() passes nulls over
        other = {"drop": of(label, lambda x: x != "hook"), "breakdown": of(label, lambda x: x not in ("verse", "breakdown", "intro")), "intro": False}[want]
        return other, of(energy, lambda x: -x * length) if want == "drop" else energy

    want = set()
    for track in (None, 1, 2, 3, 4, 5):
        for w in ("drop", "breakdown", "intro"):
            best = min((r for r in rows if r[0] == track), key=lambda r: [up(x) for x in (*cost(w, *r), *r[1:])])
            want.add(repr((track, w, *best[1:])))
    assert df.columns == [columns[0], "want", *columns[1:]] and dict(df.dtypes)["energy"] == "double"
    got = [repr(tuple(r)) for r in df.collect()]
    assert len(got) == 18 and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan[plan.index("Aggregate") :]  # three rows for each section were sorted, on both sides of the shuffle
