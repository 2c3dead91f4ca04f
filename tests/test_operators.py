"""Operators on small tables with results worked out by hand or by brute force."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions import keys, numeric, records, titles
from cadenza.operators import beats, folds, lattice, matching, scoring, signal


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_numeric(spark):
    lit = F.lit
    assert one(spark, numeric.ramp(lit(5.0), 0, 10), numeric.ramp(lit(5.0), 10, 0), numeric.ramp(lit(99.0), 0, 10), numeric.ramp(lit(1.0), 3, 3)) == (0.5, 0.5, 1.0, 0.0)
    assert one(spark, numeric.duration_fit(lit(None).cast("double")), numeric.duration_fit(lit(200.0)), numeric.bar_of(lit(4.1), lit(2.0)), numeric.bar_of(lit(4.1), lit(0.0))) == (0.6, 1.0, 3, 0)
    assert one(spark, numeric.tempo_reading(lit(62.0), lit(124.0))["multiple"], numeric.tempo_reading(lit(248.0), lit(124.0))["multiple"], numeric.house_tempo(lit(62.0))) == (2.0, 0.5, 124.0)
    assert one(spark, *(numeric.length_seconds(lit(x)) for x in ("4:30", "270", "4m30s", "x"))) == (270.0, 270.0, 270.0, None)
    assert one(spark, numeric.clock(lit(65.9)), numeric.decibels(lit(1.0)), numeric.decibels(lit(0.0)), numeric.note_hz(lit(9), lit(4))) == ("1:05", 0.0, -120.0, 440.0)


def test_keys(spark):
    lit = F.lit
    for pc in range(12):
        for minor in (True, False):
            code = f"{(keys.MINOR if minor else keys.MAJOR)[pc]}{'A' if minor else 'B'}"
            key = one(spark, keys.key_of(lit(code.lower() + " ")), keys.code_of(lit(pc), lit(minor)))
            assert (key[0]["pitch_class"], key[0]["minor"], key[1]) == (pc, minor, code)
    assert one(spark, keys.key_of(lit("13A")), keys.key_of(lit("x")), keys.neighbours(lit("12A")), keys.neighbours(lit("1B"))) == (None, None, ["12A", "1A", "11A", "12B"], ["1B", "2B", "12B", "1A"])
    assert one(spark, keys.semitone_shift(lit(0), lit(6)), keys.semitone_shift(lit(0), lit(7)), keys.nearest_compatible(lit("8A"), lit("8A")), keys.nearest_compatible(lit("8A"), lit("3A"))) == (6, -5, 0, 1)


def test_titles(spark):
    p = one(spark, titles.parsed(F.lit("Some Artist - A Track (feat. Guest) [Mira Koss & Novak Extended Remix] | FREE DOWNLOAD.mp3")))[0]
    assert (p["artist"], p["track"], p["remixer"], p["kind"], p["feat"], p["ambiguous"]) == ("Some Artist", "A Track", "Mira Koss & Novak", "remix", "Guest", False)
    p = one(spark, titles.parsed(F.lit("Only A Name (Extended Mix)")))[0]
    assert (p["artist"], p["track"], p["remixer"], p["kind"], p["ambiguous"]) == ("", "Only A Name", "", "mix", True)
    assert one(spark, titles.normalised(F.lit("a_b_c – d.mp3")), titles.tokens(F.lit("Beyoncé (Official Video)")), titles.slug(F.lit("A b-C"))) == ("a b c - d", ["beyonce"], "abc")
    assert one(spark, titles.similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), titles.similarity(F.array().cast("array<string>"), F.array(F.lit("a")))) == (0.5, 0.0)


def test_records(spark):
    cases = {"http://youtu.be/x": (None, "youtube"), "https://www.a.org/": (None, "a.org"), "ftp://a.org": ("scheme", "a.org"), "http://localhost/": ("local", "localhost"), "http://192.168.0.1/": ("local", "192.168.0.1"), "http://[::1]/": ("local", "::1"), "": ("empty", "link"), "http://2130706433/": ("local", "2130706433"), "http://u@8.8.8.8:80/": (None, "8.8.8.8")}
    for url, want in cases.items():
        assert one(spark, records.link_problem(F.lit(url)), records.site(F.lit(url))) == want, url
    assert one(spark, records.reply_object(F.lit('```json\n{"a": 1}\n```')), records.reply_object(F.lit("none")), records.score_100(F.lit("0.5")), records.score_100(F.lit("inf")), records.score_100(F.lit("300"))) == ('{"a": 1}', None, 50.0, 0.0, 100.0)
    assert one(spark, records.moment(F.lit("-1")), records.moment(F.lit("2.00049")), records.moment(F.lit(9.0), F.lit(5.0)), records.author(F.lit(" A b!")), records.author(F.lit(None))) == (None, 2.0, 5.0, "a-b", "listener")


def test_phase_and_quantiles(spark):
    rows = spark.createDataFrame([(t,) for t in (0, 5, 50, 51, 99, -1)], "t long")
    assert [r[0] for r in rows.select(lattice.phase_error(F.col("t"), 100)).collect()] == [0, 5, 50, -49, -1, -1]
    rng = random.Random(1)
    data = [(k % 3, k, rng.random(), rng.random()) for k in range(60)] + [(9, 99, 0.25, 1.0)]
    got = {r["g"]: r for r in lattice.weighted_quantiles(spark.createDataFrame(data, "g long, o long, v double, w double"), ["g"], "v", "w", "o", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    for g in (0, 1, 2, 9):
        own = sorted((v, w) for h, _, v, w in data if h == g)
        v, w = np.array(own).T
        for name, q in (("lo", 0.0), ("mid", 0.5), ("hi", 1.0)):
            assert abs(got[g][name] - np.interp(q * w.sum(), np.cumsum(w) - w / 2, v)) < 1e-9


def test_free_phase(spark):
    rows = spark.createDataFrame([(1, t, 1.0) for t in (95, 105, 203, 350)], "g long, t long, w double")
    assert lattice.free_phase_fraction(rows, ["g"], "t", "w", 100, 5).first()["fraction"] == 0.75


def test_matching_against_brute_force(spark):
    rng = random.Random(2)
    left = [(k, rng.randint(0, 2), rng.randint(0, 200)) for k in range(80)]
    right = [(rng.randint(0, 1), rng.randint(0, 200), k) for k in range(25)]
    a, b = spark.createDataFrame(left, "id long, g long, t long"), spark.createDataFrame(right, "g long, t long, r long")
    back = {r["id"]: r["r"] for r in matching.asof_backward(a, b, ["g"], "t", ["r"]).collect()}
    near = {r["id"]: (r["r"], r["distance"]) for r in matching.nearest(a, b, ["g"], "t", ["r"]).collect()}
    for k, g, t in left:
        own = [(s, r) for h, s, r in right if h == g]
        assert back[k] == max(((s, r) for s, r in own if s <= t), default=(None, None))[1]
        assert near[k][1] == (t - min(own, key=lambda x: (abs(x[0] - t), x[0]))[0] if own else None)
    spans = [(s, s + rng.randint(0, 30), k) for k, s in enumerate(range(0, 200, 17))]
    got = {(r["id"], r["k"]) for r in matching.interval_join(a, spark.createDataFrame(spans, "s long, e long, k long"), "t", "s", "e", 10, how="inner").collect()}
    assert got == {(i, k) for i, _, t in left for s, e, k in spans if s <= t < e}
    live = matching.concurrency(spark.createDataFrame([(1, s, e) for s, e, _ in spans], "g long, s long, e long"), ["g"], "s", "e").collect()
    assert all(r["live"] == sum(s <= r["start"] and r["end"] <= e for s, e, _ in spans) for r in live)


def test_warp(spark):
    points = spark.createDataFrame([(1, t) for t in (-5, 0, 5, 10, 15, 99)], "g long, t long")
    knots = spark.createDataFrame([(1, 0, 0.0), (1, 10, 100.0), (1, 20, 110.0)], "g long, x long, y double")
    got = {r["t"]: r["w"] for r in matching.mapped(points, knots, ["g"], "t", "x", "y", "w").collect()}
    assert got == {-5: 0.0, 0: 0.0, 5: 50.0, 10: 100.0, 15: 105.0, 99: 110.0}


def test_folds(spark):
    runs = folds.islands(spark.createDataFrame([(1, t) for t in (0, 3, 6, 20, 40, 41, 45)], "g long, t long"), ["g"], "t", 4, 2)
    assert sorted((r["start"], r["end"], r["n"]) for r in runs.collect()) == [(0, 6, 3), (40, 45, 3)]
    flow = folds.key_flow(spark.createDataFrame([(1, 1, "8A"), (1, 2, "3A"), (1, 3, "??"), (1, 4, "8B"), (2, 1, None)], "s long, o long, c string"), "s", "o", "c")
    assert [(r["s"], r["shift"], r["code"], r["compatible"]) for r in flow.orderBy("s", "o").collect()] == [(1, 0, "8A", True), (1, -1, "8A", True), (1, 0, "??", False), (1, 0, "8B", True), (2, 0, "", False)]
    peaks = folds.greedy_apart(spark.createDataFrame([(1, t, v) for t, v in ((0, 1.0), (4, 5.0), (8, 4.0), (14, 4.0), (30, 0.5))], "g long, t long, v double"), "g", "t", "v", 5)
    assert sorted(r["t"] for r in peaks.collect()) == [4, 14, 30]
    names = folds.unique_names(spark.createDataFrame([(1, "A", "x"), (2, "a", "x"), (3, "b", "y")], "k long, n string, f string"), "n", "f", "k")
    assert [r["out"] for r in names.orderBy("k").collect()] == ["A (x)", "a (x)-2", "b"]
    upsert = folds.upserted(spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, None)], "k string, t long, x string"), "k", ["t"], "t", ["x"])
    assert sorted(tuple(r) for r in upsert.collect()) == [("u", 1, 2, 2, "b"), ("v", 3, 3, 1, None)]


def test_scores(spark):
    lit = F.lit
    good = {"groove": lit(80.0), "similarity": lit(None).cast("double"), "clarity": lit(50.0), "clicks": lit(100.0), "vocal": lit(60.0), "loudness": lit(70.0)}
    mean, score = one(spark, *scoring.total(good))
    assert abs(mean - (0.3 * 80 + 0.18 * 50 + 0.1 * 230) / 0.78) < 1e-9 and score == mean
    assert one(spark, scoring.total(good | {"groove": lit(0.0)})[1], scoring.headline(lit(82.0)), scoring.headline(lit(10.0)), scoring.pair_verdict(lit(0.6), lit(0.13))) == (30.0, 0, 4, "review")
    rows = spark.createDataFrame([(1, b, x, p) for b, x, p in ((120.0, 30.0, True), (124.0, 2.0, False), (126.0, 44.0, True))], "g long, bpm double, bars double, p boolean")
    r = scoring.profile(rows, ["g"], "bpm", "bars", "p", []).first()
    assert (r["n"], r["bpm"], r["bars"], round(r["ratio"], 6)) == (3, 124.0, 32, 0.666667) and abs(r["bpm_spread"] - statistics.pstdev([120, 124, 126])) < 1e-9


def clicks(bpm, seconds=12, rate=8000):
    x = np.zeros(seconds * rate)
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate)
        x[at : at + 200] += np.hanning(400)[200:][: len(x[at : at + 200])] * np.sin(np.arange(200))[: len(x[at : at + 200])]
    return x


def test_signal(spark):
    data = []
    for bpm in (90.0, 124.0, 140.0):
        x = clicks(bpm)
        parts = np.array_split(x, 4)
        data += [(str(bpm), 8000, k, sum(map(len, parts[:k])), [float(v) for v in part]) for k, part in enumerate(parts)]
    got = {r["track_id"]: r for r in beats.track_measures(spark.createDataFrame(data, "track_id string, sr int, chunk int, start_sample long, samples array<float>")).collect()}
    for bpm in (90.0, 124.0, 140.0):
        assert abs(got[str(bpm)]["bpm"] - bpm) < 2.0 and abs(got[str(bpm)]["seconds"] - 12) < 1e-6
    t = np.arange(8000 * 3) / 8000
    assert signal.chroma(np.sin(2 * np.pi * 440 * t), 8000).mean(axis=1).argmax() == 9
    assert signal.tempo(np.zeros(500), 100) == 0.0 and abs(signal.autocorrelation(np.sin(np.arange(1000)))[0] - 1) < 1e-9
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    target = unit(rng.normal(size=(80, 6)))
    assert signal.subsequence_cost(target[20:50], target) < 1e-9 < 0.1 < signal.subsequence_cost(unit(rng.normal(size=(30, 6))), target)


def test_alignment_takes_every_row(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    reference, sizes = rng.normal(size=(20, 6)), {1: 407, 2: 5, 3: 15, 4: 1, 5: 40}  # 407 rows are more than 20 can take at once
    rows = {g: rng.normal(size=(n, 6)) for g, n in sizes.items()}
    data = [(g, k, v.tolist()) for g, own in rows.items() for k, v in enumerate(own)]
    random.Random(3).shuffle(data)
    got = {r["g"]: r for r in signal.aligned(spark.createDataFrame(data, "g int, k long, v array<double>"), reference, "g", "k", "v").collect()}
    assert {g: r["n"] for g, r in got.items()} == sizes
    for g, own in rows.items():
        costs = sorted(signal.subsequence_cost(unit(p), unit(reference)) for p in np.array_split(own, max(1, round(len(own) / 10))))
        want = np.mean(costs[: int(np.ceil(0.6 * len(costs)))])
        assert np.isfinite(want) and abs(got[g]["cost"] - want) < 2e-6 and abs(got[g]["score"] - (1 - 2 * want)) < 2e-6


def test_dtw_align_reads_the_whole_table(spark):
    from cadenza.plans.catalogue import QUERIES

    data = "/root/testdata/sf0.001"
    want = {r["label"]: r["count"] for r in spark.read.parquet(f"{data}/embeddings.parquet").groupBy("label").count().collect()}
    assert {r["label"]: r["n"] for r in QUERIES["dtw_align"](spark, data).collect()} == want


def test_groups_of_long_chains(spark, tmp_path):
    nodes = spark.createDataFrame([(k,) for k in (*range(40), 50, 60, 61, None)], "node int")
    links = [(k, k + 1) if k % 3 else (k + 1, k) for k in range(39)] + [(61, 60), (61, 60), (50, 50)]
    random.Random(4).shuffle(links)
    got = {r["node"]: r["group"] for r in folds.smallest_reached(nodes, spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {k: 0 for k in range(40)} | {50: 50, 60: 60, 61: 60, None: None}
    from cadenza.plans.catalogue import QUERIES

    # a chain of nine links of length 1 that ends in eleven labels at one place: its links are among the shortest 30 %
    rows = [(k, [float(min(k, 9)), 0.0], k) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["label"]: r["group"] for r in QUERIES["section_distance_groups"](spark, str(tmp_path)).collect()} == {k: 0 for k in range(20)}
