"""Syllables against whole recordings, and suppression between layers against all pairs."""

import os

import numpy as np
import pytest

from cadenza.operators import layers as L
from cadenza.operators import loops
from cadenza.plans import audio

from .test_chunks import table
from .test_loops import whole

DATA = "/root/testdata/sf0.001"


def naive_syllables(x, rate, size, hop):
    """{frame: strength}: levels smoothed by a fitted parabola each, and the strongest rises one after another."""
    level = np.array([np.sqrt((x[k : k + size] ** 2).mean()) for k in range(0, len(x) - size + 1, hop)])
    n = len(level)
    if n < 9:
        return {}
    smooth = []
    for k in range(n):
        begin = min(max(k - 3, 0), n - 7)
        smooth.append(np.polyval(np.polyfit(np.arange(begin, begin + 7) - k, level[begin : begin + 7], 2), 0))
    rise = np.maximum(0, np.diff(smooth, prepend=smooth[0]))
    if not (rise > 1e-12).any():
        return {}
    least = max(0.1 * np.percentile(rise[rise > 0], 95), 1e-9)
    peaks = [k for k in range(1, n - 1) if rise[k - 1] < rise[k] > rise[k + 1] and rise[k] >= least]
    taken = []
    for k in sorted(peaks, key=lambda k: -rise[k]):
        if all(abs(k - t) >= max(1, int(0.1 * rate / hop)) for t in taken):
            taken.append(k)
    return {k: rise[k] for k in taken}


def compare(rows, x, rate, size, hop):
    got = {}
    for r in rows:
        got.setdefault(r["track_id"], {})[r["frame"]] = (r["seconds"], r["strength"])
    for t, y in x.items():
        want, own = naive_syllables(y, rate, size, hop), got.get(t, {})
        assert own.keys() == want.keys(), t
        for k, v in want.items():
            assert np.allclose(own[k], ((k * hop + (size - hop) / 2) / rate, v), atol=2e-6)
    return got


@pytest.mark.parametrize("chunk,cell,frames", [(3000, 4096, 64), (1 << 20, 1 << 20, 1 << 12)])
def test_syllables_do_not_depend_on_the_chunks(spark, chunk, cell, frames):
    rate, rng = 8000, np.random.default_rng(4)
    voice = 0.001 * rng.normal(size=6 * rate)
    places = [0.5 + 0.31 * k for k in range(16)]
    for p in places:
        voice[int(p * rate) : int(p * rate) + 1200] += np.hanning(1200) * rng.normal(size=1200)
    x = {"voice": voice, "noise": rng.normal(size=30_001), "silent": np.zeros(9000), "short": rng.normal(size=2900), "tiny": rng.normal(size=40), "nine": rng.normal(size=1024 + 8 * 256)}
    got = compare(L.syllables(table(spark, x, chunk, 10, rate), cell=cell, frames=frames).collect(), x, rate, 1024, 256)
    strong = [s for s, v in got["voice"].values() if v > 0.2 * max(v for _, v in got["voice"].values())]
    assert len(strong) == len(places) and set(got) <= {"voice", "noise", "nine"}
    off = np.sort(strong) - np.array(places)  # a level's window is 0.128 s long, and a swell comes into it at its end
    assert np.abs(off).max() < 0.128 and off.std() < 0.03


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_syllable_times(spark):
    from pyspark.sql import functions as F

    x = whole(audio.clips(spark, DATA).select("track_id", F.col("start_sample").alias("start"), F.col("samples").alias("values")))
    assert len(compare(audio.syllable_times(spark, DATA).collect(), x, 400, 32, 8)) == len(x)


@pytest.mark.parametrize("tolerance,block", [(0.5, None), (2.0, 3.0), (0.0, 1.0), (5.0, 1.0)])
def test_suppression_equals_all_pairs(spark, tolerance, block):
    rng = np.random.default_rng(9)
    make = lambda n: [(str(rng.choice(["a", "a", "a", "b", "c"])), float(np.round(rng.random() * 40 - 5, 1)), k) for k in range(n)]
    rows = [*make(200), ("a", 1.0, 900), ("a", 1.0, 900), (None, 1.0, 901), ("a", None, 902), ("d", 3.0, 903)]
    others = [*[(k, t, n) for k, t, n in make(25) if k != "c"], (None, 1.0, 1), ("a", None, 1), ("b", 7.0, 1), ("b", 7.0, 1)]
    schema = "layer string, t double, __t int"  # a column of the name that the operator has for its own
    got = L.apart_from(spark.createDataFrame(rows, schema), spark.createDataFrame(others, schema), "layer", "t", tolerance, block)
    want = [r for r in rows if r[0] is None or r[1] is None or not any(o[0] == r[0] and o[1] is not None and abs(o[1] - r[1]) <= tolerance for o in others)]
    assert got.columns == ["layer", "t", "__t"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert L.apart_from(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), "layer", "t", tolerance, block).count() == len(rows)


def test_kicks_of_a_repeated_loop(spark):
    rows = [("x", 100, 1000, 48_000, 96_000, [0.0, 0.5, 1.4999]), ("late", 48_000, 200_000, 48_000, 96_000, [0.25]), ("back", 0, 10, 10, 4, [-0.1, 0.05]), ("none", 0, 10, 10, 4, []), ("null", 0, 10, 10, 4, None), ("zero", 0, 10, 10, 0, [0.1])]
    spans = spark.createDataFrame(rows, "name string, low long, high long, sr int, period int, kicks array<double>")
    got = {}
    for r in loops.repeated(spans).collect():
        got.setdefault(r["name"], []).append(r["seconds"])
    want = {}
    for name, low, high, sr, period, kicks in rows:
        found = [k * period / sr + o for k in range(low // period, -(-high // period) + 1) for o in kicks if low <= (k * period / sr + o) * sr < high] if period and kicks else []
        if found:
            want[name] = found
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and "late" in got
