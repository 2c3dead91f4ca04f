"""The search for loops against one over whole envelopes, start by start."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import beats as B
from cadenza.operators import loops as L
from cadenza.plans import audio
from cadenza.session import Workbench

from .test_chunks import drums, table

DATA = "/root/testdata/sf0.001"


def naive_loop(attack, kick, level, fps, beats, phase, bars):
    """(place, score, kicks) of the best window, each tried on its own."""
    beats, n, best = np.asarray(beats, float), len(attack), (-1, -1.0, [])
    near, around, late = max(1, round(0.025 * fps)), max(1, round(0.05 * fps)), B.ATTACK_LATENCY
    if n < 8:
        return best
    for j in range(phase % 4, len(beats) - 4 * bars, 4):
        win = beats[j : j + 4 * bars + 1]
        if win[0] < 0 or win[-1] * fps >= n:
            continue
        hits = kick[np.clip(((win[:-1] + late) * fps).astype(int), 0, n - 1)]
        mean = hits.mean()
        even = 0.0 if mean <= 0 else mean / (1 + hits.std() / max(mean, 1e-9)) * (0.25 + 0.75 * min(hits.min() / max(mean, 1e-9), 1))
        a, b = int(win[0] * fps), int(win[-1] * fps)
        on = 0.0
        for t, u in zip(win[:-1], win[1:], strict=True):
            for k in range(4):
                c = round(float(t + (u - t) * k / 4 + late) * fps)
                on += attack[max(a, c - near) : min(b, c + near + 1)].sum()
        total = attack[a:b].sum()
        lattice = min(on / total, 1) if total > 0 else 0.0
        loud = level[a:b].mean()
        quiet = np.percentile(level[a:b], 5) / max(loud, 1e-9)
        score = even * (0.4 + 0.6 * lattice) * loud * (0.3 + 0.7 * min(quiet, 1))
        if score > best[1] + 1e-12:
            usual, times = np.median(hits), []
            for t in win[:-1]:
                c = round(float(t + late) * fps)
                lo, hi = max(0, c - around), min(n, c + around + 1)
                k = lo + int(attack[lo:hi].argmax())
                there = kick[lo:hi].max() >= 0.35 * usual and k not in (lo, hi - 1)
                times.append(k / fps - late - win[0] if there else t - win[0])
            best = (j, score, times)
    return best


def whole(rows, names=None):
    """Arrays by track from envelopes in chunks."""
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["start"]):
        out.setdefault(r["track_id"], []).append(np.array([[v[n] for n in names] for v in r["values"]] if names else r["values"], float))
    return {k: np.concatenate(v) for k, v in out.items()}


def envelopes(spark, tracks, names, size):
    rows = [(t, 8000, k, [dict(zip(names, v, strict=True)) for v in x[k : k + size].tolist()]) for t, x in tracks.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, f"track_id string, sr int, start long, values array<struct<{', '.join(n + ': double' for n in names)}>>").repartition(3)


@pytest.mark.parametrize("cell,size", [(64, 50), (1000, 333), (1 << 14, 1 << 14)])
def test_loops_equal_the_search_start_by_start(spark, cell, size):
    rng = np.random.default_rng(cell)
    frames, fps, names = B.Frames(attack_hop=80, cell=cell), 100.0, ("attack", "kick", "low", "snare")
    tracks, levels, beats, phases = {}, {}, {}, {}
    for k, n in enumerate((1600, 1601, 900, 240, 7, 1200, 1500)):
        t = f"r{k}"
        tracks[t], levels[t] = np.maximum(0, rng.normal(size=(n, 4))), rng.random(n)
        beats[t] = (0.3 + np.cumsum(0.45 + 0.1 * rng.random(int(n / 50)))).tolist()
        phases[t] = int(rng.integers(0, 4))
    tracks["r5"][:], levels["r5"][:] = 0.0, 0.0  # silence: the first window of equal ones
    levels["r1"] = levels["r1"][:-400]  # frames without a level are silent
    beats["r2"] = [-0.4, *(b for b in beats["r2"] if b < 8.6), 8.99, 9.5]
    beats["r6"] = beats["r6"][:5]
    fine, level = envelopes(spark, tracks, names, size), spark.createDataFrame([(t, 8000, k, x[k : k + size].tolist()) for t, x in levels.items() for k in range(0, len(x), size)], "track_id string, sr int, start long, values array<double>")
    grid = spark.createDataFrame([(t, 8000, k, float(s)) for t, b in beats.items() for k, s in enumerate(b)], "track_id string, sr int, place int, seconds double").repartition(3)
    of = spark.createDataFrame(list(phases.items()), "track_id string, phase int")
    found = Workbench(spark).put(L.evidence(fine, level, grid, frames))
    got = {(r["track_id"], r["bars"]): r for r in L.best_loops(found, of, (1, 2, 4)).collect()}
    assert len(got) == 3 * len(tracks)
    for (t, bars), r in got.items():
        silent = np.concatenate([levels[t], np.zeros(len(tracks[t]) - len(levels[t]))])
        place, score, kicks = naive_loop(tracks[t][:, 0], tracks[t][:, 1], silent, fps, beats[t], phases[t], bars)
        assert r["place"] == place and np.isclose(r["score"], score) and np.allclose(r["kicks"], kicks), (t, bars, r, place, score)
    late = {(r["track_id"], r["bars"]): r for r in L.best_loops(found, of, (2,), F.col("begin") > 5).collect()}
    assert all(r["place"] == -1 or r["begin"] > 5 for r in late.values()) and late["r0", 2]["place"] > 0 and late["r3", 2]["score"] == -1
    assert L.best_loops(found.limit(0), of.limit(0)).count() == 0


def test_levels(spark):
    frames = B.Frames(size=256, attack_hop=32)
    x = {"a": np.random.default_rng(1).normal(size=5000), "b": np.ones(256), "short": np.ones(100), "silent": np.zeros(600)}
    for size, cell in ((700, 512), (5000, 1 << 14)):
        got = whole(L.levels(table(spark, x, size), Workbench(spark), frames, cell))
        assert set(got) == {"a", "b", "silent"}
        for t in got:
            want = np.array([np.sqrt((x[t][k : k + 256] ** 2).mean()) for k in range(0, len(x[t]) - 255, 32)])
            assert np.allclose(got[t], want / (want.max() or 1)), t


def test_the_full_bars_are_chosen(spark):
    """Of a track whose drums stop for two bars the loop is taken from the part without the hole, whatever the chunks."""
    rate, bpm = 22_050, 120
    x = drums(bpm, 24, rate)
    x[int(6.3 * rate) : int(10.3 * rate)] *= 0.01
    beats = spark.createDataFrame([("t", rate, k, 0.3 + k * 0.5) for k in range(47)], "track_id string, sr int, place int, seconds double")
    phases = spark.createDataFrame([("t", 0)], "track_id string, phase int")
    places = set()
    for size, cell in ((1 << 14, 1 << 15), (1 << 20, 1 << 20)):
        r = L.looped(table(spark, {"t": x}, size, 0, rate), beats, phases, (4,), cell=cell).collect()[0]
        assert r["begin"] >= 10.3 and r["end"] - r["begin"] == pytest.approx(8.0) and len(r["kicks"]) == 16
        assert np.abs(np.array(r["kicks"]) - 0.5 * np.arange(16)).max() < 0.02
        places.add((r["place"], round(r["score"], 9)))
    assert len(places) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_loop_search(spark):
    bench, rows = Workbench(spark), audio.clips(spark, DATA)
    fine = whole(B.fine_envelopes(rows, bench, audio.FRAMES, audio.CELL), ("attack", "kick"))
    level = whole(L.levels(rows, bench, audio.FRAMES, audio.CELL))
    grid, found = B.grids(rows, audio.FRAMES, audio.CELL)
    times = {}
    for r in found.orderBy("track_id", "place").collect():
        times.setdefault(r["track_id"], []).append(r["seconds"])
    got = {}
    for r in audio.loop_search(spark, DATA).orderBy("track_id", "bars", "beat").collect():
        got.setdefault((r["track_id"], r["bars"]), []).append(r)
    phases = {r["track_id"]: r["phase"] for r in grid.collect()}
    assert set(got) == {(t, b) for t in phases for b in (1, 2, 4)} and any(r[0]["place"] >= 0 for r in got.values())
    for (t, bars), r in got.items():
        n = len(fine[t])
        own = np.concatenate([level[t], np.zeros(n)])[:n]
        place, score, kicks = naive_loop(fine[t][:, 0], fine[t][:, 1], own, 100.0, times.get(t, []), phases[t], bars)
        assert r[0]["place"] == place and abs(r[0]["score"] - score) < 2e-6 and (place < 0 or np.allclose([k["kick"] for k in r], kicks, atol=2e-6)), (t, bars)
