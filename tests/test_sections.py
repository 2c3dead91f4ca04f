"""Sections against the same steps over whole recordings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import beats as B
from cadenza.operators import sections as X
from cadenza.operators import spectra as S
from cadenza.plans import audio

from .test_chunks import table
from .test_loops import whole

DATA = "/root/testdata/sf0.001"


def whole_features(x, rate, size, hop, chroma):
    power = S.reduced(x, lambda m: m * m, chroma, hop)
    hertz = np.fft.rfftfreq(chroma, 1 / rate)
    classes = np.zeros((12, power.shape[1]))
    for k, h in enumerate(hertz):
        if 55 <= h <= 2093:
            classes[round(69 + 12 * np.log2(h / 440)) % 12] += power[k]
    classes = np.sqrt(classes)
    classes = classes / np.maximum(classes.sum(axis=0), 1e-9)
    mel = np.log1p(1000 * (S.mel_bank(rate, size, 40) @ S.reduced(x, lambda m: m, size, hop)))
    return np.concatenate([classes, S.cosines(13, 40) @ mel])


def whole_novelty(found, half):
    rows = (found - found.mean(axis=1, keepdims=True)) / np.maximum(found.std(axis=1, keepdims=True), 1e-9)
    rows[12:] *= 0.5
    return S.novelty_curve(S.stacked(rows), half)


def naive_bounds(curve, fps, seconds, bar, downs, least_bars):
    bars = max(1, int(seconds / bar))
    least = min(2 * least_bars, max(least_bars, bars // 8)) * bar
    height = np.percentile(curve[curve > 0], 55) if (curve > 0).any() else 0.0
    peaks = [k for k in range(1, len(curve) - 1) if curve[k - 1] < curve[k] > curve[k + 1] and curve[k] >= height]
    taken = []
    for k in sorted(peaks, key=lambda k: -curve[k]):
        if all(abs(k - t) >= max(2, round(least * fps)) for t in taken):
            taken.append(k)
    times = {min(downs, key=lambda d: abs(d - k / fps)) if len(downs) else k / fps for k in taken}
    bounds = sorted({0.0, *map(float, times), seconds})
    kept = bounds[:1]
    for b in bounds[1:]:
        if b - kept[-1] >= 0.9 * least or b == bounds[-1]:
            kept.append(b)
    if len(kept) > 2 and kept[-1] - kept[-2] < 0.9 * least:
        kept.pop(-2)
    return kept


def naive_sections(x, rate, found, bounds, hop):
    """(group, energy, level) of each section, groups by a walk over near ones."""
    vectors, levels = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = found[:, int(a * rate / hop) : max(int(b * rate / hop), int(a * rate / hop) + 1)].mean(axis=1)
        vectors.append(np.concatenate([own[:12] / max(own[:12].sum(), 1e-9), own[12:] / max(np.abs(own[12:]).max(), 1e-9)]))
        levels.append(np.sqrt((x[int(a * rate) : int(b * rate)] ** 2).mean()))
    n = len(vectors)
    far = np.array([[np.linalg.norm(v - w) for w in vectors] for v in vectors])
    limit = np.percentile(far[np.triu_indices(n, 1)], 30) if n > 1 else 0.0
    groups = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            at = todo.pop()
            more = [j for j in range(n) if j not in seen and far[at, j] <= limit]
            seen.update(more)
            todo += more
        groups.append(min(seen))
    return groups, np.array(levels) / max(levels), np.array(levels)


def check(got, x, rate, found, bounds, hop):
    assert np.allclose([r["start"] for r in got], bounds[:-1], atol=2e-6) and np.allclose([r["end"] for r in got], bounds[1:], atol=2e-6)
    groups, energy, level = naive_sections(x, rate, found, bounds, hop)
    assert [r["group"] for r in got] == groups and [r["repeats"] for r in got] == [groups.count(g) for g in groups]
    assert np.allclose([r["energy"] for r in got], energy, atol=2e-6) and np.allclose([r["rms_db"] for r in got], 20 * np.log10(level), atol=2e-5)
    assert all(r["label"] in ("hook", "verse", "breakdown", "section", "intro", "outro") for r in got) and any(r["label"] == "hook" for r in got)


def song(rate, seed=3):
    """Four parts of different chords and noise, the third as the first."""
    rng, parts = np.random.default_rng(seed), []
    for notes, noise, level in (((220, 277, 330), 0.01, 0.3), ((196, 247, 294), 0.2, 1.0), ((220, 277, 330), 0.01, 0.3), ((175, 262, 440), 0.05, 0.6)):
        t = np.arange(8 * rate) / rate
        parts.append(level * (sum(0.2 * np.sin(2 * np.pi * h * t) for h in notes) + noise * rng.normal(size=len(t))))
    return np.concatenate(parts)


@pytest.mark.parametrize("size,cell", [(5000, 4096), (1 << 20, 1 << 20)])
def test_sections_do_not_depend_on_the_chunks(spark, size, cell):
    rate, frames = 8000, B.Frames(size=1024, hop=256, cell=512)
    x = {"song": song(rate), "noise": np.random.default_rng(5).normal(size=20 * rate), "short": np.random.default_rng(6).normal(size=1500), "silent": np.zeros(4 * rate)}
    downs = {"song": 0.25 + np.arange(16) * 2.0, "noise": [], "short": [0.0], "silent": [0.0, 2.0]}
    grid = spark.createDataFrame([(t, float(s)) for t, d in downs.items() for s in d], "track_id string, seconds double")
    bars = spark.createDataFrame([(t, 2.0 if t != "noise" else 1.0) for t in x], "track_id string, bar double")
    clips = table(spark, x, size, 64, rate)
    got = {}
    for r in X.segmented(clips, grid, bars, frames, 2048, cell, 32, 2).orderBy("track_id", "place").collect():
        got.setdefault(r["track_id"], []).append(r)
    assert got.keys() == x.keys()
    for t, y in x.items():
        found = whole_features(y, rate, 1024, 256, 2048)
        curve = whole_novelty(found, 32) if found.shape[1] > 6 else np.zeros(0)
        bounds = naive_bounds(curve, rate / 256, len(y) / rate, 2.0 if t != "noise" else 1.0, downs[t], 2)
        assert [r["start"] for r in got[t]][1:] == [r["end"] for r in got[t]][:-1] and got[t][0]["start"] == 0 and got[t][-1]["end"] == len(y) / rate
        if t != "silent":
            check(got[t], y, rate, found, bounds, 256)
    starts = [r["start"] for r in got["song"]]
    assert all(min(abs(s - b) for s in starts) <= 1.0 for b in (8, 16, 24)) and len(got["silent"]) == len(got["short"]) == 1
    assert X.segmented(clips.limit(0), grid, bars, frames, 2048, cell).count() == 0


def test_merging(spark):
    rng, cases = np.random.default_rng(2), []
    for k in range(60):
        bounds = sorted({0.0, *np.round(rng.random(int(rng.integers(0, 9))) * 20, 2).tolist(), 20.0})
        cases.append((k, bounds, float(rng.choice([0.5, 2.0, 5.0, 30.0]))))
    rows = spark.createDataFrame(cases, "k int, b array<double>, least double")
    for r in rows.select("*", X.merged(F.col("b"), F.col("least")).alias("out")).collect():
        kept = r["b"][:1]
        for b in r["b"][1:]:
            if b - kept[-1] >= r["least"] or b == r["b"][-1]:
                kept.append(b)
        if len(kept) > 2 and kept[-1] - kept[-2] < r["least"]:
            kept.pop(-2)
        assert r["out"] == kept


def test_nearest_and_tops_and_quantiles(spark):
    grid = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("b", 5.0)], "track_id string, seconds double")
    times = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 2.1), ("a", 3.0), ("a", 9.0), ("b", 1.0), ("c", 4.0)], "track_id string, seconds double")
    assert sorted(map(tuple, X.snapped(times, grid).collect())) == [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 3.0), ("b", 5.0), ("c", 4.0)]
    curve = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([5, 1, 2, 2, 2, 1, 1, 3, 3, 4, 2, 2, 9])], "track_id string, frame long, v double")
    assert sorted((r["frame"], r["v"]) for r in X.tops(curve).collect()) == [(3, 2.0), (9, 4.0)]
    values = np.random.default_rng(1).random(37)
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0)], "track_id string, v double")
    got = {r["track_id"]: r["quantile"] for r in X.quantiles(rows, "track_id", "v", 0.55).collect()}
    assert np.isclose(got["a"], np.percentile(values, 55)) and got["b"] == 2.0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_track_sections(spark):
    x = whole(audio.clips(spark, DATA).select("track_id", F.col("start_sample").alias("start"), F.col("samples").alias("values")))
    got = {}
    for r in audio.track_sections(spark, DATA).orderBy("track_id", "place").collect():
        got.setdefault(r["track_id"], []).append(r)
    assert got.keys() == x.keys() and max(map(len, got.values())) > 3
    for t, y in x.items():
        found = whole_features(y, 400, 64, 8, 256)
        downs = 0.1 + np.arange(len(y) * 2 // 400 + 1) / 2
        check(got[t], y, 400, found, naive_bounds(whole_novelty(found, 8), 50.0, len(y) / 400, 0.5, downs, 2), 8)
