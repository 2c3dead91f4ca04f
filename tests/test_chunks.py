"""Kernels over chunks against the same on whole recordings, and beat grids against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import beats as B
from cadenza.operators import chunks as C
from cadenza.operators import spectra as S
from cadenza.session import Workbench

RATE = 8000


def table(spark, tracks, size, overlap=0, rate=RATE):
    rows = [(name, rate, k, at, x[at : at + size + overlap].tolist()) for name, x in tracks.items() for k, at in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "track_id string, sr int, chunk int, start_sample long, samples array<double>").repartition(5)


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    x = 0.1 * rng.normal(size=n)
    for k in range(0, n - 400, 4100):
        x[k : k + 400] += np.hanning(800)[400:] * rng.normal(size=400)
    x[n // 2 :] += 0.5
    x[n // 3] += 0.9
    return x


def whole_measures(x, rate=RATE):
    mel = S.log_mel(x, rate)
    rise = np.maximum(0, np.diff(mel, axis=1, prepend=mel[:, :1])).sum(axis=0)
    power = S.reduced(x, lambda m: m * m).sum(axis=1)
    hertz = np.fft.rfftfreq(S.SIZE, 1 / rate)
    band = lambda a, b: power[(hertz >= a) & (hertz < b)].sum()
    minutes = len(x) / rate / 60
    return {"seconds": len(x) / rate, "flatness": S.flatness(x).mean(), "low_share": band(20, 150) / band(20, rate / 2), "voice_share": band(300, 3400) / band(20, rate / 2), "onsets": len(S.onsets(rise, rate / S.HOP)[0]) / minutes, "clicks": len(S.clicks(x, rate)) / minutes, "mfcc": S.mfcc(x, rate).mean(axis=1)}


@pytest.mark.parametrize("size,overlap,cell", [(4096, 0, 1 << 13), (65_536, 2048, 1 << 16), (3000, 100, 1000), (1 << 20, 0, 1 << 20)])
def test_measures_do_not_depend_on_the_chunks(spark, size, overlap, cell):
    tracks = {"a": noisy(50_001, 1), "b": noisy(4 * 512 * 4, 2), "short": noisy(900, 3)[:900]}
    got = {r["track_id"]: r for r in C.measured(table(spark, tracks, size, overlap), cell=cell).collect()}
    for name, x in tracks.items():
        for k, v in whole_measures(x).items():
            assert np.allclose(got[name][k], v), (name, k, got[name][k], v)
        assert np.isclose(got[name]["peak_db"], 20 * np.log10(np.abs(x).max())) and np.isclose(got[name]["rms_db"], 10 * np.log10((x * x).mean()))


def test_a_tone_has_its_length_and_nothing_else(spark):
    rate = 44_100
    tone = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(6 * rate) / rate)
    r = C.measured(table(spark, {"tone": tone}, 1 << 16, 2048, rate)).collect()[0]
    assert r["seconds"] == 6.0 and r["clicks"] == 0 and r["onsets"] <= 20 and r["voice_share"] > 0.99 and r["low_share"] < 0.01


def test_broken_and_empty(spark):
    rows = [("x", None, 0, 0, [1.0]), (None, 8000, 0, 0, [1.0]), ("y", 8000, 0, 0, None), ("z", 8000, 0, 0, []), ("one", 8000, 0, 0, [0.5]), ("null", 8000, 0, 0, [None, 0.5])]
    clips = spark.createDataFrame(rows, "track_id string, sr int, chunk int, start_sample long, samples array<double>")
    assert {r["track_id"]: r["seconds"] for r in C.measured(clips).collect()} == {"one": 1 / 8000, "null": 2 / 8000}
    assert C.measured(clips.limit(0)).count() == 0


def test_pitch(spark):
    rate = 44_100
    t = np.arange(rate) / rate
    tones = {f"{h}": 0.4 * np.sin(2 * np.pi * h * t) + 0.1 * np.sin(4 * np.pi * h * t) for h in (82, 110, 220, 440, 880)}
    tones["noise"] = np.random.default_rng(1).normal(size=rate)
    tones["silence"] = np.zeros(rate)
    clips = table(spark, tones, 10_000, 0, rate)
    for low, high, names in ((60.0, 500.0, ("82", "110", "220", "440", "noise", "silence")), (400.0, 1200.0, ("880", "noise", "silence"))):
        rows = C.pitched(clips.where(F.col("track_id").isin(*names)), low=low, high=high, cell=9000).where("frame between 8 and 34").collect()
        assert len(rows) == 27 * len(names)
        for r in rows:
            if r["track_id"].isdigit():
                assert abs(1200 * np.log2(r["hertz"] / int(r["track_id"]))) < 5, r
            else:
                assert r["hertz"] == 0


def drums(bpm, seconds, rate=RATE, first=0.3, seed=1):
    """Kicks on all beats, the first of four louder and lower, hats between them, snares on two and four."""
    rng = np.random.default_rng(seed)
    x = 0.002 * rng.normal(size=int(seconds * rate))

    def put(t, sound):
        k = int(round(t * rate))
        if k + len(sound) <= len(x):
            x[k : k + len(sound)] += sound

    fade = lambda n: np.exp(-np.arange(n) / (n / 5))
    for k in range(int((seconds - first) * bpm / 60)):
        t = first + k * 60 / bpm
        kick = np.sin(2 * np.pi * 60 * np.arange(1200) / rate) * fade(1200)
        put(t, (1.0 if k % 4 == 0 else 0.7) * kick)
        put(t + 30 / bpm, 0.15 * rng.normal(size=300) * fade(300))
        if k % 4 in (1, 3):
            put(t, 0.35 * rng.normal(size=700) * fade(700))
    return x


def naive_beats(env, fps, bpm):
    """The dynamic program cell by cell."""
    period, n = 60 * fps / bpm, len(env)
    bell = B.smoothing(period)
    local = np.convolve(env, bell, mode="full")[len(bell) // 2 : len(bell) // 2 + n]
    local = local / local.max() if local.max() > 0 else local
    total, link = [], []
    for t in range(n):
        best, way = None, -1
        for back in range(-round(-2 * period), -round(-0.5 * period) - 1, -1):
            if t - back >= 0:
                x = total[t - back] - B.TIGHTNESS * np.log(back / period) ** 2
                if best is None or x > best:
                    best, way = x, t - back
        total.append(local[t] + (best or 0.0))
        link.append(way)
    total = np.array(total)
    limit = np.median(total) + 0.5 * (total.max() - np.median(total))
    way = [int(np.flatnonzero(total >= limit)[-1])]
    while link[way[-1]] >= 0:
        way.append(link[way[-1]])
    way = way[::-1]
    if len(way) > 4:
        floor = B.SUPPORT * np.median(local[way])
        while len(way) > 2 and local[way[0]] < floor:
            way = way[1:]
        head = way
        while len(head) > 2 and local[head[-1]] < floor:
            head = head[:-1]
        way = head
    return [k / fps for k in way]


def naive_corr(env):
    x = env - env.mean()
    return np.array([x[: len(x) - k] @ x[k:] / (len(x) - k) for k in range(len(x))])


def envelope_table(spark, envs, hop, size):
    rows = [(name, int(fps * hop), at, e[at : at + size].tolist()) for name, (e, fps) in envs.items() for at in range(0, len(e), size)]
    return spark.createDataFrame(rows, "track_id string, sr int, start long, values array<double>").repartition(4)


def test_beats_equal_the_cell_by_cell_program(spark):
    rng = np.random.default_rng(4)
    frames = B.Frames(hop=80, cell=64)
    envs = {f"r{k}": (np.maximum(0, rng.normal(size=n)), 100.0) for k, n in enumerate((40, 333, 700, 1001))}
    envs["flat"] = (np.full(200, 0.5), 100.0)
    envs["silent"] = (np.zeros(150), 100.0)
    table_ = envelope_table(spark, envs, 80, 50)
    bench = Workbench(spark)
    tempo = B.tempi(table_, bench, frames)
    own = {r["track_id"]: r for r in tempo.collect()}
    got = {}
    for r in B.tracked(table_, tempo, bench, frames).orderBy("track_id", "place").collect():
        got.setdefault(r["track_id"], []).append(r["seconds"])
    for name, (e, fps) in envs.items():
        bpm, found = B.tempo_of(naive_corr(e)[: 4 * 100 + 2], len(e), fps)
        assert np.isclose(own[name]["bpm"], bpm), name
        assert np.allclose([c["bpm"] for c in own[name]["candidates"]], [b for b, _ in found])
        assert np.allclose(got[name], naive_beats(e, fps, own[name]["bpm"])), name


def test_grids_of_drums(spark):
    rate = 22_050
    tracks = {"120": drums(120, 24, rate), "96": drums(96, 30, rate, first=0.9, seed=2)}
    results = []
    for size, cell in ((1 << 15, 1 << 15), (1 << 20, 1 << 20)):
        grid, beats = B.grids(table(spark, tracks, size, 0, rate), cell=cell)
        rows = {r["track_id"]: r for r in grid.collect()}
        times = {}
        for r in beats.orderBy("track_id", "place").collect():
            times.setdefault(r["track_id"], []).append(r["seconds"])
        results.append((rows, times))
        for name, first in (("120", 0.3), ("96", 0.9)):
            period = 60 / int(name)
            off = [abs((t - first) / period - round((t - first) / period)) * period for t in times[name]]
            assert abs(rows[name]["bpm"] - int(name)) < 0.5 and np.median(off) < 0.010 and max(off) < 0.060, (name, rows[name]["bpm"], np.median(off), max(off))
            assert rows[name]["n_beats"] == len(times[name]) > 40
            bar = (rows[name]["first_downbeat"] - first) / period
            assert abs(bar / 4 - round(bar / 4)) < 0.05, (name, bar)
    for name in tracks:
        assert np.allclose(results[0][1][name], results[1][1][name]) and np.isclose(results[0][0][name]["confidence"], results[1][0][name]["confidence"])
