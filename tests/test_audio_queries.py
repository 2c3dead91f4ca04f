"""The queries over recordings in chunks, on whole tables, against the kernels of whole recordings and plain loops."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from cadenza.operators import beats as B
from cadenza.operators import pairs as P
from cadenza.operators import spectra as S
from cadenza.plans import audio

from .test_chunks import naive_beats, naive_corr, whole_measures

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def recordings():
    rows = pq.read_table(f"{DATA}/embeddings.parquet").sort_by("vec_id")
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_pylist())
    return {int(k): vectors[ids // 64 == k].ravel().astype(float) for k in np.unique(ids // 64)}


def test_chunked_measures(spark, recordings, monkeypatch):
    monkeypatch.setattr(S, "SIZE", 64)
    monkeypatch.setattr(S, "HOP", 8)
    for f in (S.reduced, S.blocks):
        monkeypatch.setattr(f, "__defaults__", tuple({2048: 64, 512: 8}.get(d, d) if k < 2 else d for k, d in enumerate(f.__defaults__)))
    got = {r["track_id"]: r for r in audio.chunked_measures(spark, DATA).collect()}
    assert got.keys() == recordings.keys()
    for name, x in recordings.items():
        want = whole_measures(x, 400)
        for k in ("seconds", "flatness", "low_share", "voice_share", "onsets", "clicks"):
            assert abs(got[name][k] - want[k]) < 2e-6, (name, k)
        assert np.allclose([got[name][f"mfcc_{k}"] for k in range(4)], want["mfcc"][:4], atol=2e-6)


def test_pitch_track(spark, recordings):
    got = {(r["track_id"], r["frame"]): (r["hertz"], r["clarity"]) for r in audio.pitch_track(spark, DATA).collect()}
    n = 0
    for name, x in recordings.items():
        padded = np.pad(x, 50, mode="reflect")
        for f in range(1 + len(x) // 40):
            own = padded[f * 40 : f * 40 + 100] - padded[f * 40 : f * 40 + 100].mean()
            corr = np.array([own[: 100 - k] @ own[k:] for k in range(100)])
            lag = 4 + int(corr[4:24].argmax())
            clear = corr[lag] / corr[0]
            a, b, c = corr[lag - 1 : lag + 2]
            hertz = 400 / (lag + np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5)) if clear >= 0.35 else 0.0
            assert np.allclose(got[name, f], (hertz, clear), atol=2e-6), (name, f)
            n += 1
    assert n == len(got)


def test_beat_grids_and_times(spark, recordings):
    grid = {r["track_id"]: r for r in audio.beat_grids(spark, DATA).collect()}
    times = {}
    for r in audio.beat_times(spark, DATA).orderBy("track_id", "place").collect():
        times.setdefault(r["track_id"], []).append(r["seconds"])
    assert grid.keys() == recordings.keys()
    for name, x in recordings.items():
        mel = np.log1p(1000 * (S.mel_bank(400, 64) @ S.reduced(x, lambda m: m, 64, 8)))
        flux = np.maximum(0, np.diff(mel, axis=1, prepend=mel[:, :1])).sum(axis=0)
        width = max(3, round(0.5 * 400 / 8) | 1)
        env = np.maximum(0, flux - np.convolve(np.pad(flux, width // 2), np.ones(width) / width, mode="valid"))
        env = env / env.max()
        bpm, _ = B.tempo_of(naive_corr(env)[: 4 * 50 + 2], len(env), 50.0)
        found = np.array(naive_beats(env, 50.0, bpm))
        moved = np.array(times[name]) - found[len(found) - len(times[name]) :]
        assert grid[name]["n_beats"] == len(times[name]) and np.ptp(moved) < 2e-6 and abs(moved[0]) <= np.median(np.diff(found)) / 2 + 0.031
        gaps = np.diff(found)
        good = gaps[(gaps > 0.7 * np.median(gaps)) & (gaps < 1.4 * np.median(gaps))]
        want = 60 / good.mean() if len(found) >= 8 and len(good) >= 4 and 60 <= 60 / good.mean() <= 200 else bpm
        assert abs(grid[name]["bpm"] - want) < 2e-6 and grid[name]["first_downbeat"] in times[name][:4]


def naive_match(original, remix):
    """Every trial in a loop, and the winner refined."""
    base = remix["bpm"] / original["bpm"]
    q, ref = np.array(remix["frames"]).T, np.array(original["frames"]).T
    field, best = [], []
    for relation in P.RELATIONS:
        own = []
        for shift in P.SHIFTS:
            found = P.trial(q, ref, base * relation, shift)
            if found:
                field.append(found[0])
                own.append((found[0], -shift, found[2]))
        if own:
            top = max(own, key=lambda o: o[0])
            best.append((top[0] - (0 if relation == 1 else P.RELATION_COST), relation, top))
    if not best:
        return None
    best.sort(key=lambda b: -b[0])
    score, relation, (_, semitones, cells) = best[0]
    used = 1.0
    for fine in P.REFINE:
        found = P.trial(q, ref, base * relation * fine, -semitones)
        if found and found[0] - (0 if relation == 1 else P.RELATION_COST) > score:
            score, used, cells = found[0] - (0 if relation == 1 else P.RELATION_COST), fine, found[2]
    null = float(np.median(field))
    return {"score": max(0, score), "beat_relation": relation, "tempo_ratio": base * relation, "stretch_refine": used, "semitones": semitones, "cells": cells, "runner_up": max(0, best[1][0]) if len(best) > 1 else 0, "null": null, "margin": max(0, score) - null, "novelty_corr": P.change_correlation(ref, q, base * relation * used)}


def test_pair_match(spark):
    prints = {r["name"]: r for r in audio.prints(spark, DATA).collect()}
    got = audio.pair_match(spark, DATA).collect()
    assert {(r["original"], r["remix"]) for r in got} == {(a, b) for a in prints for b in (a, a + 1, a + 2) if b in prints}
    for r in got:
        want = naive_match(prints[r["original"]], prints[r["remix"]])
        for k, v in want.items():
            assert abs(r[k] - v) < 2e-6, (r["original"], r["remix"], k, r[k], v)
        vocal = prints[r["original"]]["source"] == prints[r["remix"]]["source"] == "vocals"
        assert (r["method"], r["confidence"]) == (("vocal", "high") if vocal else ("chroma", "low"))
        if r["original"] == r["remix"]:
            assert r["verdict"] == "match" and r["score"] > 0.99 and r["semitones"] == 0


def test_a_stretched_and_shifted_melody_is_found(spark):
    rng = np.random.default_rng(6)
    melody = np.repeat(rng.normal(size=(12, 60)), 8, axis=1)
    unit = lambda x: x / np.linalg.norm(x, axis=0)
    remix = np.roll(S.resampled(melody[:, 100:340], round(240 / 1.15)), 2, axis=0)
    other = np.repeat(rng.normal(size=(12, 40)), 6, axis=1)
    rows = [("song", 100.0, "vocals", unit(melody).T.tolist()), ("remix", 115.0, "vocals", unit(remix).T.tolist()), ("other", 115.0, "vocals", unit(other).T.tolist()), ("short", 100.0, "mix", unit(other)[:, :5].T.tolist())]
    prints = spark.createDataFrame(rows, "name string, bpm double, source string, frames array<array<double>>")
    asked = spark.createDataFrame([("song", "remix"), ("song", "other"), ("song", "short"), ("song", "none"), ("song", "remix")], "original string, remix string")
    got = {r["remix"]: r for r in P.matched(asked, prints).collect()}
    assert len(got) == 4 and got["remix"]["verdict"] == "match" and got["remix"]["semitones"] == 2 and got["remix"]["beat_relation"] == 1 and abs(got["remix"]["tempo_ratio"] - 1.15) < 1e-9
    assert got["other"]["verdict"] == "reject" and got["other"]["margin"] < got["remix"]["margin"]
    assert got["short"]["score"] is None and got["short"]["verdict"] == "reject" == got["none"]["verdict"]


def test_paths():
    rng = np.random.default_rng(8)
    for n, m in ((3, 3), (5, 9), (9, 5), (12, 4), (2, 9), (7, 7)):
        cost = rng.random((n, m))
        best = {}
        for i in range(n):
            for j in range(m):
                ways = [(best[a][0] + cost[i, j], k, best[a][1] + 1) for k, a in enumerate(((i - 1, j - 1), (i - 1, j - 2), (i - 2, j - 1))) if a in best]
                if i == 0:
                    best[i, j] = (cost[i, j], 1)
                elif ways:
                    total, _, cells = min(ways)
                    best[i, j] = (total, cells)
        ends = [(best[n - 1, j][0] / best[n - 1, j][1], j, best[n - 1, j][1]) for j in range(m) if (n - 1, j) in best]
        want = min(ends) if ends and min(n, m) >= 3 else (1.0, 0, 0)
        assert np.allclose(P.best_path(cost), want)


def test_excerpt_prints(spark, recordings):
    got = {}
    for r in audio.excerpt_prints(spark, DATA).orderBy("name", "frame").collect():
        got.setdefault(r["name"], []).append(r)
    for name, x in recordings.items():
        hertz = np.fft.rfftfreq(64, 1 / 400)
        level = lambda a, b: S.reduced(x, lambda m: np.sqrt((m[(hertz >= a) & (hertz < b)] ** 2).mean(axis=0)) if ((hertz >= a) & (hertz < b)).any() else np.zeros(m.shape[1]), 64, 8)  # noqa: E731, B023
        begin = S.voiced_window(level(300, 4000), level(30, 200), 50.0, 6.0)
        own = x[int(begin * 400) : int(begin * 400) + 2400]
        power = S.reduced(own, lambda m: m * m, 256, 8)
        bins = np.fft.rfftfreq(256, 1 / 400)
        folded = np.zeros((12, power.shape[1]))
        for k, h in enumerate(bins):
            if 55 < h < 5000:
                folded[round(69 + 12 * np.log2(h / 440)) % 12] += power[k]
        folded = np.log1p(10 * folded / folded.sum(axis=0))
        frames = S.resampled(folded, max(2, round(folded.shape[1] * 8 / 400 * 10)))
        frames = frames - frames.mean(axis=1, keepdims=True)
        frames = frames / np.maximum(np.linalg.norm(frames, axis=0), 1e-9)
        assert np.allclose([[r[f"class_{k}"] for k in range(12)] for r in got[name]], frames.T, atol=2e-6)
        assert abs(got[name][0]["begin"] - begin) < 1e-6 and abs(got[name][0]["seconds"] - len(own) / 400) < 1e-6


def test_the_store_reads_only_what_is_new(spark, tmp_path):
    import wave

    from cadenza.operators import prints
    from cadenza.sources import files

    def save(name, hertz, seconds=3, rate=4000):
        x = 0.4 * np.sin(2 * np.pi * hertz * np.arange(seconds * rate) / rate)
        with wave.open(str(tmp_path / "wav" / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((x * 32767).astype("<i2").tobytes())

    (tmp_path / "wav").mkdir()
    save("a.wav", 220)
    save("b.wav", 330)
    (tmp_path / "wav" / "broken.wav").write_bytes(b"RIFF")
    listing = lambda: files.audio_files(spark, str(tmp_path / "wav")).select("path", "size", "changed")
    load = lambda paths: spark.read.format("binaryFile").load(paths).select("path", "content")
    measure = lambda rows: prints.classes(files.wav_samples(rows), 1024, 256).withColumnRenamed("track_id", "name")
    store = prints.Store(spark, str(tmp_path / "store"))
    assert store.read() is None and store.update(listing(), load, measure) == {"read": 3, "measured": 3, "kept": 0, "dropped": 0}
    rows = lambda: {r["path"].rsplit("/", 1)[-1]: r["frames"] for r in store.read().collect()}
    first = rows()
    assert set(first) == {"a.wav", "b.wav", "broken.wav"} and first["broken.wav"] is None and np.array(first["a.wav"]).shape[1] == 12
    assert store.update(listing(), load, measure) == {"read": 0, "measured": 0, "kept": 3, "dropped": 0} and rows() == first
    (tmp_path / "wav" / "b.wav").unlink()
    (tmp_path / "wav" / "copy.wav").write_bytes((tmp_path / "wav" / "a.wav").read_bytes())
    save("c.wav", 440)
    assert store.update(listing(), load, measure) == {"read": 2, "measured": 1, "kept": 2, "dropped": 1}
    after = rows()
    assert set(after) == {"a.wav", "broken.wav", "copy.wav", "c.wav"} and after["a.wav"] == first["a.wav"] == after["copy.wav"] != after["c.wav"]
    assert len(store.versions()) == 2
