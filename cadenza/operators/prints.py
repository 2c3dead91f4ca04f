"""Prints of recordings, by which pairs are told (cadenza.operators.pairs): a voiced excerpt's tempo, first downbeat and pitch classes; and a store of them that is kept in step with a folder.

Recordings come as chunks and stay chunks until an excerpt is chosen; an excerpt is bounded, and so is its print.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import beats, spectra
from cadenza.operators.chunks import CELL, Cell, halo, haloed, kernelled
from cadenza.session import Workbench, ship

# Seconds of an excerpt by kind, frames of a print a second, bands of voice and bass, what a pitch class is counted from, how loudness is compressed.
SECONDS, FPS, VOICE, BASS, PITCHES, GAIN = {"remix": 75.0, "original": 180.0}, 10.0, (300.0, 4000.0), (30.0, 200.0), (55.0, 5000.0), 10.0
# End of fixed values.


def excerpts(clips: DataFrame, seconds: float, bench: Workbench, size: int = spectra.SIZE, hop: int = spectra.HOP, cell: int = CELL) -> DataFrame:
    """clips cut to the stretch of that length in which a voice stands out most, and where it begins: track_id, sr, start_sample (from the stretch's begin), samples, begin (seconds). Shorter recordings stay whole."""

    def levels(c: Cell) -> list[tuple]:
        hertz = np.fft.rfftfreq(size, 1 / c.rate)
        bands = [(hertz >= a) & (hertz < b) for a, b in (VOICE, BASS)]
        first, blocks = c.magnitudes(size, hop)
        own = np.concatenate([np.stack([np.sqrt((m[b] ** 2).mean(axis=0)) if b.any() else np.zeros(m.shape[1]) for b in bands]) for m in blocks] or [np.zeros((2, 0))], axis=1)
        return [(first, own[0].tolist(), own[1].tolist(), c.total)]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        voice, low = (np.concatenate([np.asarray(v, float) for v in rows[k]]) for k in ("voice", "low"))
        rate = int(rows["sr"].iloc[0])
        return pd.DataFrame({"track_id": rows["track_id"].iloc[:1], "begin": [spectra.voiced_window(voice, low, rate / hop, seconds)]})

    wide = halo(size, hop)
    found = kernelled(haloed(clips, cell, wide, wide), cell, levels, "start long, voice array<double>, low array<double>, total long")
    kind = clips.schema["track_id"].dataType.simpleString()
    begins = bench.put(found.groupBy("track_id").applyInPandas(choose, f"track_id {kind}, begin double"))
    rows = clips.join(begins, "track_id")
    low = (F.col("begin") * F.col("sr")).cast("long")
    first = F.greatest(low, F.col("start_sample"))
    last = F.least(low + F.lit(seconds) * F.col("sr"), F.col("start_sample") + F.size("samples")).cast("long")
    part = F.slice("samples", (first - F.col("start_sample") + 1).cast("int"), (last - first).cast("int"))
    return rows.where(last > first).select("track_id", "sr", (first - low).alias("start_sample"), part.alias("samples"), "begin")


def classes(clips: DataFrame, size: int = 4096, hop: int = spectra.HOP, cell: int = CELL, fps: float = FPS) -> DataFrame:
    """track_id and frames (arrays of 12) of bounded recordings: pitch classes, compressed, at fps frames a second, without their mean, of length 1. None under a frame's size or two frames."""

    def folded(c: Cell) -> list[tuple]:
        hertz = np.fft.rfftfreq(size, 1 / c.rate)
        use = (hertz > PITCHES[0]) & (hertz < PITCHES[1])
        note = np.rint(69 + 12 * np.log2(hertz[use] / 440)).astype(int) % 12
        fold = np.zeros((12, use.sum()))
        fold[note, np.arange(use.sum())] = 1.0
        first, blocks = c.magnitudes(size, hop)
        own = np.concatenate([fold @ m[use] ** 2 for m in blocks] or [np.zeros((12, 0))], axis=1)
        return [(first, (own / np.maximum(own.sum(axis=0), 1e-12)).T.tolist(), c.total)] if c.total >= size else []

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        x = np.concatenate([np.stack([np.asarray(f, float) for f in v]) for v in rows["v"] if len(v)]).T
        if x.shape[1] < 2:
            return pd.DataFrame({"track_id": [], "frames": []})
        n = max(2, round(x.shape[1] * hop / int(rows["sr"].iloc[0]) * fps))
        x = spectra.resampled(np.log1p(GAIN * x), n)
        x = x - x.mean(axis=1, keepdims=True)
        return pd.DataFrame({"track_id": rows["track_id"].iloc[:1], "frames": [(x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), 1e-9)).T.tolist()]})

    wide = halo(size, hop)
    found = kernelled(haloed(clips, cell, wide, wide), cell, folded, "start long, v array<array<double>>, total long")
    kind = clips.schema["track_id"].dataType.simpleString()
    return found.groupBy("track_id").applyInPandas(joined, f"track_id {kind}, frames array<array<double>>")


def printed(clips: DataFrame, seconds: float = SECONDS["remix"], frames: beats.Frames = beats.FRAMES, size: int = 4096, cell: int = CELL, fps: float = FPS) -> DataFrame:
    """name, bpm, downbeat, begin, seconds, source and frames of each recording in chunks; frames are null where there are too few."""
    ship(clips.sparkSession)
    bench = Workbench(clips.sparkSession)
    own = bench.put(excerpts(clips, seconds, bench, frames.size, frames.hop, cell))
    grid, found = beats.grids(own, frames, cell)
    length = own.groupBy("track_id").agg(F.first("begin").alias("begin"), (F.max(F.col("start_sample") + F.size("samples")) / F.first("sr")).alias("seconds"))
    rows = length.join(grid.select("track_id", "bpm", F.col("first_downbeat").alias("downbeat")), "track_id", "left").join(classes(own, size, frames.hop, cell, fps), "track_id", "left")
    out = bench.put(rows.select(F.col("track_id").alias("name"), "bpm", "downbeat", "begin", "seconds", F.lit("mix").alias("source"), "frames"), keep=True)
    bench.clear()
    return out


class Store:
    """Prints of the files in a folder, as a table that is brought up to date: only files that are new or changed are read, and prints of files that are gone go.

    A file is known by its path, size and time of change, as a listing gives them without its contents; a file that is new by that, but has the bytes of
    a known one, takes that one's print. Each update writes a whole new version; its success marker makes it the current one, so a lost
    update changes nothing, and readers of the version before go on. The version before the last is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.folder}/version={found[-1]:09d}") if found else None

    def update(self, listing: DataFrame, load: Callable[[list[str]], DataFrame], measure: Callable[[DataFrame], DataFrame], batch: int = 1000) -> dict[str, int]:
        """listing: path, size, changed. load: paths -> path, content of these files. measure: path, content -> name (the path) and a print's columns. Returns how many files were read, measured, kept and dropped.

        Paths of new files pass through the driver, some at a time, as those of any Spark read do.
        """
        listing = listing.select("path", "size", F.col("changed").cast("timestamp").alias("changed"))
        before, level = self.read(), (self.versions() or [0])[-1] + 1
        parts, known = [], None
        if before is not None:
            same = before.join(listing, ["path", "size", "changed"], "left_semi")
            new = listing.join(before.select("path", "size", "changed"), ["path", "size", "changed"], "left_anti")
            parts.append(same)
            known = before
        else:
            new = listing
        bench = Workbench(self.spark)
        new = bench.put(new)
        counts = {"read": 0, "measured": 0, "kept": parts[0].count() if parts else 0, "dropped": 0 if before is None else before.count() - parts[0].count()}
        paths = [r["path"] for r in new.select("path").orderBy("path").toLocalIterator()]
        for k in range(0, len(paths), batch):
            files = load(paths[k : k + batch])
            marked = bench.put(files.select("path", F.sha2("content", 256).alias("digest")))
            counts["read"] += marked.count()
            fresh = marked
            if known is not None:
                twins = known.select("digest", *[c for c in known.columns if c not in ("path", "size", "changed", "digest")]).dropDuplicates(["digest"])
                parts.append(bench.put(new.join(marked.join(twins, "digest"), "path").select(*known.columns)))
                fresh = bench.put(marked.join(twins.select("digest"), "digest", "left_anti"))
            first = bench.put(fresh.groupBy("digest").agg(F.min("path").alias("name")))  # of files with equal bytes one is measured
            counts["measured"] += first.count()
            own = bench.put(measure(files.join(F.broadcast(first.select(F.col("name").alias("path"))), "path", "left_semi")))
            rows = fresh.join(first, "digest").join(own, "name", "left").drop("name")
            parts.append(bench.put(new.join(rows, "path")))
        if parts:
            columns = parts[-1].columns if before is None else before.columns
            out = parts[0].select(*columns)
            for p in parts[1:]:
                out = out.unionByName(p.select(*columns))
            out.write.mode("overwrite").parquet(f"{self.folder}/version={level:09d}")
            for old in self.versions()[:-2]:
                self._fs.delete(self._path(f"{self.folder}/version={old:09d}"), True)
        bench.clear()
        return counts
