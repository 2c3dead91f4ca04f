"""Streams of job events and feedback, by Structured Streaming.

Job events: job_id, seq, at (event time), type, data. The event time is at, rows are told apart by (job_id, seq) within the watermark,
and a terminal event ends a job's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.session import ship

EVENTS = "job_id string, seq long, at timestamp, type string, phase string"
PHASES = "job_id string, phase string, seconds double, done boolean"
#: The types that end a job.
TERMINAL = ("done", "error")
LATENESS = "10 minutes"


def job_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New event files as a stream, each event once."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).json(path)
    return rows.withWatermark("at", LATENESS).dropDuplicatesWithinWatermark(["job_id", "seq"])


def phase_times(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """How long each phase of a job took, emitted when the next one begins or the job ends. State: the running phase and its start; it goes with the job's end, or when the watermark is an hour past its last event."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, since = state.get if state.exists else (None, None)
        last = 0.0
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, name, at in zip(rows["type"], rows["phase"], rows["at"], strict=True):
            now = last = at.timestamp()
            end = kind in TERMINAL
            if phase is not None and (end or name != phase):
                out.append((key[0], phase, now - since, end))
            if end:
                phase = None
                break
            if name != phase:
                phase, since = name, now
        if phase is None:
            state.remove()
        else:
            state.update((phase, since))
            state.setTimeoutTimestamp(int(last * 1000) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "phase", "seconds", "done"])

    return events.groupBy("job_id").applyInPandasWithState(step, PHASES, "phase string, since double", "append", GroupStateTimeout.EventTimeTimeout)


def event_counts(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Events by window and type; a window is emitted once, when the watermark has passed it."""
    return events.groupBy(F.window("at", window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def feedback_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: markers, ratings and votes of a batch go to tables of their own, in a folder of the batch, so that a batch that runs again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for kind in ("marker", "rating", "vote"):
                rows.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{kind}s/batch={batch}")
        finally:
            rows.unpersist()

    return write
