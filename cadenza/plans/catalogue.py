"""The registered queries of the engine, and their SQL."""

from __future__ import annotations

from cadenza.plans import audio, notes, records, series

QUERIES: dict = {**series.QUERIES, **records.QUERIES, **notes.QUERIES, **audio.QUERIES}
ORACLES: dict = {**series.ORACLES, **records.ORACLES, **notes.ORACLES}

flagship = series.alignment_report
