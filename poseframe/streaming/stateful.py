"""Structured Streaming forms of the three operators that keep state along a recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_any_stream(frames: DataFrame, n: int = 4) -> DataFrame:
    """Rows (stream, frame, flag) with flag true if any of the last n frames of the stream has it; frames come in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for frame, flag in zip(rows["frame"], rows["flag"], strict=True):
            last = [*last, bool(flag)][-n:] if n > 1 else [bool(flag)]
            out.append((key[0], frame, any(last)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["stream", "frame", "flag"])

    return frames.groupBy("stream").applyInPandasWithState(run, "stream long, frame long, flag boolean", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def density_stream(weights: DataFrame) -> DataFrame:
    """Running sums of (point, weight) in update mode."""
    return weights.groupBy("point").agg(F.sum("weight").alias("weight"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in windows of event time; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def slip_stream(frames: DataFrame) -> DataFrame:
    """Rows (stream, frame, foot, heel) with the standing heel held: heel is one coordinate of the standing foot.

    The shift of a finished run is carried on. As a run can't be known to be the last one, every run is held in place.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        foot, start, last, carry = state.get if state.exists else (None, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for frame, f, h in zip(rows["frame"], rows["foot"], rows["heel"], strict=True):
            if f != foot:
                carry += (start - last) if foot is not None else 0.0
                foot, start = f, h
            last = h
            out.append((key[0], frame, f, start + carry))
        state.update((foot, float(start), float(last), float(carry)))
        yield pd.DataFrame(out, columns=["stream", "frame", "foot", "heel"])

    return frames.groupBy("stream").applyInPandasWithState(
        run, "stream long, frame long, foot string, heel double", "foot string, start double, last double, carry double", "append", GroupStateTimeout.NoTimeout
    )
