"""Streams whose frames come late and out of order: a buffer for each stream waits for the watermark, then frames go on in order.

A frame is released when event time has passed its own by the allowed delay, so shuffled input over any number of triggers gives the
rows that a batch over the ordered frames gives. Frames later than the delay are dropped, as the watermark says. What is
kept for a stream: the frames inside the delay and the operator's own few values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state of arbitrary processors lives in RocksDB.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A step takes what is kept and a frame's values, and gives what is kept next and the row to hand on (without key and frame).
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


class InOrder(StatefulProcessor):
    """Buffers frames (stream, frame, ts and values) by event time and runs a step over them in order of (ts, frame)."""

    def __init__(self, step: Step, values: list[str], kinds: str, kept: str, out: list[str]):
        self.step, self.values, self.kinds, self.kept, self.out = step, values, kinds, kept, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", f"rows array<struct<frame: bigint, {self.kinds}>>")
        self.state = handle.getValueState("kept", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for at, part in pdf.groupby(pdf["ts"].astype("datetime64[ms]").astype("int64")):
                if at <= late:
                    continue  # the watermark has passed it
                new = [tuple(r) for r in part[["frame", *self.values]].itertuples(index=False)]
                held = list(self.waiting.getValue((int(at),))[0]) if self.waiting.containsKey((int(at),)) else []
                self.waiting.updateValue((int(at),), ([tuple(r) for r in held] + [(int(f), *v) for f, *v in new],))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame([], columns=["stream", "frame", *self.out], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        kept = self.state.get() if self.state.exists() else None
        out = []
        for at in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            for frame, *values in sorted((tuple(r) for r in self.waiting.getValue((at,))[0]), key=lambda r: r[0]):
                kept, row = self.step(kept, tuple(values))
                out.append((key[0], frame, *row))
            self.waiting.removeKey((at,))
        if kept is not None:
            self.state.update(kept)
        yield pd.DataFrame(out, columns=["stream", "frame", *self.out], dtype=object)

    def close(self) -> None:
        pass


def _run(frames: DataFrame, late: str, processor: InOrder, schema: str) -> DataFrame:
    if frames.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    known = frames.where("stream is not null and frame is not null and ts is not null").withWatermark("ts", late)
    return known.groupBy("stream").transformWithStateInPandas(processor, schema, "append", "eventtime")


def rolling_any_ordered(frames: DataFrame, n: int = 4, late: str = "10 seconds") -> DataFrame:
    """Rows (stream, frame, flag) with flag true if any of the last n frames of the stream has it.

    frames: (stream, frame, ts, flag); a null flag is false, rows without a stream, frame or time are left out.
    """

    def step(kept: tuple | None, values: tuple) -> tuple[tuple, tuple]:
        last = [*(kept[0] if kept else []), bool(values[0])][-max(n, 1) :]
        return (last,), (any(last),)

    rows = frames.select("stream", "frame", "ts", F.coalesce("flag", F.lit(False)).alias("flag"))
    return _run(rows, late, InOrder(step, ["flag"], "flag: boolean", "last array<boolean>", ["flag"]), "stream long, frame long, flag boolean")


def slip_ordered(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Rows (stream, frame, foot, heel) with the standing heel held, as in slip_stream(), of frames (stream, frame, ts, foot, heel).

    Rows without a foot or heel are left out besides.
    """

    def step(kept: tuple | None, values: tuple) -> tuple[tuple, tuple]:
        foot, heel = values
        was, start, last, carry = kept if kept else (None, 0.0, 0.0, 0.0)
        if foot != was:
            carry += (start - last) if was is not None else 0.0
            start = heel
        return (foot, float(start), float(heel), float(carry)), (foot, start + carry)

    rows = frames.where("foot is not null and heel is not null").select("stream", "frame", "ts", "foot", "heel")
    return _run(rows, late, InOrder(step, ["foot", "heel"], "foot: string, heel: double", "foot string, start double, last double, carry double", ["foot", "heel"]), "stream long, frame long, foot string, heel double")
