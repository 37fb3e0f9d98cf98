"""Clocks of two recordings: local time to UTC, the signal they share, the drift between them, rows side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseframe.functions.text import micros
from poseframe.operators.asof import asof_join
from poseframe.operators.fits import drift
from poseframe.operators.series import gaps_filled
from poseframe.sources.readers import keypoint

LEFT_HEEL, RIGHT_HEEL = 19, 22


def utc_times(frames: DataFrame, by: list[str], order: str, local: str, zone: str) -> DataFrame:
    """Adds utc and utc_offset (seconds east): the offset that the zone has at a recording's first frame holds for all of it."""
    first = F.first(local).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    start = F.convert_timezone(F.lit(zone), F.lit("UTC"), first)
    offset = ((micros(first) - micros(start)) / 1_000_000).cast("long")
    return frames.withColumn("utc_offset", offset).withColumn("utc", F.timestamp_add("SECOND", -F.col("utc_offset").cast("int"), F.col(local)))


def heel_difference(poses: DataFrame, lengths: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """Rows (by, frame, diff) for each frame below n of lengths (by, n): the right heel's y less the left one's.

    A heel that is missing or not sure takes the value on the line between its neighbours, held at the ends; a recording in
    which a heel is never seen has nulls.
    """
    ys = poses.select(*by, "frame", keypoint(LEFT_HEEL, least)[1].alias("ly"), keypoint(RIGHT_HEEL, least)[1].alias("ry"))
    dense = lengths.where("n > 0").select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    out = dense.join(ys, [*by, "frame"], "left")
    for c in ("ly", "ry"):
        out = gaps_filled(out, by, "frame", c)
    return out.select(*by, "frame", (F.col("ry") - F.col("ly")).alias("diff"))


def side_by_side(frames: DataFrame, shadow: DataFrame, on: str, by: list[str], shift: float, order: str | None = None) -> DataFrame:
    """For each frame inside the other recording's time, once shifted, the other's nearest row; of two the earlier.

    Columns of frames, `matched` (the shifted time) and the other's columns with the prefix r_.
    """
    ends = shadow.groupBy(*by).agg(F.min(on).alias("_lo"), F.max(on).alias("_hi"))
    moved = frames.withColumn(on, F.col(on) + shift).join(ends, by).where(F.col(on).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    out = asof_join(moved, shadow, on, by, order=order).withColumn("matched", F.col(on))
    return out.withColumn(on, F.col(on) - shift)


def clocks_aligned(frames: DataFrame, poses: DataFrame, shadow: DataFrame, by: list[str], zone: str, coarse=(20.0, 0.033), fine=(3.0, 0.001)) -> DataFrame:
    """The whole chain: frames (by, frame, local) and shadow (by, t, v, more) with the drift found from the heels' signal.

    t counts seconds of UTC. Adds `drift` to the rows of side_by_side().
    """
    timed = utc_times(frames, by, "frame", "local", zone).withColumn("t", micros("utc") / 1_000_000)
    lengths = frames.groupBy(*by).agg((F.max("frame") + 1).alias("n"))
    signal = heel_difference(poses, lengths, by).join(timed.select(*by, "frame", "t"), [*by, "frame"])
    found = drift(signal.select(*by, "t", F.col("diff").alias("v")), shadow.select(*by, "t", "v"), by, coarse=coarse, fine=fine)
    # a frame's time reads the other recording `lag` later
    late = timed.join(found.select(*by, F.col("lag").alias("drift")), by).withColumn("t", F.col("t") + F.col("drift"))
    return side_by_side(late, shadow, "t", by, 0.0)
