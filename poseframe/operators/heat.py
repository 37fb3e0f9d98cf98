"""A heat map over time that can go back: snapshots by blocks of frames, and the few contributions after one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heat_snapshots(contributions: DataFrame, every: int) -> DataFrame:
    """Per point (pid) its weight so far after each block of `every` frames in which it changed: since, until, weight.

    contributions: (frame, pid, weight). The row holds from the end of block since - 1 to the start of block until - 1, counted in
    blocks; until is null for the last. Blocks add up first, so what one task holds of a point are its blocks.
    """
    known = contributions.where("frame is not null and pid is not null and weight is not null")
    sums = known.groupBy("pid", F.floor(F.col("frame") / every).alias("block")).agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("pid").orderBy("block")
    total = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("pid", (F.col("block") + 1).alias("since"), (F.lead("block").over(w) + 1).alias("until"), total.alias("weight"))


def heat_at(snapshots: DataFrame, contributions: DataFrame, frames: list[int], every: int) -> DataFrame:
    """Per asked frame (at) and point with any weight by then: the weight of all contributions up to that frame, included.

    Each frame, in any order, reads one snapshot row of a point and the contributions of its own block, however far it
    lies behind the one before. The frames asked for are a short list, which every task gets.
    """
    spark = contributions.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(f), int(f) // every) for f in dict.fromkeys(frames)], "at long, _block long"))
    base = snapshots.join(asked, (F.col("since") <= F.col("_block")) & (F.col("until").isNull() | (F.col("until") > F.col("_block")))).select("at", "pid", "weight")
    near = contributions.where("frame is not null and pid is not null and weight is not null").withColumn("_block", F.floor(F.col("frame") / every))
    tail = near.join(asked, "_block").where("frame <= at").select("at", "pid", "weight")
    return base.unionByName(tail).groupBy("at", "pid").agg(F.sum("weight").alias("weight"))
