"""Readers of the tables that one program of the pipeline hands to the next: aligned frames and transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poseframe.functions.text import number

CAMERA = [*(f"cam_pos_{a}" for a in "xyz"), *(f"cam_rot_r{i}{j}" for i in range(3) for j in range(3))]
GAZE = [f"gaze_{a}" for a in "xyz"]
#: Beyond this condition a transform can't be undone to a useful number of digits.
WORST = 1e12


def read_aligned_frames(spark: SparkSession, path: str) -> DataFrame:
    """The table of the aligned body from CSV: time, max_pressure_foot, {joint}_aligned_x, _y, _z, and camera and gaze.

    A joint that lacks an axis is left out. The camera's columns are there as a whole or all null, and so are the gaze's with
    gaze_valid, so that what reads the table needs no cases. Missing numbers in any spelling are null; gaze_valid is true for 1.
    """
    raw = spark.read.csv(path, header=True)
    have = set(raw.columns)
    joints = [c[: -len("_aligned_x")] for c in raw.columns if c.endswith("_aligned_x") and {f"{c[:-1]}y", f"{c[:-1]}z"} <= have]
    value = lambda c, whole=True: (number(F.col(c)) if whole and c in have else F.lit(None).cast("double")).alias(c)
    camera, gaze = set(CAMERA) <= have, {*GAZE, "gaze_valid"} <= have
    seen = F.coalesce(F.trim("gaze_valid") == "1", F.lit(False)) if gaze else F.lit(None).cast("boolean")
    foot = F.col("max_pressure_foot") if "max_pressure_foot" in have else F.lit(None).cast("string")
    columns = [value(f"{j}_aligned_{a}") for j in joints for a in "xyz"]
    return raw.select(value("time"), foot.alias("max_pressure_foot"), *columns, *[value(c, camera) for c in CAMERA], *[value(c, gaze) for c in GAZE], seen.alias("gaze_valid"))


def sized(values: Column, n: int) -> Column:
    """An array of n known finite numbers, else null."""
    return F.when((F.size(values) == n) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), values)


def step_transforms(table: DataFrame) -> DataFrame:
    """Rows (step_idx, q, t, scale) of a table with these columns: q of length 1, a scale of 1 where there is none.

    A row whose rotation or shift isn't whole, or whose rotation is all zeros, has nulls for both.
    """
    q, t = sized(F.col("q").cast("array<double>"), 4), sized(F.col("t").cast("array<double>"), 3)
    size = F.sqrt(F.aggregate("_q", F.lit(0.0), lambda a, x: a + x * x))
    scale = F.coalesce(F.col("scale").cast("double"), F.lit(1.0)) if "scale" in table.columns else F.lit(1.0)
    rows = table.select("step_idx", q.alias("_q"), t.alias("_t"), scale.alias("scale")).withColumn("_n", size)
    whole = F.col("_t").isNotNull() & (F.col("_n") > 0)
    return rows.select("step_idx", F.when(whole, F.transform("_q", lambda x: x / F.col("_n"))).alias("q"), F.when(whole, F.col("_t")).alias("t"), "scale")


def read_step_transforms(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """step_transforms() of Parquet or JSON files."""
    return step_transforms(spark.read.format(kind).load(path))


def alignment(table: DataFrame, column: str = "T_total", worst: float = WORST) -> tuple[np.ndarray, np.ndarray, float]:
    """The 4 x 4 transform of a one-row table (16 numbers, row by row), its inverse and its condition.

    A transform that isn't whole, doesn't end in 0 0 0 1 or has a worse condition than `worst` is an error, and so is any number
    of rows but one.
    """
    rows = table.select(sized(F.col(column).cast("array<double>"), 16).alias("m")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one transform is wanted, the table has {'none' if not rows else 'several'}")
    if rows[0]["m"] is None:
        raise ValueError("the transform isn't 16 known numbers")
    m = np.array(rows[0]["m"]).reshape(4, 4)
    if not np.allclose(m[3], [0, 0, 0, 1], atol=1e-9):
        raise ValueError("the transform's last row isn't 0 0 0 1")
    condition = float(np.linalg.cond(m))
    if not condition <= worst:
        raise ValueError(f"the transform can't be undone: its condition is {condition:.3g}")
    return m, np.linalg.inv(m), condition
