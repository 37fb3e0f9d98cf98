"""From aligned frames and poses to a table of footsteps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseframe.operators.series import slip_corrected
from poseframe.plans.clock_sync import LEFT_HEEL, RIGHT_HEEL

HEELS = {foot: [f"{side}Heel_{a}" for a in "xyz"] for foot, side in (("LeftFoot", "Left"), ("RightFoot", "Right"))}


def heel_rows(steps: DataFrame, poses: DataFrame, by: list[str], order: str, least: float = 0.3, fps: float = 30.0) -> DataFrame:
    """One row for each pose frame with an aligned row: the standing foot's heel in the image and in the recording.

    Of rows with one dji_frame the last by `order` counts. Frames from the number of poses on, without a pose or with a heel
    under `least` confidence are left out.
    """
    one = steps.groupBy(*by, "dji_frame").agg(F.max_by(F.struct("max_pressure_foot", *[c for cols in HEELS.values() for c in cols]), order).alias("s")).select(*by, "dji_frame", "s.*")
    total = poses.groupBy(*by).agg(F.count("*").alias("_n"))
    # of a pose only its heels are moved
    heels = poses.select(*by, F.col("frame").alias("dji_frame"), *[F.get("keypoints", F.lit(3 * heel + k)).alias(f"_{side}{k}") for side, heel in (("l", LEFT_HEEL), ("r", RIGHT_HEEL)) for k in range(3)])
    met = one.join(heels, [*by, "dji_frame"]).join(total, by).where("dji_frame >= 0 and dji_frame < _n")
    left = F.col("max_pressure_foot") == "LeftFoot"
    at = lambda k: F.when(left, F.col(f"_l{k}")).otherwise(F.col(f"_r{k}"))
    shadow = [F.when(left, F.col(a)).otherwise(F.col(b)).alias(f"shadow_{c}") for a, b, c in zip(*HEELS.values(), "xyz", strict=True)]
    rows = met.select(*by, "dji_frame", (F.col("dji_frame") / fps).alias("video_t"), "max_pressure_foot", at(0).alias("heel_x"), at(1).alias("heel_y"), at(2).alias("heel_conf"), *shadow)
    return rows.where(F.col("heel_conf") >= least)


def step_table(frames: DataFrame, hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each step that another one follows: medians of its hits on the ground and its heel, slip taken out.

    frames: (by, order, frame, dji_frame, max_pressure_foot, heels); hits: (by, dji_frame, hit_x, hit_y, hit_z, outlier), one
    for a frame. Hits that are outliers or lack a coordinate don't count; a step without any has null medians.
    """
    fixed = slip_corrected(frames, by, order, "max_pressure_foot", HEELS, list(HEELS.values()))
    sure = hits.where("not outlier and hit_x is not null and hit_y is not null and hit_z is not null").drop("outlier")
    rows = fixed.join(sure, [*by, "dji_frame"], "left")
    left = F.col("max_pressure_foot") == "LeftFoot"
    heel = F.struct("frame", "max_pressure_foot", *[F.when(left, F.col(a)).otherwise(F.col(b)).alias(f"shadow_heel_{c}") for a, b, c in zip(*HEELS.values(), "xyz", strict=True)])
    steps = rows.groupBy(*by, F.col("island").alias("step_idx")).agg(
        F.min_by(heel, order).alias("first"), F.count("*").alias("n_frames"), F.count("hit_x").alias("n_valid"), *[F.median(f"hit_{c}").alias(f"median_hit_{c}") for c in "xyz"]
    )
    after = F.lead("first.frame").over(Window.partitionBy(*by).orderBy("step_idx"))
    out = steps.withColumn("frame_end", after).where("frame_end is not null")
    return out.select(
        *by, "step_idx", F.col("first.max_pressure_foot").alias("stance_foot"), F.col("first.frame").alias("frame_start"), "frame_end", "n_frames", "n_valid",
        *[f"median_hit_{c}" for c in "xyz"], *[F.col(f"first.shadow_heel_{c}").alias(f"shadow_heel_{c}") for c in "xyz"],
    )
