"""Where feet touch the ground: from poses and cameras over a mesh to the table of steps, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.functions.scratch import stored
from poseframe.operators.series import outliers_blanked
from poseframe.operators.spatial import ray_hits
from poseframe.plans.steps import heel_rows, step_table

#: Turns a camera's world with y up into the mesh's with z up.
UPRIGHT = [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, -1.0, 0.0]]
#: How far above and below the mesh rays are followed.
PADDING = 0.5


def heel_rays(heels: DataFrame, cameras: DataFrame, by: list[str], fix=UPRIGHT) -> DataFrame:
    """heels (by, dji_frame, heel_x, heel_y and more) with the ray through the heel's pixel: ox .. oz, dx .. dz of length 1.

    cameras: (frame, px .. pz, r, fl_x, fl_y, cx, cy), and columns of `by` where a recording has its own; of repeated frames the
    one with the largest values counts. fix: a 3 x 3 of numbers from the cameras' world into the mesh's. Without a camera a heel
    has no row.
    """
    keys = [c for c in by if c in cameras.columns]
    values = ["px", "py", "pz", "r", "fl_x", "fl_y", "cx", "cy"]
    one = cameras.groupBy(*keys, F.col("frame").alias("dji_frame")).agg(F.max_by(F.struct(*values), F.struct(*values)).alias("c")).select(*keys, "dji_frame", "c.*")
    met = heels.join(one, [*keys, "dji_frame"])
    look = V.pixel_ray(F.col("heel_x"), F.col("heel_y"), F.col("fl_x"), F.col("fl_y"), F.col("cx"), F.col("cy"))
    turn = tuple(tuple(F.col("r")[3 * i + j] for j in range(3)) for i in range(3))
    rows = V.literal_rows(fix)
    met = met.withColumns(dict(zip(("_l0", "_l1", "_l2"), look, strict=True)))
    way = V.unit(V.rotate(rows, V.rotate(turn, V.vec("_l0", "_l1", "_l2"))))
    place = V.rotate(rows, V.vec("px", "py", "pz"))
    out = met.withColumns(dict(zip(("ox", "oy", "oz"), place, strict=True)) | dict(zip(("dx", "dy", "dz"), way, strict=True)))
    return out.drop("_l0", "_l1", "_l2", *values)


def heel_hits(heels: DataFrame, cameras: DataFrame, tris: DataFrame, by: list[str], *, fix=UPRIGHT, radius: float = 0.5, ground: float = 0.7, width: int = 21, times: float = 10.0) -> DataFrame:
    """Per heel with a camera where its ray meets the mesh: hit_x .. hit_z, hit_is_ground, n_candidates, outlier.

    heels: rows of heel_rows(). A heel whose ray meets nothing has nulls; one whose hit is far from the median of its foot's
    hits around it in time is an outlier: it loses its coordinates and isn't ground.
    """
    rays = stored(heel_rays(heels, cameras, by, fix).withColumn("rid", F.struct(*by, "dji_frame")), "heel-rays")
    box = tris.agg(F.min(F.least("z0", "z1", "z2")).alias("lo"), F.max(F.greatest("z0", "z1", "z2")).alias("hi")).first()  # one row
    lo, hi = (0.0 if x is None else float(x) for x in box)
    met = ray_hits(rays.select("rid", *[f"{a}{c}" for a in "od" for c in "xyz"]), tris, radius=radius, zlo=lo - PADDING, zhi=hi + PADDING, ground=ground, hits=False)
    found = met.select("rid", *[F.col(f"h{c}").alias(f"hit_{c}") for c in "xyz"], F.coalesce("on_ground", F.lit(False)).alias("hit_is_ground"), "n_candidates")
    hits = rays.drop(*[f"{a}{c}" for a in "od" for c in "xyz"]).join(found, "rid").drop("rid")
    out = outliers_blanked(stored(hits, "heel-hits"), [*by, "max_pressure_foot"], "dji_frame", ["hit_x", "hit_y", "hit_z"], width, times)
    return out.withColumn("hit_is_ground", F.col("hit_is_ground") & ~F.col("outlier"))


def contact_table(steps: DataFrame, poses: DataFrame, cameras: DataFrame, tris: DataFrame, by: list[str], order: str, *, least: float = 0.0, fix=UPRIGHT, **how) -> DataFrame:
    """The table of steps from the aligned rows (by, order, frame, dji_frame, max_pressure_foot, heels), poses, cameras and triangles.

    Heels in the image become rays, rays become hits on the mesh, hits without outliers become medians for each step, and the
    heels' slip is taken out; see heel_rows(), heel_hits() and step_table() for what each leaves out.
    """
    heels = heel_rows(steps, poses, by, order, least)
    hits = heel_hits(heels, cameras, tris, by, fix=fix, **how)
    return step_table(steps, hits.select(*by, "dji_frame", "hit_x", "hit_y", "hit_z", "outlier"), by, order)


def miss_counts(steps: DataFrame, poses: DataFrame, cameras: DataFrame, by: list[str], order: str, least: float = 0.0) -> DataFrame:
    """Per recording how many pose frames fall out and why: no_row, no_pose, low_confidence, no_camera; and kept.

    Frames are 0 to the number of poses less one, as many as there are pose rows. Each counts under the first reason that holds.
    """
    from poseframe.plans.clock_sync import LEFT_HEEL, RIGHT_HEEL

    spans = poses.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("dji_frame"))
    one = steps.groupBy(*by, "dji_frame").agg(F.max_by("max_pressure_foot", order).alias("_foot"))
    # of a pose only its heels' confidences are moved
    sure = F.struct(F.col("keypoints").isNull().alias("none"), *[F.get("keypoints", F.lit(3 * heel + 2)).alias(side) for side, heel in (("l", LEFT_HEEL), ("r", RIGHT_HEEL))])
    seen = poses.groupBy(*by, F.col("frame").alias("dji_frame")).agg(F.first(sure).alias("_k"))
    keys = [c for c in by if c in cameras.columns]
    cams = cameras.select(*keys, F.col("frame").alias("dji_frame"), F.lit(True).alias("_cam")).distinct()
    rows = spans.join(one, [*by, "dji_frame"], "left").join(seen, [*by, "dji_frame"], "left").join(cams, [*keys, "dji_frame"], "left")
    sure = F.when(F.col("_foot") == "LeftFoot", F.col("_k.l")).otherwise(F.col("_k.r"))
    why = F.when(F.col("_foot").isNull(), "no_row").when(F.coalesce(F.col("_k.none"), F.lit(True)), "no_pose").when(~F.coalesce(sure >= least, F.lit(False)), "low_confidence").when(F.col("_cam").isNull(), "no_camera").otherwise("kept")
    kinds = ("no_row", "no_pose", "low_confidence", "no_camera", "kept")
    return rows.groupBy(*by).agg(*[F.count_if(why == k).alias(k) for k in kinds])
