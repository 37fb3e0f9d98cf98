"""Gaze of a head-worn camera as points on a surface of another space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.operators.asof import asof_join
from poseframe.operators.spatial import mesh_hits

FARTHEST = 200.0


def camera_rays(frames: DataFrame, matches: DataFrame, trajectory: DataFrame, gaze: DataFrame, device, world, lens: tuple[float, float, float, float], by: list[str]) -> DataFrame:
    """Per frame (by, dji_frame): the camera's place ox, oy, oz and rotation r00 .. r22, and the gaze's direction dx, dy, dz.

    matches (by, dji_frame, ts) give a frame's time, trajectory (by, ts, track, px .. pz, qx .. qw) the device's pose nearest to
    it, gaze (by, track, u, v, seen) the gaze nearest to that; of two equally near rows the later. device: (q, t), numbers, of the
    camera on the device; world: a 4 x 4 transform of numbers into the other space; lens: fx, fy, cx, cy. A frame without a
    time or pose has nulls, one without a gaze has no direction.
    """
    rows = frames.join(matches.select(*by, "dji_frame", "ts"), [*by, "dji_frame"], "left")
    rows = asof_join(rows, trajectory, "ts", by, tie="later").withColumnRenamed("r_track", "track")
    rows = asof_join(rows, gaze, "track", by, tie="later")
    dq, dt = (tuple(F.lit(float(x)) for x in v) for v in device)
    out_r, out_t = V.literal_rows(world), tuple(F.lit(float(world[i][3])) for i in range(3))
    nine = lambda p: [f"{p}{i}{j}" for i in range(3) for j in range(3)]
    matrix = lambda p: tuple(V.vec(*[f"{p}{i}{j}" for j in range(3)]) for i in range(3))
    flat = lambda rows, p: dict(zip(nine(p), (c for row in rows for c in row), strict=True))
    lens_at = tuple(F.lit(float(x)) for x in lens)
    eye = V.pixel_ray(F.col("r_u"), F.col("r_v"), *lens_at, forward=1)
    rows = _settled(rows, flat(V.rotation_of(tuple(F.col(f"r_q{c}") for c in "xyzw")), "_w") | dict(zip(("_l0", "_l1", "_l2"), eye, strict=True)))
    turn = V.compose(out_r, V.compose(matrix("_w"), V.rotation_of(dq)))
    place = V.rigid(out_r, out_t, V.rigid(matrix("_w"), V.vec("r_px", "r_py", "r_pz"), dt))
    rows = _settled(rows, flat(turn, "r") | dict(zip(("ox", "oy", "oz"), place, strict=True)))
    rows = _settled(rows, dict(zip(("_g0", "_g1", "_g2"), V.rotate(matrix("r"), V.vec("_l0", "_l1", "_l2")), strict=True)))
    seen = F.coalesce(F.col("r_seen"), F.lit(False))
    look = dict(zip(("dx", "dy", "dz"), (F.when(seen, c) for c in V.unit(V.vec("_g0", "_g1", "_g2"))), strict=True))
    return _settled(rows, look).select(*by, "dji_frame", "ox", "oy", "oz", *nine("r"), "dx", "dy", "dz")


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each worked out once: what later steps ask of them isn't pushed back into their formulas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def gaze_points(rays: DataFrame, tris: DataFrame | None, by: list[str], farthest: float = FARTHEST) -> DataFrame:
    """rays with gaze_x, gaze_y, gaze_z and gaze_valid: the nearest hit on the surface no farther than `farthest`.

    Without a surface every gaze is missing.
    """
    none = F.lit(None).cast("double")
    if tris is None:
        return rays.withColumns({f"gaze_{c}": none for c in "xyz"} | {"gaze_valid": F.lit(False)})
    keyed = rays.withColumn("rid", F.struct(*by, "dji_frame"))
    hits = mesh_hits(keyed.where("dx is not null").select("rid", "ox", "oy", "oz", "dx", "dy", "dz"), tris).where(F.col("t") <= farthest)
    out = keyed.join(hits.select("rid", "t"), "rid", "left")
    points = {f"gaze_{c}": F.col(f"o{c}") + F.col(f"d{c}") * F.col("t") for c in "xyz"}
    return out.withColumns(points).withColumn("gaze_valid", F.col("t").isNotNull()).drop("rid", "t")
