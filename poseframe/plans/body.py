"""The aligned body: every joint of every frame moved into the other space, with camera and gaze, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.operators.blocks import ROWS
from poseframe.operators.series import slip_corrected
from poseframe.plans.alignment import frame_transforms
from poseframe.plans.steps import HEELS


def joints_of(frames: DataFrame) -> list[str]:
    """The joints of which frames has all three coordinates, in their order."""
    have = set(frames.columns)
    return [c[:-2] for c in frames.columns if c.endswith("_x") and {f"{c[:-2]}_y", f"{c[:-2]}_z"} <= have]


def aligned_body(frames: DataFrame, anchors: DataFrame, by: list[str], order: str, on: str, joints: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """frames with {joint}_aligned_x, _y, _z of each joint in place of {joint}_x ..: slip taken out, then moved by the frame's transform.

    frames: (by, order, on, max_pressure_foot, joints' coordinates, heels among them); anchors: (by, on, q, t, scale), between which each
    frame's transform lies. A joint without a coordinate, or a series without anchors, has nulls.
    """
    joints = joints or joints_of(frames)
    fixed = slip_corrected(frames, by, order, "max_pressure_foot", HEELS, [[f"{j}_{a}" for a in "xyz"] for j in joints], rows)
    own = ["q", "t", "scale"]  # names of frame_transforms
    placed = frame_transforms(anchors, fixed.drop(*own), by, on)
    # the nine numbers of a rotation once for all joints
    turn = V.rotation_of(tuple(F.col("q")[i] for i in range(4)))
    nine = {f"_r{i}{j}": turn[i][j] for i in range(3) for j in range(3)}
    placed = placed.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in nine.items()]))))
    matrix = tuple(V.vec(*[f"_r{i}{j}" for j in range(3)]) for i in range(3))
    shift = tuple(F.col("t")[i] for i in range(3))
    moved = {}
    for j in joints:
        at = V.rigid(matrix, shift, V.vec(*[f"{j}_{a}" for a in "xyz"]), F.col("scale"))
        moved |= {f"{j}_aligned_{a}": c for a, c in zip("xyz", at, strict=True)}
    return placed.withColumns(moved).drop(*nine, *[f"{j}_{a}" for j in joints for a in "xyz"], *own)


def body_table(body: DataFrame, gaze: DataFrame | None, by: list[str], head: str = "Head") -> DataFrame:
    """aligned_body() with camera and gaze: cam_pos_x .. z, cam_rot_r00 .. r22, gaze_x .. z and gaze_valid (1, 0, or null without gaze).

    gaze: rows of gaze_points(). The camera stands where the aligned head is and looks as the recording says. Frames without a
    camera keep their row with nulls; None leaves all of these columns null, so the table's columns are always the same.
    """
    place = {f"cam_pos_{a}": F.col(f"{head}_aligned_{a}") for a in "xyz"}
    turns = [f"r{i}{j}" for i in range(3) for j in range(3)]
    none = lambda kind: F.lit(None).cast(kind)
    if gaze is None:
        empty = {f"cam_pos_{a}": none("double") for a in "xyz"} | {f"cam_rot_{r}": none("double") for r in turns} | {f"gaze_{a}": none("double") for a in "xyz"}
        return body.withColumns(empty | {"gaze_valid": none("tinyint")})
    seen = gaze.select(*by, "dji_frame", *[F.col(r).alias(f"cam_rot_{r}") for r in turns], *[f"gaze_{a}" for a in "xyz"], F.col("gaze_valid").cast("tinyint").alias("gaze_valid"))
    one = seen.groupBy(*by, "dji_frame").agg(F.first(F.struct(*[c for c in seen.columns if c not in (*by, "dji_frame")])).alias("g")).select(*by, "dji_frame", "g.*")
    return body.withColumns(place).join(one, [*by, "dji_frame"], "left")
