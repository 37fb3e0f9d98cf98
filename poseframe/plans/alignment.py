"""Moving one recording into the other's space: head pairs, windows that adapt to residuals, transforms for every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.functions.scratch import stored
from poseframe.operators import fits, series
from poseframe.operators.asof import asof_join, between, bracketed
from poseframe.operators.blocks import ROWS, changes_numbered, joined


def head_pairs(steps: DataFrame, detected: DataFrame, aligned: DataFrame, matches: DataFrame, positions: DataFrame, transform, by: list[str], reach: int = 300, height: float = 0.3) -> DataFrame:
    """Per step (by, step_idx): the head at its middle frame (hsx ..) and the camera there in the other space (hdx ..), `valid`.

    The middle frame is looked up in detected (by, frame, Head_x ..) and aligned (by, frame, dji_frame): the first row at or
    after it, past the end the last; in aligned no more than `reach` frames away. matches (dji_frame, aria_frame) and positions
    (frame_name, x, y, z) lead to the camera, which the inverse of the 4 x 4 transform moves. A pair counts if the camera
    stands `height` above the step's ground, or the ground isn't known. Of repeated names, and of repeated frames in matches, the
    last row counts: the one with the largest `nth` where the table has that column, else with the largest values.
    """
    mid = steps.withColumn("frame", F.floor((F.col("frame_start") + F.col("frame_end")) / 2))
    src = asof_join(mid, detected.select(*by, "frame", "Head_x", "Head_y", "Head_z"), "frame", by, direction="forward", clamp=True).drop("r_frame")
    met = asof_join(src, aligned.select(*by, "frame", "dji_frame"), "frame", by, direction="forward", clamp=True)
    near = F.abs(F.col("r_frame") - F.col("frame")) <= reach
    met = met.withColumn("dji_frame", F.when(near, F.col("r_dji_frame")))
    rows, shift = V.inverse_transform(transform)
    where = dict(zip(fits.HD, V.rigid(rows, shift, V.vec("x", "y", "z")), strict=True))
    places = _last_of(positions, "frame_name", ["x", "y", "z"]).select("frame_name", *[c.alias(n) for n, c in where.items()])
    names = _last_of(matches, "dji_frame", ["aria_frame"]).select("dji_frame", F.col("aria_frame").alias("frame_name"))
    out = met.join(names.join(places, "frame_name"), "dji_frame", "left")
    sound = F.col("hdx").isNotNull() & (F.col("median_hit_z").isNull() | (F.col("hdz") - F.col("median_hit_z") >= height))
    return out.select(*by, "step_idx", *[F.col(f"r_Head_{a}").alias(h) for a, h in zip("xyz", fits.HS, strict=True)], *fits.HD, sound.alias("valid"))


def _last_of(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for each key, with the values of its last row."""
    order = F.struct(*(["nth"] if "nth" in df.columns else []), *values)
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(key, "_v.*")


def _length(x: list[Column]) -> Column:
    return F.sqrt(x[0] ** 2 + x[1] ** 2 + x[2] ** 2)


def _misfit() -> Column:
    x, y, z = fits.applied(F.col("r"), F.col("t"), 1.0)
    return F.when(fits.valid_pairs(), _length([F.col("dx") - x, F.col("dy") - y, F.col("dz") - z]))


def _smoothed(fit: DataFrame, by: list[str], order: str, sigma: float, rows: int = ROWS) -> DataFrame:
    """q (x, y, z, w) and t of rows with r and t, smoothed component by component, q of length 1; and the moved source ax, ay, az."""
    r = tuple(tuple(F.col("r")[3 * i + j] for j in range(3)) for i in range(3))
    q = [f"_q{i}" for i in range(4)]
    t = [f"_t{i}" for i in range(3)]
    out = fit.withColumns(dict(zip(q, V.quaternion_of(r), strict=True)) | {n: F.col("t")[i] for i, n in enumerate(t)})
    # neighbours on one hemisphere: a sign is turned wherever the product with the row before is negative
    product = sum((F.col(c) * F.col(f"_was{c}") for c in q[1:]), F.col(q[0]) * F.col(f"_was{q[0]}"))
    out = changes_numbered(stored(out, "fits"), by, order, {f"_was{c}": F.col(c) for c in q}, product < 0, "_turns", rows)
    sign = F.when(F.col("_turns") % 2 == 1, -1.0).otherwise(1.0)
    out = out.withColumns({c: F.col(c) * sign for c in q})
    out = series.gaussian_smooth(out, by, order, [*q, *t], sigma, rows)
    n = F.sqrt(sum((F.col(c) ** 2 for c in q[1:]), F.col(q[0]) ** 2))
    unit = [F.when(n > 0, F.col(c) / n).otherwise(F.col(c)) for c in q]
    out = out.withColumn("q", F.array(*unit)).withColumn("t", F.array(*t))
    moved = V.rigid(V.rotation_of(tuple(F.col("q")[i] for i in range(4))), tuple(F.col("t")[i] for i in range(3)), V.vec(*fits.S))
    return out.withColumns(dict(zip(("ax", "ay", "az"), moved, strict=True))).drop(*q, *t, "_turns", "r", "c")


def adaptive_alignment(
    df: DataFrame, by: list[str], order: str, *, widest: int = 60, narrowest: int = 8, times: float = 1.5, sigma: float = 5.0, rotate: bool = True, second: bool = False
) -> DataFrame:
    """Two passes of window fits: the first's residuals narrow the windows of the second where the fit is poor.

    df has the pairs sx .. dz of each row, and the second pairs hsx .. hdz if second. Adds ax, ay, az (the moved source), q, t,
    width and residual (the first pass's, on the line between valid rows). rotate: a rotation for each row; else one for the
    series and only the translations follow the windows, and the first pass leaves second pairs out of these.
    """
    if rotate:
        first = fits.windowed_fit(df, by, order, F.lit(widest), second=second)
    else:
        first = fits.windowed_shift(df, by, order, F.lit(widest), second=False, second_in_rotation=second)
    misfits = stored(first.select(*by, order, _misfit().alias("residual")), "residuals")
    res = series.gaps_filled(misfits, by, order, "residual")
    res = joined(res, res.groupBy(*by).agg(F.avg("residual").alias("_m"), F.stddev_pop("residual").alias("_s")), by)
    clip = lambda c: F.greatest(F.lit(narrowest), F.least(F.lit(widest), c))
    res = res.withColumn("width", clip(series.adaptive_width(F.col("residual"), F.col("_m"), F.col("_s"), widest, narrowest, times)).cast("double"))
    res = series.gaussian_smooth(res, by, order, ["width"], sigma).withColumn("width", clip(F.bround("width").cast("int")))
    rows = stored(df.join(res.select(*by, order, "residual", "width"), [*by, order]), "widths")
    fit = fits.windowed_fit(rows, by, order, F.col("width"), second=second) if rotate else fits.windowed_shift(rows, by, order, F.col("width"), second=second)
    return _smoothed(fit, by, order, sigma)


def segment_alignment(df: DataFrame, by: list[str], order: str, label: str, sigma: float = 5.0, second: bool = False) -> DataFrame:
    """One fit for each label of a series, smoothed across the borders; adds ax, ay, az, q, t."""
    return _smoothed(fits.segment_fit(df, by, label, second), by, order, sigma)


def frame_transforms(anchors: DataFrame, frames: DataFrame, by: list[str], on: str) -> DataFrame:
    """frames with q, t and scale between those of the anchors (by, on, q, t, scale) around them, held beyond the ends.

    Rotations go the shorter way at even speed, the rest on a line. A series without anchors has nulls.
    """
    out = bracketed(frames, anchors.select(*by, on, "q", "t", "scale"), on, by)
    out = out.withColumns({"_f": F.coalesce(between(on), F.lit(0.0)), "_a": F.coalesce("_p", "_n"), "_b": F.coalesce("_n", "_p")}).drop("_p", "_n")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    f, dot = F.col("_f"), F.col("_dot")
    # a column for each step, so that none is worked out again for each component
    out = out.withColumn("_dot", total(F.zip_with("_a.q", "_b.q", lambda x, y: x * y)))
    out = out.withColumns({"_angle": F.acos(F.least(F.abs(dot), F.lit(1.0))), "_near": F.abs(dot) > 0.9999999})
    part = lambda share: F.when(F.col("_near"), share).otherwise(F.sin(share * F.col("_angle")) / F.sin("_angle"))
    out = out.withColumns({"_u": part(1 - f), "_v": part(f) * F.when(dot < 0, -1.0).otherwise(1.0)})
    out = out.withColumn("_m", F.zip_with("_a.q", "_b.q", lambda x, y: F.col("_u") * x + F.col("_v") * y))
    out = out.withColumn("_length", F.sqrt(total(F.transform("_m", lambda x: x * x))))
    line = lambda x, y: x + f * (y - x)
    out = out.withColumns({"q": F.transform("_m", lambda x: x / F.col("_length")), "t": F.zip_with("_a.t", "_b.t", line), "scale": line(F.col("_a.scale"), F.col("_b.scale"))})
    return out.drop("_f", "_a", "_b", "_dot", "_angle", "_near", "_u", "_v", "_m", "_length")
