"""Fits of noisy pairs. All points lie in a plane, where the best turn has a closed form that SQL can give: the angle of two sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from poseframe.catalog import BY, EV, query, series_of, table
from poseframe.functions.text import looked_up, odd, zero_padded
from poseframe.operators import fits

#: Pairs that a turn by 0.4 and a shift bring together but for a few tenths; every seventh is missing.
_NOISY = EV + """, p AS (SELECT user_id, event_id, us, event_id % 7 != 0 AS ok, value / 50 AS sx, (event_id % 13)::DOUBLE AS sy, cos(0.4) * value / 50 - sin(0.4) * (event_id % 13) + 3 + (event_id % 11) / 20.0::DOUBLE AS dx,
      sin(0.4) * value / 50 + cos(0.4) * (event_id % 13) - 1 + (event_id % 17) / 40.0::DOUBLE AS dy FROM ev) """
#: Angle and means of a group of pairs.
_FIT = """atan2(sum(sx * dy - sy * dx) - sum(sx) * sum(dy) / count(*) + sum(sy) * sum(dx) / count(*), sum(sx * dx + sy * dy) - sum(sx) * sum(dx) / count(*) - sum(sy) * sum(dy) / count(*)) AS a,
      avg(sx) AS mx, avg(sy) AS my, avg(dx) AS nx, avg(dy) AS ny, count(*) AS n"""
_MISS = "sqrt((dx - nx - cos(a) * (sx - mx) + sin(a) * (sy - my)) ** 2 + (dy - ny - sin(a) * (sx - mx) - cos(a) * (sy - my)) ** 2)"


def _pairs(spark, sf):
    e = series_of(spark, sf)
    x, y = F.col("value") / 50, (F.col("event_id") % 13).cast("double")
    c, s = F.cos(F.lit(0.4)), F.sin(F.lit(0.4))
    dst = (c * x - s * y + 3 + F.col("event_id") % 11 / 20.0, s * x + c * y - 1 + F.col("event_id") % 17 / 40.0, F.lit(0.0))
    ok = F.col("event_id") % 7 != 0
    return e.select("user_id", "event_id", "us", *[F.when(ok, v).alias(n) for n, v in zip((*fits.S, *fits.D), (x, y, F.lit(0.0), *dst), strict=True)])


@query(_NOISY + f", f AS (SELECT user_id, {_FIT} FROM p WHERE ok GROUP BY user_id HAVING count(*) >= 3), r AS (SELECT user_id, {_MISS} AS r FROM p JOIN f USING (user_id) WHERE ok) SELECT user_id, round(sqrt(avg(r * r)), 5) AS rmse, round(avg(r), 5) AS mean, round(max(r), 5) AS worst FROM r GROUP BY user_id")
def noisy_residuals(spark, sf):
    """What a fit of a whole series leaves of noisy pairs."""
    p = _pairs(spark, sf)
    report = fits.residual_report(fits.residuals(p, fits.global_fit(p, BY).where("r is not null"), BY), BY)
    return report.select("user_id", *[F.round(c, 5).alias(c) for c in ("rmse", "mean", "worst")])


@query(
    _NOISY + f""", a AS (SELECT *, (sum(ok::INT) OVER (PARTITION BY user_id))::INT AS nv, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM p),
    b AS (SELECT *, least(nv, greatest(0, least(before, nv - 1) - 6) + 12) AS hi FROM a), c AS (SELECT *, greatest(0, hi - 12) AS lo FROM b), v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS k FROM p WHERE ok),
    w AS (SELECT c.event_id, v.sx, v.sy, v.dx, v.dy FROM c JOIN v ON c.user_id = v.user_id AND v.k >= c.lo AND v.k < c.hi), f AS (SELECT event_id, {_FIT} FROM w GROUP BY event_id HAVING count(*) >= 3)
    SELECT event_id, CASE WHEN ok THEN round({_MISS}, 4) END AS residual, n FROM p JOIN f USING (event_id)"""
)
def noisy_windows(spark, sf):
    """What the fit in each row's window leaves of its noisy pair, windows cut from a series in blocks."""
    p = _pairs(spark, sf)
    f = fits.windowed_fit(p, BY, "us", F.lit(12), rows=30, pairs="n")
    x, y, _ = fits.applied(F.col("r"), F.col("t"), F.col("c"))
    d = F.sqrt((F.col("dx") - x) ** 2 + (F.col("dy") - y) ** 2)
    return f.where("n >= 3").select("event_id", F.round(d, 4).alias("residual"), F.col("n").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 12 THEN lpad(p_partkey::VARCHAR, 12, '0') ELSE p_partkey::VARCHAR END AS name, p_size | 1 AS kernel, CASE p_size % 3 WHEN 0 THEN 'LeftHeel' WHEN 1 THEN 'RightHeel' ELSE 'none' END AS joint FROM part")
def names_and_kernels(spark, sf):
    """Numbers of frames in names, odd sizes of kernels, a fixed table's values (2.12)."""
    p = table(spark, sf, "part")
    joint = looked_up((F.col("p_size") % 3).cast("string"), {"0": "LeftHeel", "1": "RightHeel"}, "none")
    return p.select("p_partkey", zero_padded(F.col("p_partkey"), 12).alias("name"), odd(F.col("p_size")).alias("kernel"), joint.alias("joint"))
