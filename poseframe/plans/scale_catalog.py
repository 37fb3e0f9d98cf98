"""Queries that force small blocks, cells and groups on the operators that cut long series and crowded places, and queries of clouds.

The first kind gives the rows of the query that doesn't cut, so it has that query's SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from poseframe import catalog as C
from poseframe.catalog import BY, ORACLES, kind, pairs_of, points, query, r6, r6_many, series_of, table
from poseframe.operators import clouds, fits, heat, series, spatial
from poseframe.operators.asof import resample_linear


@query(ORACLES["asof_late"])
def asof_cut(spark, sf):
    """As-of join whose series are cut by their counts, the nearest rows outside carried in."""
    return C._asof(spark, sf, tie="later", rows=12)


@query(ORACLES["asof_forward_clamped"])
def asof_cut_clamped(spark, sf):
    """First row at or after, past the end the last, in cut series."""
    return C._asof(spark, sf, direction="forward", clamp=True, rows=12)


@query(ORACLES["linear_resample"])
def resample_cut(spark, sf):
    """Interpolation between neighbours that may lie in other blocks."""
    e = series_of(spark, sf)
    at = kind(e, "error").select("user_id", "event_id", "us")
    return resample_linear(kind(e, "view").select("user_id", "us", "value"), at, "us", "value", BY, rows=10).select("event_id", r6(F.col("value")).alias("value"))


@query(ORACLES["slip_correction"])
def slip_correction_cut(spark, sf):
    """Slip correction with sums of blocks."""
    e = series_of(spark, sf).withColumn("foot", F.when(F.col("event_type") < "m", "LeftFoot").otherwise("RightFoot"))
    e = e.withColumn("lx", F.col("value")).withColumn("rx", F.col("value") / 2 + F.col("event_id") % 7).withColumn("body", F.col("value"))
    out = series.slip_corrected(e, BY, "us", "foot", {"LeftFoot": ["lx"], "RightFoot": ["rx"]}, [["body"]], rows=15)
    return out.select("event_id", r6(F.col("body")).alias("corrected"))


@query(ORACLES["island_starts"])
def island_starts_cut(spark, sf):
    """Runs that go over the borders of blocks."""
    return series.island_table(series_of(spark, sf), BY, "us", "event_type", rows=15).select("user_id", "island", "event_type", "start", "n", "next_start")


@query(ORACLES["window_means"])
def window_means_cut(spark, sf):
    """Window sums from two levels of prefix sums."""
    bounds = fits.window_bounds(pairs_of(spark, sf), BY, "us", F.lit(30), rows=20)
    s = fits.window_sums(bounds, BY, "us", rows=20).where("n > 0")
    return s.select("event_id", F.col("n").cast("bigint").alias("n"), r6(F.col("sum_sx") / F.col("n")).alias("msx"), r6(F.col("sum_dy") / F.col("n")).alias("mdy"))


@query(ORACLES["sliding_medians"])
def sliding_medians_cut(spark, sf):
    """Sliding medians in blocks with margins."""
    return series.sliding_median(series_of(spark, sf), BY, "us", "value", rows=15).select("event_id", "median")


@query(ORACLES["gaussian_smoothing"])
def gaussian_smoothing_cut(spark, sf):
    """Smoothing in blocks with margins, reflected at the series' ends."""
    return series.gaussian_smooth(series_of(spark, sf), BY, "us", ["value"], 2.0, rows=15).select("event_id", r6(F.col("value")).alias("value"))


@query(ORACLES["gap_fill"])
def gap_fill_cut(spark, sf):
    """Gaps whose ends lie in other blocks."""
    e = series_of(spark, sf).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return series.gaps_filled(e, BY, "us", "value", rows=15).select("event_id", r6(F.col("value")).alias("value"))


@query(ORACLES["mad_filter"])
def mad_filter_narrowed(spark, sf):
    """Medians of groups that are narrowed down before they are put in order (A2)."""
    return series.mad_keep(series_of(spark, sf), ["event_type"], "value", 2.0, most=25).select("event_id", "keep")


@query(ORACLES["outliers_blanked"])
def outliers_blanked_cut(spark, sf):
    """Outliers of cut series with narrowed medians."""
    e = series_of(spark, sf).select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return series.outliers_blanked(e, ["event_type"], "event_id", ["value"], times=2.0, rows=64, most=64).select("event_id", "outlier", "value")


@query(ORACLES["turn_segments"])
def turn_segments_cut(spark, sf):
    """Peaks and segments over blocks."""
    e = series_of(spark, sf).withColumn("turn", F.abs(F.col("value") - 250))
    breaks = series.peaks(e, BY, "us", "turn", 200.0, 5, rows=15)
    return series.segment_labels(e, breaks, BY, "us", rows=15).groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(ORACLES["radius_2d"])
def radius_crowded(spark, sf):
    """A radius join whose cells are all crowded, so that they are cut and dealt into lots."""
    p = points(spark, sf).select("vec_id", "x", "y")
    return spatial.radius_join(p, p, ["x", "y"], 0.05, crowd=3).select("vec_id", "r_vec_id", r6_many(F.col("distance")).alias("distance"))


@query(ORACLES["gaze_density"])
def density_crowded(spark, sf):
    """Kernel density over crowded cells."""
    p = points(spark, sf).select(F.col("vec_id").alias("pid"), "x", "y", "z", "label")
    d = spatial.density(p.drop("label"), p.where("label = 0").drop("label"), 0.05, 0.15, crowd=4)
    return d.select("pid", r6(F.col("weight")).alias("weight"), r6(F.col("share")).alias("share"))


# Meshes whose triangles differ in size ----------------------------------------------------------------------------------


_SIZED = C._MESH.replace(" WHERE vec_id % 5 = 0", "").replace("embedding] AS e FROM embeddings)", "embedding] AS e, CASE WHEN vec_id % 97 = 0 THEN 300 WHEN vec_id % 11 = 0 THEN 8 ELSE 0.25 END AS k FROM embeddings)")
_SIZED = _SIZED.replace("4 * e[1] + 1 AS bx, 4 * e[2] + e[4] AS by_, e[3] + e[5] AS bz, 4 * e[1] + e[6] AS cx, 4 * e[2] + 1 AS cy, e[3] + e[7] AS cz", "4 * e[1] + k AS bx, 4 * e[2] + k * e[4] AS by_, e[3] + e[5] AS bz, 4 * e[1] + k * e[6] AS cx, 4 * e[2] + k AS cy, e[3] + e[7] AS cz")


@query(_SIZED + "SELECT rid, round(min(t), 6) AS t, count(*) AS n_hits FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-9 GROUP BY rid")
def sized_mesh_hits(spark, sf):
    """All rays against triangles from a quarter to hundreds of units wide, each in the grid of its size."""
    rays, _ = C._rays_and_mesh(spark, sf)
    e = [F.col("embedding")[i].cast("double") for i in range(7)]
    k = F.when(F.col("vec_id") % 97 == 0, 300.0).when(F.col("vec_id") % 11 == 0, 8.0).otherwise(0.25)
    a, b, c = (4 * e[0], 4 * e[1], e[2]), (4 * e[0] + k, 4 * e[1] + k * e[3], e[2] + e[4]), (4 * e[0] + k * e[5], 4 * e[1] + k, e[2] + e[6])
    tri = table(spark, sf, "embeddings").select(F.col("vec_id").alias("fid"), *[x.alias(f"{n}{i}") for i, p in enumerate((a, b, c)) for n, x in zip("xyz", p, strict=True)])
    return spatial.mesh_hits(rays, tri).select("rid", r6("t").alias("t"), "n_hits")


# Clouds -----------------------------------------------------------------------------------------------------------------

_NEAR = 0.12
_COV = f"""WITH p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    m AS (SELECT a.pid, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.pid) AS k
      FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= {_NEAR} ** 2),
    c AS (SELECT pid, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM m WHERE k <= 30 GROUP BY pid),
    q AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS s FROM c),
    d AS (SELECT *, CASE WHEN s > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz ** 2) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / s ** 3 / 2 ELSE 0 END AS r FROM q)"""


@query(_COV + " SELECT pid, n, CASE WHEN n >= 3 THEN round(q + 2 * s * cos(acos(least(1, greatest(-1, r))) / 3 + 2 * pi() / 3), 6) + 0 END AS least, CASE WHEN n >= 3 THEN round(q + 2 * s * cos(acos(least(1, greatest(-1, r))) / 3 + 2 * pi() / 3), 6) + 0 END AS along FROM d")
def cloud_normals(spark, sf):
    """Normals of a cloud: the least spread of each neighbourhood, and the spread along the normal found, which is the same."""
    p = points(spark, sf).select(F.col("vec_id").alias("pid"), "x", "y", "z")
    n = clouds.cloud_normals(p, _NEAR).select("pid", "nx", "ny", "nz", "least")
    c = clouds.neighbour_sums(p, _NEAR).join(n, "pid")
    along = sum((F.col(f"n{a}") * F.col(f"n{b}") * F.col("".join(sorted(a + b))) for a in "xyz" for b in "xyz"), F.lit(0.0))
    return c.select("pid", "n", (r6(F.col("least")) + 0.0).alias("least"), F.when(F.col("n") >= 3, r6(along) + 0.0).alias("along"))


_STEP = """WITH p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings),
    m AS (SELECT s.pid, s.x AS px, s.y AS py, s.z AS pz, arg_min({'x': t.x, 'y': t.y, 'z': t.z, 'a': t.a / sqrt(t.a ** 2 + t.b ** 2 + t.c ** 2), 'b': t.b / sqrt(t.a ** 2 + t.b ** 2 + t.c ** 2), 'c': t.c / sqrt(t.a ** 2 + t.b ** 2 + t.c ** 2)},
      (sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2), t.pid)) AS t FROM p s JOIN p t ON s.pid % 2 = 0 AND t.pid % 2 = 1 AND (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 <= 0.04 GROUP BY ALL),
    j AS (SELECT [py * t.c - pz * t.b, pz * t.a - px * t.c, px * t.b - py * t.a, t.a, t.b, t.c, (px - t.x) * t.a + (py - t.y) * t.b + (pz - t.z) * t.c] AS j FROM m),
    k AS (SELECT unnest(range(1, 8)) AS i)
    SELECT a.i::INT AS i, b.i::INT AS k, round(sum(j[a.i] * j[b.i]), 5) AS total FROM j, k a, k b WHERE a.i <= b.i GROUP BY ALL"""


@query(_STEP)
def plane_step(spark, sf):
    """The 27 sums of one point-to-plane step, and the squared distances (G13): row and column of each."""
    p = points(spark, sf)
    n = F.sqrt(sum((F.col("embedding")[i].cast("double") ** 2 for i in (4, 5)), F.col("embedding")[3].cast("double") ** 2))
    goal = p.where("vec_id % 2 = 1").select(F.col("vec_id").alias("tid"), "x", "y", "z", *[(F.col("embedding")[3 + i].cast("double") / n).alias(c) for i, c in enumerate(("nx", "ny", "nz"))])
    moved = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pid"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    sums = clouds.plane_sums(clouds.nearest_planes(moved, goal, 0.2))
    at = {name: i for i, name in enumerate([*clouds.MOTION, "e"], 1)}
    cells = [F.struct(F.lit(at[c.rsplit("_", 1)[0]]).alias("i"), F.lit(at[c.rsplit("_", 1)[1]]).alias("k"), F.round(c, 5).alias("total")) for c in [*clouds.NORMAL_SUMS, "e_e"]]
    return sums.select(F.inline(F.array(*cells)))


# Going back -------------------------------------------------------------------------------------------------------------

_ASKED = [400, 90, 700, 89, 0, -5]


@query(
    C.EV + f"SELECT t AS at, event_id % 60 AS pid, round(sum(value), 5) AS weight FROM (SELECT value, event_id, h - (SELECT min(h) FROM ev) AS frame FROM ev), (SELECT unnest({_ASKED}) AS t) WHERE frame <= t GROUP BY ALL"
)
def heat_rewind(spark, sf):
    """The heat map at frames asked for in any order, from snapshots and short tails."""
    e = series_of(spark, sf)
    first = e.agg(F.min("h").alias("_h0"))  # one row
    rows = e.join(F.broadcast(first)).select((F.col("h") - F.col("_h0")).alias("frame"), (F.col("event_id") % 60).alias("pid"), F.col("value").alias("weight"))
    got = heat.heat_at(heat.heat_snapshots(rows, 90), rows, _ASKED, 90)
    return got.select("at", "pid", F.round("weight", 5).alias("weight"))
