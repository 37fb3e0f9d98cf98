"""All queries of the engine by name, each with the SQL that gives the same rows.

The driver's tables stand in for recordings: a user's events are a series in time, embeddings are points and rays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.functions.text import clock, iso_start, micros, number
from poseframe.operators import fits, series, spatial
from poseframe.operators.asof import asof_join, resample_linear

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "asof_early"
BY = ["user_id"]
HOUR = 3_600_000_000
EV = "WITH ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS h FROM events) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def series_of(spark: SparkSession, sf: str) -> DataFrame:
    us = micros("ts")
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", us.alias("us")).withColumn("h", F.floor(F.col("us") / HOUR))


def kind(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("event_type") == name)


def r6(c):
    return F.round(c, 6)


def r6_many(c):
    """r6 as the SQL's engine does it, by multiplying, for numbers from 0 to 10**12: F.round() goes through a decimal text of each number."""
    return F.floor(c * 1e6 + 0.5) / 1e6


# Joins in time ------------------------------------------------------------------------------------------------------


def _asof_sql(order: str, where: str = "", fallback: str = "") -> str:
    inner = f"SELECT r.event_id FROM ev r WHERE r.user_id = l.user_id AND r.event_type = 'view' {where} ORDER BY {order} LIMIT 1"
    return EV + f"SELECT l.event_id, ({inner}){fallback} AS r_event_id FROM ev l WHERE l.event_type = 'click'"


def _asof(spark: SparkSession, sf: str, **how) -> DataFrame:
    e = series_of(spark, sf)
    left = kind(e, "click").select("user_id", "event_id", "h")
    right = kind(e, "view").select("user_id", "event_id", "h")
    return asof_join(left, right, "h", BY, order="event_id", **how).select("event_id", "r_event_id")


@query(_asof_sql("abs(r.h - l.h), r.h, r.event_id"))
def asof_early(spark, sf):
    """Nearest row; of two equally near ones the earlier."""
    return _asof(spark, sf)


@query(_asof_sql("abs(r.h - l.h), r.h DESC, r.event_id"))
def asof_late(spark, sf):
    """Nearest row; of two equally near ones the later."""
    return _asof(spark, sf, tie="later")


@query(_asof_sql("abs(r.h - l.h), r.h, r.event_id"))
def asof_blocks(spark, sf):
    """Nearest row with long series cut into spans of two days."""
    return _asof(spark, sf, block=48)


@query(_asof_sql("r.h, r.event_id", "AND r.h >= l.h AND r.h - l.h <= 30"))
def asof_forward_tolerance(spark, sf):
    """First row at or after, within a tolerance."""
    return _asof(spark, sf, direction="forward", tolerance=30)


@query(_asof_sql("r.h < l.h, CASE WHEN r.h >= l.h THEN r.h ELSE -r.h END, r.event_id"))
def asof_forward_clamped(spark, sf):
    """First row at or after; past the end the last row."""
    return _asof(spark, sf, direction="forward", clamp=True)


@query(_asof_sql("r.h DESC, r.event_id", "AND r.h <= l.h"))
def asof_backward(spark, sf):
    return _asof(spark, sf, direction="backward")


@query(
    EV + """, k AS (SELECT user_id, us, value FROM ev WHERE event_type = 'view'),
    a AS (SELECT l.event_id, l.us, (SELECT {'t': k.us, 'v': k.value} FROM k WHERE k.user_id = l.user_id AND k.us <= l.us ORDER BY k.us DESC LIMIT 1) AS p,
      (SELECT {'t': k.us, 'v': k.value} FROM k WHERE k.user_id = l.user_id AND k.us >= l.us ORDER BY k.us LIMIT 1) AS n FROM ev l WHERE l.event_type = 'error')
    SELECT event_id, round(CASE WHEN n.t > p.t THEN p.v + (us - p.t) / (n.t - p.t) * (n.v - p.v) ELSE coalesce(p.v, n.v) END, 6) AS value FROM a"""
)
def linear_resample(spark, sf):
    """Values at other times on the line between neighbours, held at the ends."""
    e = series_of(spark, sf)
    at = kind(e, "error").select("user_id", "event_id", "us")
    return resample_linear(kind(e, "view").select("user_id", "us", "value"), at, "us", "value", BY).select("event_id", r6(F.col("value")).alias("value"))


# Series -------------------------------------------------------------------------------------------------------------

_ISLANDS = EV + """, s AS (SELECT *, coalesce((event_type IS DISTINCT FROM lag(event_type) OVER w)::INT, 1) AS st, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    i AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 ELSE st END) OVER (PARTITION BY user_id ORDER BY us) - 1 AS island FROM s) """


@query(
    _ISLANDS + """, g AS (SELECT user_id, island, any_value(event_type) AS event_type, min(us) AS start, count(*) AS n FROM i GROUP BY ALL)
    SELECT user_id, island::BIGINT AS island, event_type, start, n, next_start FROM (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY island) AS next_start FROM g) WHERE next_start IS NOT NULL"""
)
def island_starts(spark, sf):
    """Runs of one value with the start of the next; the last is left out."""
    return series.island_table(series_of(spark, sf), BY, "us", "event_type").select("user_id", "island", "event_type", "start", "n", "next_start")


@query(
    EV + """, a AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 86400000000)::INT, 0) AS new FROM ev),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS run FROM a)
    SELECT user_id, run::BIGINT AS run, min(us) AS start, max(us) AS "end", count(*) AS n, min(value) AS least FROM b GROUP BY user_id, run"""
)
def gap_run_summaries(spark, sf):
    """Contiguous runs with their least value."""
    return series.gap_runs(series_of(spark, sf), BY, "us", 86_400_000_000, "value")


@query(
    _ISLANDS.replace("event_type IS DISTINCT FROM lag(event_type)", "(event_type < 'm') IS DISTINCT FROM lag(event_type < 'm')") + """,
    f AS (SELECT *, CASE WHEN event_type < 'm' THEN value ELSE value / 2 + event_id % 7 END AS heel FROM i),
    a AS (SELECT *, first_value(heel) OVER (PARTITION BY user_id, island ORDER BY us) AS s, max(island) OVER (PARTITION BY user_id) AS top,
      lead(island) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM f),
    b AS (SELECT *, coalesce(sum(CASE WHEN nx != island THEN s - heel ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM a)
    SELECT event_id, round(value + carry + CASE WHEN island < top THEN s - heel ELSE 0 END, 6) AS corrected FROM b"""
)
def slip_correction(spark, sf):
    """The standing foot is held still, its slip carried on."""
    e = series_of(spark, sf).withColumn("foot", F.when(F.col("event_type") < "m", "LeftFoot").otherwise("RightFoot"))
    e = e.withColumn("lx", F.col("value")).withColumn("rx", F.col("value") / 2 + F.col("event_id") % 7).withColumn("body", F.col("value"))
    out = series.slip_corrected(e, BY, "us", "foot", {"LeftFoot": ["lx"], "RightFoot": ["rx"]}, [["body"]])
    return out.select("event_id", r6(F.col("body")).alias("corrected"))


@query(
    EV + """, a AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
      row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM ev)
    SELECT event_id, list_sort([l[greatest(1, least(len(l), i + k))] FOR k IN range(-10, 11)])[11] AS median FROM a"""
)
def sliding_medians(spark, sf):
    """The median of 21 rows, ends repeated."""
    return series.sliding_median(series_of(spark, sf), BY, "us", "value").select("event_id", "median")


@query(
    EV + """, a AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS mid FROM ev), b AS (SELECT *, median(abs(value - mid)) OVER (PARTITION BY event_type) AS mad FROM a)
    SELECT event_id, value <= 2 * greatest(mad, 0.001) AS keep FROM b"""
)
def mad_filter(spark, sf):
    """Distances within a multiple of the median absolute deviation (A2)."""
    return series.mad_keep(series_of(spark, sf), ["event_type"], "value", 2.0).select("event_id", "keep")


@query(
    EV + """, a AS (SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM ev WHERE event_id % 11 != 0),
    d AS (SELECT *, abs(value - list_sort([l[greatest(1, least(len(l), i + k))] FOR k IN range(-10, 11)])[11]) AS d FROM a),
    m AS (SELECT *, median(d) OVER (PARTITION BY event_type) AS mid FROM d), n AS (SELECT *, median(abs(d - mid)) OVER (PARTITION BY event_type) AS mad FROM m)
    SELECT event_id, d > 2 * greatest(mad, 0.001) AS outlier, CASE WHEN d <= 2 * greatest(mad, 0.001) THEN value END AS value FROM n
    UNION ALL SELECT event_id, false, NULL FROM ev WHERE event_id % 11 = 0"""
)
def outliers_blanked(spark, sf):
    """Points far from their neighbours' median keep their row and lose their value."""
    e = series_of(spark, sf).select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return series.outliers_blanked(e, ["event_type"], "event_id", ["value"], times=2.0).select("event_id", "outlier", "value")


@query(
    EV + """, a AS (SELECT *, CASE WHEN event_id % 3 != 0 THEN value END AS v FROM ev),
    b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'t': us, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
      first_value(CASE WHEN v IS NOT NULL THEN {'t': us, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM a)
    SELECT event_id, round(coalesce(v, p.v + (us - p.t) / (n.t - p.t) * (n.v - p.v), p.v, n.v), 6) AS value FROM b"""
)
def gap_fill(spark, sf):
    """Missing values on the line between neighbours, held at the ends."""
    e = series_of(spark, sf).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return series.gaps_filled(e, BY, "us", "value").select("event_id", r6(F.col("value")).alias("value"))


_KERNEL = ", ".join(repr(x) for x in series.gaussian_kernel(2.0))


@query(
    EV + f""", a AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
      row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i FROM ev),
    b AS (SELECT event_id, l, unnest([{_KERNEL}]) AS w, ((i + unnest(range(-8, 9))) % (2 * len(l)) + 2 * len(l)) % (2 * len(l)) AS m FROM a)
    SELECT event_id, round(sum(w * l[CASE WHEN m < len(l) THEN m ELSE 2 * len(l) - 1 - m END + 1]), 6) AS value FROM b GROUP BY event_id"""
)
def gaussian_smoothing(spark, sf):
    """Gaussian weights along the rows, reflected at the ends."""
    return series.gaussian_smooth(series_of(spark, sf), BY, "us", ["value"], 2.0).select("event_id", r6(F.col("value")).alias("value"))


@query(EV + "SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS flag FROM ev")
def rolling_any(spark, sf):
    """A flag that stays on for the last four rows."""
    return series.rolling_any(series_of(spark, sf).withColumn("flag", F.col("event_type") == "error"), BY, "us", "flag", 4).select("event_id", "flag")


@query(EV + "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us), 6) AS total FROM ev")
def running_density(spark, sf):
    """Sums so far."""
    return series.running_total(series_of(spark, sf), BY, "us", "value").select("event_id", r6(F.col("total")).alias("total"))


@query(EV + "SELECT event_id, us - first_value(us) OVER (PARTITION BY user_id ORDER BY us) AS elapsed FROM ev")
def since_first(spark, sf):
    """Time since a series' first row."""
    return series.since_first(series_of(spark, sf), BY, "us").select("event_id", "elapsed")


@query(
    EV + """, a AS (SELECT event_id, user_id, us, value AS x, (event_id * 37 % 101)::DOUBLE AS y FROM ev),
    b AS (SELECT *, coalesce(lag(x, 3) OVER w, first_value(x) OVER w) AS x0, coalesce(lag(y, 3) OVER w, first_value(y) OVER w) AS y0,
      coalesce(lead(x, 3) OVER w, last_value(x) OVER v) AS x1, coalesce(lead(y, 3) OVER w, last_value(y) OVER v) AS y1 FROM a
      WINDOW w AS (PARTITION BY user_id ORDER BY us), v AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    c AS (SELECT event_id, degrees(atan2(y1 - y, x1 - x) - atan2(y - y0, x - x0)) + 180 AS d, sqrt((x - x0) ** 2 + (y - y0) ** 2) > 1e-8 AND sqrt((x1 - x) ** 2 + (y1 - y) ** 2) > 1e-8 AS moves FROM b)
    SELECT event_id, CASE WHEN moves THEN round(abs(d - 360 * floor(d / 360) - 180), 6) ELSE 0 END AS turn FROM c"""
)
def heading_changes(spark, sf):
    """The turn between directions before and after."""
    e = series_of(spark, sf).withColumn("x", F.col("value")).withColumn("y", (F.col("event_id") * 37 % 101).cast("double"))
    return series.heading_change(e, BY, "us", "x", "y", 3).select("event_id", r6(F.col("turn")).alias("turn"))


@query(
    EV.replace("WITH", "WITH RECURSIVE") + """, a AS (SELECT user_id, us, abs(value - 250) AS turn, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i, abs(value - 250) >= 200 AND i > 0 AS hot FROM ev),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, hot ORDER BY us) AS run FROM a),
    p AS (SELECT user_id, arg_max(i, (turn, -i)) AS i FROM b WHERE hot GROUP BY user_id, run),
    k AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM p),
    t AS (SELECT user_id, n, CASE WHEN i >= 5 THEN i ELSE 0 END AS last, i >= 5 AS taken, i FROM k WHERE n = 1
      UNION ALL SELECT k.user_id, k.n, CASE WHEN k.i - t.last >= 5 THEN k.i ELSE t.last END, k.i - t.last >= 5, k.i FROM t JOIN k ON k.user_id = t.user_id AND k.n = t.n + 1),
    s AS (SELECT a.user_id, a.i, (SELECT count(*) FROM t WHERE t.user_id = a.user_id AND t.taken AND t.i <= a.i) AS segment FROM a)
    SELECT user_id, segment, count(*) AS n FROM s GROUP BY user_id, segment"""
)
def turn_segments(spark, sf):
    """Peaks of the turn, kept apart, and the segments between them."""
    e = series_of(spark, sf).withColumn("turn", F.abs(F.col("value") - 250))
    breaks = series.peaks(e, BY, "us", "turn", 200.0, 5)
    return series.segment_labels(e, breaks, BY, "us").groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(
    EV + """, s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM ev)
    SELECT event_id, round_even(60 - least(greatest((value - mu) / (1.5 * sd + 1e-9), 0), 1) * 52, 0)::INT AS width FROM ev, s"""
)
def adaptive_widths(spark, sf):
    """Window widths from residuals."""
    e = series_of(spark, sf)
    stats = F.broadcast(e.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")))
    return e.join(stats).select("event_id", series.adaptive_width(F.col("value"), F.col("mu"), F.col("sd"), 60, 8).alias("width"))


# Fits ---------------------------------------------------------------------------------------------------------------


def pairs_of(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of points along each user's events; every seventh is missing."""
    e = series_of(spark, sf)
    ok = F.col("event_id") % 7 != 0
    src = [F.col("value"), (F.col("event_id") % 13).cast("double"), (F.col("event_id") % 5).cast("double")]
    dst = [-src[1] + 3, src[0] - 1, src[2] + 2]
    return e.select("user_id", "event_id", "us", *[F.when(ok, c).alias(n) for c, n in zip(src + dst, fits.S + fits.D, strict=True)])


_PAIRS = EV + ", p AS (SELECT user_id, event_id, us, event_id % 7 != 0 AS ok, value AS sx, (event_id % 13)::DOUBLE AS sy, (event_id % 5)::DOUBLE AS sz, 3.0 - event_id % 13 AS dx, value - 1 AS dy, event_id % 5 + 2.0 AS dz FROM ev) "


@query(
    _PAIRS + """SELECT user_id, count(*) AS n, round(avg(sx), 6) AS msx, round(avg(dy), 6) AS mdy, round(avg(dx * sy) - avg(dx) * avg(sy), 6) AS cxy, round(avg(dy * sx) - avg(dy) * avg(sx), 6) AS cyx
    FROM p WHERE ok GROUP BY user_id"""
)
def centroid_covariance(spark, sf):
    """Centroids and cross-covariances of paired points."""
    s, n = fits.pair_sums(pairs_of(spark, sf), BY), F.col("n")
    cov = lambda d, x: r6(F.col(f"sum_{d}_{x}") / n - F.col(f"sum_{d}") / n * F.col(f"sum_{x}") / n)
    s = s.where("n > 0")
    return s.select("user_id", n.cast("bigint").alias("n"), r6(F.col("sum_sx") / n).alias("msx"), r6(F.col("sum_dy") / n).alias("mdy"), cov("dx", "sy").alias("cxy"), cov("dy", "sx").alias("cyx"))


_BOUNDS = _PAIRS + """, a AS (SELECT *, (sum(ok::INT) OVER (PARTITION BY user_id))::INT AS nv,
      coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM p),
    b AS (SELECT *, least(nv, greatest(0, least(before, nv - 1) - 15) + 30) AS hi FROM a), c AS (SELECT *, greatest(0, hi - 30) AS lo FROM b) """


@query(_BOUNDS + "SELECT event_id, nv::BIGINT AS n_valid, lo, hi FROM c")
def window_bounds(spark, sf):
    """The valid pairs around each row, the width kept at the ends."""
    return fits.window_bounds(pairs_of(spark, sf), BY, "us", F.lit(30)).select("event_id", "n_valid", "lo", "hi")


@query(
    _BOUNDS + """, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS k FROM p WHERE ok)
    SELECT c.event_id, count(*) AS n, round(avg(v.sx), 6) AS msx, round(avg(v.dy), 6) AS mdy FROM c JOIN v ON c.user_id = v.user_id AND v.k >= c.lo AND v.k < c.hi GROUP BY c.event_id"""
)
def window_means(spark, sf):
    """Means over those windows from prefix sums."""
    s = fits.window_sums(fits.window_bounds(pairs_of(spark, sf), BY, "us", F.lit(30)), BY, "us").where("n > 0")
    return s.select("event_id", F.col("n").cast("bigint").alias("n"), r6(F.col("sum_sx") / F.col("n")).alias("msx"), r6(F.col("sum_dy") / F.col("n")).alias("mdy"))


@query(_PAIRS + "SELECT user_id, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS worst FROM p WHERE ok GROUP BY user_id HAVING count(*) >= 3")
def rigid_residuals(spark, sf):
    """A rigid motion is recovered from its pairs: no residual is left."""
    p = pairs_of(spark, sf)
    fit = fits.global_fit(p, BY).where("r is not null")
    rep = fits.residual_report(fits.residuals(p, fit, BY), BY)
    return rep.select("user_id", F.round("rmse", 5).alias("rmse"), F.round("worst", 5).alias("worst"))


@query(_PAIRS + "SELECT event_id, CASE WHEN ok THEN 0.0::DOUBLE END AS residual FROM p")
def windowed_rigid(spark, sf):
    """A rigid fit in the window around each row, of one width."""
    p = pairs_of(spark, sf)
    f = fits.windowed_fit(p, BY, "us", F.lit(30))
    x, y, z = fits.applied(F.col("r"), F.col("t"), F.col("c"))
    d = F.sqrt((F.col("dx") - x) ** 2 + (F.col("dy") - y) ** 2 + (F.col("dz") - z) ** 2)
    return f.select("event_id", F.round(d, 4).alias("residual"))


def _lags_sql(name: str, lags: str) -> str:
    return f"""{name}x AS (SELECT lag, a.v AS p, a.t + lag AS x FROM a, ({lags})),
    {name}y AS (SELECT l.lag, l.p, CASE WHEN b.t = l.x OR b.t1 IS NULL THEN b.v ELSE b.v + (l.x - b.t) / (b.t1 - b.t) * (b.v1 - b.v) END AS q
      FROM {name}x l ASOF JOIN b ON l.x >= b.t WHERE l.x <= (SELECT max(t) FROM b)),
    {name} AS (SELECT lag, CASE WHEN count(*) < 50 OR var_pop(p) = 0 OR var_pop(q) = 0 THEN 0 ELSE covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) END AS r FROM {name}y GROUP BY lag)"""


@query(
    EV + f""", sig AS (SELECT event_type, (h - 473000)::DOUBLE AS t, avg(value) AS v FROM ev GROUP BY event_type, h),
    a AS (SELECT t, v FROM sig WHERE event_type = 'click'), b AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1 FROM sig WHERE event_type = 'view'),
    {_lags_sql("wide", "SELECT -20.0::DOUBLE + i * 0.5::DOUBLE AS lag FROM range(81) g(i)")},
    best AS (SELECT arg_min(lag, (round(r, 9), lag)) AS lag FROM wide),
    {_lags_sql("near", "SELECT (SELECT lag FROM best) - 1.0::DOUBLE + i * 0.05::DOUBLE AS lag FROM range(41) g(i)")}
    SELECT 1 AS rec, round(arg_min(lag, (round(r, 9), lag)), 6) AS lag, round(min(r), 6) AS r FROM near"""
)
def drift_search(spark, sf):
    """The lag of the smallest correlation, wide then fine."""
    e = series_of(spark, sf)
    sig = e.groupBy("event_type", "h").agg(F.avg("value").alias("v")).select("event_type", (F.col("h") - 473_000).cast("double").alias("t"), "v")
    one = lambda kind: sig.where(F.col("event_type") == kind).select(F.lit(1).alias("rec"), "t", "v")
    found = fits.drift(one("click"), one("view"), ["rec"], coarse=(20.0, 0.5), fine=(1.0, 0.05))
    return found.select("rec", r6(F.col("lag")).alias("lag"), r6(F.col("r")).alias("r"))


@query(
    EV + """SELECT user_id, CASE WHEN count(*) < 50 OR var_pop(value) = 0 OR var_pop(event_id) = 0 THEN 0
      ELSE round((avg(value * event_id) - avg(value) * avg(event_id)) / (stddev_pop(value) * stddev_pop(event_id)), 6) END AS r FROM ev GROUP BY user_id"""
)
def pearson(spark, sf):
    """Pearson's r; 0 for few samples or no variance (A5)."""
    x, y = F.col("value"), F.col("event_id").cast("double")
    s = series_of(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), (F.avg(x * y) - F.avg(x) * F.avg(y)).alias("c"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("s"))
    return s.select("user_id", F.when((F.col("n") < 50) | (F.col("s") == 0), 0.0).otherwise(r6(F.try_divide("c", "s"))).alias("r"))


# Space --------------------------------------------------------------------------------------------------------------

_PT = "WITH pt AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings) "


def points(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), "label", "embedding")


@query(_PT + "SELECT a.vec_id, b.vec_id AS r_vec_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM pt a JOIN pt b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.0025")
def radius_2d(spark, sf):
    """Pairs of points within a radius in the plane."""
    p = points(spark, sf).select("vec_id", "x", "y")
    return spatial.radius_join(p, p, ["x", "y"], 0.05).select("vec_id", "r_vec_id", r6_many(F.col("distance")).alias("distance"))


@query(_PT + "SELECT a.vec_id, b.vec_id AS r_vec_id FROM pt a JOIN pt b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.01")
def radius_3d(spark, sf):
    """Pairs of points within a radius in space."""
    p = points(spark, sf).select("vec_id", "x", "y", "z")
    return spatial.radius_join(p, p, ["x", "y", "z"], 0.1).select("vec_id", "r_vec_id")


@query(
    _PT + """, w AS (SELECT a.vec_id AS pid, sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / (2 * 0.05 ** 2))) AS weight FROM pt a JOIN pt b
      ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.0225 WHERE b.label = 0 GROUP BY a.vec_id)
    SELECT pid, round(weight, 6) AS weight, round(weight / (SELECT max(weight) FROM w), 6) AS share FROM w"""
)
def gaze_density(spark, sf):
    """Kernel density of hits at points (A10)."""
    p = points(spark, sf).select(F.col("vec_id").alias("pid"), "x", "y", "z", "label")
    d = spatial.density(p.drop("label"), p.where("label = 0").drop("label"), 0.05, 0.15)
    return d.select("pid", r6(F.col("weight")).alias("weight"), r6(F.col("share")).alias("share"))


_MESH = """WITH e AS (SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS e FROM embeddings),
    tri AS (SELECT vec_id AS fid, 4 * e[1] AS ax, 4 * e[2] AS ay, e[3] AS az, 4 * e[1] + 1 AS bx, 4 * e[2] + e[4] AS by_, e[3] + e[5] AS bz, 4 * e[1] + e[6] AS cx, 4 * e[2] + 1 AS cy, e[3] + e[7] AS cz FROM e),
    ray AS (SELECT vec_id AS rid, 4 * e[8] AS ox, 4 * e[9] AS oy, 5.0 AS oz, e[10] AS dx, e[11] AS dy, -1.0 AS dz FROM e WHERE vec_id % 5 = 0),
    m AS (SELECT *, bx - ax AS e1x, by_ - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM ray, tri),
    n AS (SELECT *, dy * e2z - dz * e2y AS px, dz * e2x - dx * e2z AS py, dx * e2y - dy * e2x AS pz, sy * e1z - sz * e1y AS qx, sz * e1x - sx * e1z AS qy, sx * e1y - sy * e1x AS qz FROM m),
    o AS (SELECT *, e1x * px + e1y * py + e1z * pz AS det FROM n),
    h AS (SELECT rid, fid, (sx * px + sy * py + sz * pz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS v, (e2x * qx + e2y * qy + e2z * qz) / det AS t FROM o WHERE abs(det) > 1e-12)
    """


@query(_MESH + "SELECT rid, round(min(t), 6) AS t, count(*) AS n_hits FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-9 GROUP BY rid")
def ray_triangle_hits(spark, sf):
    """Every fifth ray, as the SQL has it, against all triangles: nearest hit and hits (J16, J17). all_ray_hits casts all rays."""
    rays, tri = _rays_and_mesh(spark, sf)
    return spatial.mesh_hits(rays.where("rid % 5 = 0"), tri).select("rid", r6("t").alias("t"), "n_hits")


@query(_MESH.replace(" WHERE vec_id % 5 = 0", "") + "SELECT rid, round(min(t), 6) AS t, count(*) AS n_hits FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-9 GROUP BY rid")
def all_ray_hits(spark, sf):
    """All rays against all triangles: nearest hit and hits (J16, J17). Slab, samples and radius follow the triangles' bounds."""
    rays, tri = _rays_and_mesh(spark, sf)
    return spatial.mesh_hits(rays, tri).select("rid", r6("t").alias("t"), "n_hits")


def _rays_and_mesh(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(11)])
    c = F.col
    tri = e.select(
        c("vec_id").alias("fid"), (4 * c("e1")).alias("x0"), (4 * c("e2")).alias("y0"), c("e3").alias("z0"), (4 * c("e1") + 1).alias("x1"), (4 * c("e2") + c("e4")).alias("y1"), (c("e3") + c("e5")).alias("z1"),
        (4 * c("e1") + c("e6")).alias("x2"), (4 * c("e2") + 1).alias("y2"), (c("e3") + c("e7")).alias("z2"),
    )
    tri = tri.withColumns({f"c{x}": (c(f"{x}0") + c(f"{x}1") + c(f"{x}2")) / 3 for x in "xyz"})
    rays = e.select(c("vec_id").alias("rid"), (4 * c("e8")).alias("ox"), (4 * c("e9")).alias("oy"), F.lit(5.0).alias("oz"), c("e10").alias("dx"), c("e11").alias("dy"), F.lit(-1.0).alias("dz"))
    return rays, tri


_Q = "WITH e AS (SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS e FROM embeddings), q AS (SELECT vec_id, e, sqrt(e[1]**2 + e[2]**2 + e[3]**2 + e[4]**2) AS n FROM e), u AS (SELECT vec_id, e, e[1]/n AS x, e[2]/n AS y, e[3]/n AS z, e[4]/n AS w FROM q) "


def _unit_quaternion(df: DataFrame, at: int) -> tuple:
    q = [F.col("embedding")[at + i].cast("double") for i in range(4)]
    n = F.sqrt(q[0] ** 2 + q[1] ** 2 + q[2] ** 2 + q[3] ** 2)
    return tuple(c / n for c in q)


@query(
    _Q + """SELECT vec_id, round((1-2*(y*y+z*z))*e[5] + 2*(x*y-z*w)*e[6] + 2*(x*z+y*w)*e[7] + e[8], 6) AS px, round(2*(x*y+z*w)*e[5] + (1-2*(x*x+z*z))*e[6] + 2*(y*z-x*w)*e[7] + e[9], 6) AS py,
    round(2*(x*z-y*w)*e[5] + 2*(y*z+x*w)*e[6] + (1-2*(x*x+y*y))*e[7] + e[10], 6) AS pz FROM u"""
)
def quaternion_transform(spark, sf):
    """Rotations of quaternions, applied to points."""
    df = table(spark, sf, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    p = V.rigid(V.rotation_of(_unit_quaternion(df, 0)), (at(7), at(8), at(9)), (at(4), at(5), at(6)))
    return df.select("vec_id", *[r6(c).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@query(_Q + "SELECT vec_id, round(2 * degrees(acos(least(abs(w), 1))), 4) AS angle FROM u")
def rotation_angles(spark, sf):
    """The angle of a rotation."""
    df = table(spark, sf, "embeddings")
    return df.select("vec_id", F.round(V.rotation_angle(V.rotation_of(_unit_quaternion(df, 0))), 4).alias("angle"))


@query(
    _Q + """, v AS (SELECT vec_id, x, y, z, w, e[5] AS a, e[6] AS b, e[7] AS c, e[8] AS d FROM u), n AS (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS m FROM v),
    o AS (SELECT *, (x*a + y*b + z*c + w*d) / m AS dot FROM n), t AS (SELECT *, acos(least(abs(dot), 1)) AS th, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS s FROM o)
    SELECT vec_id, round((sin(0.7*th) * x + s * sin(0.3*th) * a / m) / sin(th), 6) AS qx, round((sin(0.7*th) * w + s * sin(0.3*th) * d / m) / sin(th), 6) AS qw FROM t"""
)
def slerp(spark, sf):
    """Between two rotations, three tenths of the way."""
    df = table(spark, sf, "embeddings")
    q = V.slerp(_unit_quaternion(df, 0), _unit_quaternion(df, 4), F.lit(0.3))
    return df.select("vec_id", r6(q[0]).alias("qx"), r6(q[3]).alias("qw"))


@query(
    """WITH e AS (SELECT vec_id, 100 * embedding[1]::DOUBLE AS u, 100 * embedding[2]::DOUBLE AS v FROM embeddings), d AS (SELECT vec_id, (u - 50) / 80 AS x, (v - 40) / 90 AS y FROM e)
    SELECT vec_id, round(x / sqrt(x*x + y*y + 1), 6) AS rx, round(-y / sqrt(x*x + y*y + 1), 6) AS ry, round(-1 / sqrt(x*x + y*y + 1), 6) AS rz, round(y / sqrt(x*x + y*y + 1), 6) AS gy FROM d"""
)
def pixel_rays(spark, sf):
    """Directions of pixels under both conventions."""
    u, v = (100 * F.col("embedding")[i].cast("double") for i in range(2))
    k = [F.lit(80.0), F.lit(90.0), F.lit(50.0), F.lit(40.0)]
    back, ahead = V.pixel_ray(u, v, *k), V.pixel_ray(u, v, *k, forward=1)
    return table(spark, sf, "embeddings").select("vec_id", *[r6(c).alias(n) for c, n in zip(back, ("rx", "ry", "rz"), strict=True)], r6(ahead[1]).alias("gy"))


@query(
    _PT + """, s AS (SELECT vec_id, round(greatest(0, least(1, x + 0.5)), 9) AS s FROM pt)
    SELECT vec_id, round(CASE WHEN s <= 0 THEN 0 WHEN s < 0.25 THEN 4 * s WHEN s < 0.5 THEN 1 - 2 * (s - 0.25) WHEN s < 1 THEN 0.5 + (s - 0.5) ELSE 1 END, 6) AS red FROM s"""
)
def colour_ramp(spark, sf):
    """A colour channel between stops."""
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x") + 0.5)), 9)
    return points(spark, sf).select("vec_id", r6(V.piecewise_linear(s, [(0.0, 0.0), (0.25, 1.0), (0.5, 0.5), (1.0, 1.0)])).alias("red"))


# Rows, sets, samples ------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum([greatest(v::DOUBLE, 0) FOR v IN embedding[3:10]]), 6) AS pressure, CASE WHEN embedding[1] >= embedding[2] THEN 'LeftFoot' ELSE 'RightFoot' END AS foot FROM embeddings")
def pressure_and_foot(spark, sf):
    """A clamped sum over channels, and which of two is larger with ties to the left (F1, F2)."""
    p = F.aggregate(F.slice("embedding", 3, 8), F.lit(0.0), lambda a, v: a + F.greatest(v.cast("double"), F.lit(0.0)))
    return table(spark, sf, "embeddings").select("vec_id", r6(p).alias("pressure"), F.when(F.col("embedding")[0] >= F.col("embedding")[1], "LeftFoot").otherwise("RightFoot").alias("foot"))


@query("SELECT o_orderkey, strftime(o_orderdate + to_microseconds((o_orderkey % 100 * 33366.7)::DOUBLE::BIGINT - CASE WHEN (o_orderkey % 100 * 33366.7)::DOUBLE::BIGINT > o_orderkey % 100 * 33366.7 THEN 1 ELSE 0 END), '%Y-%m-%d %H:%M:%S.%g') AS utc_time FROM orders")
def frame_clock(spark, sf):
    """The time of a frame, cut to milliseconds."""
    return table(spark, sf, "orders").select("o_orderkey", clock(F.col("o_orderdate"), F.col("o_orderkey") % 100, 0.0333667).alias("utc_time"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) + rpad(substr((event_id * 7919)::VARCHAR, 1, 6), 6, '0')::BIGINT AS us FROM events")
def iso_times(spark, sf):
    """Start times with fractions of any length."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), (F.col("event_id") * 7919).cast("string"), F.lit("Z "))
    return table(spark, sf, "events").select("event_id", micros(iso_start(text)).alias("us"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END AS value FROM events")
def missing_spellings(spark, sf):
    """nan, empty strings and words are null (the reader's rule)."""
    text = F.when(F.col("event_id") % 4 == 1, "nan").when(F.col("event_id") % 4 == 2, "").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", number(text).alias("value"))


@query("SELECT p_partkey, p_size > 30 AS sure, CASE WHEN p_size >= 10 THEN p_retailprice END AS x, CASE WHEN p_type < 'M' THEN p_brand ELSE p_name END AS heel FROM part WHERE p_size BETWEEN 5 AND 45")
def confidence_and_sides(spark, sf):
    """Two confidence thresholds, a column chosen by side, a closed range."""
    p = table(spark, sf, "part").where(F.col("p_size").between(5, 45))
    return p.select("p_partkey", (F.col("p_size") > 30).alias("sure"), F.when(F.col("p_size") >= 10, F.col("p_retailprice")).alias("x"), F.when(F.col("p_type") < "M", F.col("p_brand")).otherwise(F.col("p_name")).alias("heel"))


@query("SELECT g.i AS frame, o_custkey FROM (SELECT unnest(range(0, 500)) AS i) g LEFT JOIN orders ON o_orderkey = g.i")
def dense_frames(spark, sf):
    """The first 500 frame numbers, as the SQL has them, whether or not a row exists (J9, J10). all_frames spans all."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), "o_custkey")
    return spark.range(500).select(F.col("id").alias("frame")).join(o, "frame", "left")


@query("SELECT g.i AS frame, o_custkey FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS i) g LEFT JOIN orders ON o_orderkey = g.i")
def all_frames(spark, sf):
    """All frame numbers up to the last one, whether or not a row exists."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), "o_custkey")
    last = o.agg(F.max("frame").alias("last")).first()["last"]
    return spark.range(0 if last is None else last + 1).select(F.col("id").alias("frame")).join(o, "frame", "left")


@query(
    """SELECT count(*) AS probes, count(o_orderkey) AS met, count(*) FILTER (o_orderkey IS NULL) AS no_row, count(*) FILTER (o_totalprice < 1000) AS low
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'"""
)
def match_counters(spark, sf):
    """An equi-join with a count for each reason of a miss."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    j = table(spark, sf, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("probes"), F.count("o_orderkey").alias("met"), F.count_if(F.col("o_orderkey").isNull()).alias("no_row"), F.count_if(F.col("o_totalprice") < 1000).alias("low"))


@query("SELECT l_returnflag AS side, median(l_quantity) AS mx, median(l_extendedprice) AS my, median(l_discount) AS mz, min(l_tax) AS lo, max(l_tax) AS hi, round(stddev_pop(l_quantity), 6) AS sd, count(DISTINCT l_partkey) AS n_candidates, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def group_medians(spark, sf):
    """Medians, bounds, spread, distinct candidates."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("side"))
    return g.agg(
        F.median("l_quantity").alias("mx"), F.median("l_extendedprice").alias("my"), F.median("l_discount").alias("mz"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"),
        r6(F.stddev_pop("l_quantity")).alias("sd"), F.count_distinct("l_partkey").alias("n_candidates"), F.max("l_orderkey").alias("last"),
    )


@query("SELECT a.n_name AS parent, b.n_name AS child FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5 AND b.n_regionkey = a.n_regionkey")
def bone_endpoints(spark, sf):
    """An edge list joined twice; an edge needs both ends."""
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 5).alias("b"))
    ends = lambda k, name: n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name), F.col("n_regionkey").alias(f"r_{k}"))
    return edges.join(ends("a", "parent"), "a").join(ends("b", "child"), "b").where("r_a = r_b").select("parent", "child")


@query(EV + "SELECT event_id, nx AS next_id FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM ev) WHERE nx IS NOT NULL")
def polyline(spark, sf):
    """Each row with the next one of its series."""
    w = Window.partitionBy("user_id").orderBy("us")
    return series_of(spark, sf).select("event_id", F.lead("event_id").over(w).alias("next_id")).where("next_id is not null")


@query("SELECT 1 AS src, p_partkey AS k FROM part WHERE p_size < 10 UNION ALL SELECT 2, s_suppkey FROM supplier WHERE s_suppkey BETWEEN 5 AND 60")
def appended_pairs(spark, sf):
    """A second set of pairs inside a range is appended."""
    a = table(spark, sf, "part").where("p_size < 10").select(F.lit(1).alias("src"), F.col("p_partkey").alias("k"))
    return a.unionByName(table(spark, sf, "supplier").where(F.col("s_suppkey").between(5, 60)).select(F.lit(2).alias("src"), F.col("s_suppkey").alias("k")))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS seen FROM customer")
def membership_flags(spark, sf):
    """Membership in a set of keys as a flag."""
    seen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("SELECT p_partkey FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 100")
def seeded_sample(spark, sf):
    """A sample of a fixed size that repeats."""
    return table(spark, sf, "part").orderBy(F.md5(F.concat(F.lit("42:"), F.col("p_partkey").cast("string"))), "p_partkey").select("p_partkey").limit(100)


@query("SELECT s_nationkey, arg_max(s_suppkey, s_acctbal) AS best FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_nationkey")
def best_by_score(spark, sf):
    """Stride sampling, as the SQL has it: the best of every third row in each group (T8). best_of_all reads all rows."""
    return table(spark, sf, "supplier").where("s_suppkey % 3 = 0").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("best"))


@query("SELECT s_nationkey, arg_max(s_suppkey, s_acctbal) AS best FROM supplier GROUP BY s_nationkey")
def best_of_all(spark, sf):
    """The best of each group over all rows."""
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("best"))


@query("SELECT a.i, a.r_name, b.n_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS i, r_name FROM region) a JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_name FROM nation) b USING (i) ORDER BY i LIMIT 20")
def paired_by_place(spark, sf):
    """Two lists paired up to the shorter's length, 20 rows at most."""
    num = lambda df, k, c: df.select(F.row_number().over(Window.orderBy(k)).alias("i"), c)
    return num(table(spark, sf, "region"), "r_regionkey", "r_name").join(num(table(spark, sf, "nation"), "n_nationkey", "n_name"), "i").orderBy("i").limit(20)


@query(
    """SELECT p_partkey, greatest(0, p_size - 20) AS x1, greatest(0, p_partkey % 70 - 20) AS y1, least(640, p_size + 50 + 20) AS x2, least(60, p_partkey % 70 + 25 + 20) AS y2,
    (p_partkey % 70 + floor(25 * 0.3))::BIGINT AS head_y2 FROM part"""
)
def padded_boxes(spark, sf):
    """Boxes padded and clipped to the image, and the head's part of them."""
    y = F.col("p_partkey") % 70
    zero = F.lit(0)
    return table(spark, sf, "part").select(
        "p_partkey", F.greatest(zero, F.col("p_size") - 20).alias("x1"), F.greatest(zero, y - 20).alias("y1"), F.least(F.lit(640), F.col("p_size") + 70).alias("x2"),
        F.least(F.lit(60), y + 45).alias("y2"), (y + F.floor(F.lit(25 * 0.3))).cast("bigint").alias("head_y2"),
    )


from poseframe.plans import catalog as _plans  # noqa: E402, F401  registers the queries of the pipelines
from poseframe.plans import contact_catalog as _contacts  # noqa: E402, F401
from poseframe.plans import fits_catalog as _fits  # noqa: E402, F401
from poseframe.plans import scale_catalog as _scale  # noqa: E402, F401
