"""Queries of the composed pipelines and of the operators that only they use, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseframe.catalog import _ISLANDS, _MESH, BY, EV, _rays_and_mesh, kind, query, r6, series_of, table
from poseframe.functions import vectors as V
from poseframe.functions.text import micros
from poseframe.operators import fits, masks, spatial
from poseframe.plans import alignment, clock_sync, gaze, steps
from poseframe.sources.readers import channel_position

ZONE = "America/New_York"


def rows_of(spark, sf) -> DataFrame:
    """Events with their place i in the user's series, from 0."""
    e = series_of(spark, sf)
    return e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("us")) - 1)


_ROWS = EV + ", e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i FROM ev) "
#: Keypoints of an event: invented coordinates, every third a confidence.
_POSE = "list_transform(range(0, 69), lambda k: CASE WHEN k % 3 = 2 THEN fmod(value * (k + 1) + event_id, 97) / 97 ELSE fmod(value * (k + 1) + event_id, 97) END)"


def poses_of(e: DataFrame) -> DataFrame:
    def one(k):
        m = F.pmod(F.col("value") * (k + 1) + F.col("event_id"), F.lit(97.0))
        return F.when(k % 3 == 2, m / 97).otherwise(m)

    return e.select("user_id", F.col("i").alias("frame"), "event_id", F.transform(F.sequence(F.lit(0), F.lit(68)), one).alias("keypoints"))


@query(
    f"""WITH a AS (SELECT o_orderkey, o_orderdate, first_value(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders),
    b AS (SELECT *, (epoch_us(f) - epoch_us(timezone('UTC', timezone('{ZONE}', f)))) // 1000000 AS utc_offset FROM a)
    SELECT o_orderkey, utc_offset, epoch_us(o_orderdate) - utc_offset * 1000000 AS us FROM b"""
)
def utc_of_recordings(spark, sf):
    """Local times to UTC by the zone's offset at the first frame."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return clock_sync.utc_times(o, ["o_custkey"], "o_orderkey", "o_orderdate", ZONE).select("o_orderkey", "utc_offset", micros("utc").alias("us"))


_FILL = """last_value(CASE WHEN {c} IS NOT NULL THEN {{'t': frame, 'v': {c}}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p{c},
      first_value(CASE WHEN {c} IS NOT NULL THEN {{'t': frame, 'v': {c}}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n{c}"""
_LINE = "coalesce({c}, p{c}.v + (frame - p{c}.t) / (n{c}.t - p{c}.t) * (n{c}.v - p{c}.v), p{c}.v, n{c}.v)"


@query(
    _ROWS + f""", k AS (SELECT user_id, i AS frame, event_id % 9 != 0 AS has, {_POSE} AS kp FROM e),
    a AS (SELECT user_id, frame, CASE WHEN has AND kp[60] > 0.3 THEN kp[59] END AS l, CASE WHEN has AND kp[69] > 0.3 THEN kp[68] END AS r FROM k),
    b AS (SELECT *, {_FILL.format(c="l")}, {_FILL.format(c="r")} FROM a)
    SELECT user_id, frame, round({_LINE.format(c="r")} - ({_LINE.format(c="l")}), 6) AS diff FROM b"""
)
def heel_signal(spark, sf):
    """The difference of both heels for each frame, gaps filled."""
    e = rows_of(spark, sf)
    lengths = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return clock_sync.heel_difference(poses_of(e).where("event_id % 9 != 0"), lengths, BY).select("user_id", "frame", r6(F.col("diff")).alias("diff"))


@query(
    EV + """, s AS (SELECT user_id, event_id, us FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM s GROUP BY user_id),
    f AS (SELECT l.user_id, l.event_id, l.us + 5400000000 AS m FROM ev l JOIN b USING (user_id) WHERE l.event_type = 'click' AND l.us + 5400000000 BETWEEN lo AND hi)
    SELECT event_id, m AS matched, (SELECT s.event_id FROM s WHERE s.user_id = f.user_id ORDER BY abs(s.us - m), s.us, s.event_id LIMIT 1) AS r_event_id FROM f"""
)
def rows_side_by_side(spark, sf):
    """Frames with the drift taken out beside the nearest rows of the other recording, inside its time only."""
    e = series_of(spark, sf).select("user_id", "event_id", "event_type", "us")
    out = clock_sync.side_by_side(kind(e, "click").select("user_id", "event_id", "us"), kind(e, "view").select("user_id", "event_id", "us"), "us", BY, 5_400_000_000, "event_id")
    return out.select("event_id", F.col("matched").cast("long").alias("matched"), "r_event_id")


def with_heels(e: DataFrame) -> DataFrame:
    v = F.col("value")
    heels = {"LeftHeel_x": v, "LeftHeel_y": v + 1, "LeftHeel_z": v + 2, "RightHeel_x": v / 2 + F.col("event_id") % 7, "RightHeel_y": v / 2, "RightHeel_z": v / 4}
    return e.withColumns(heels | {"max_pressure_foot": F.when(F.col("event_type") < "m", "LeftFoot").otherwise("RightFoot")})


@query(
    _ROWS + f""", s AS (SELECT user_id, event_id % 97 AS f, arg_max({{'l': event_type < 'm', 'v': value, 'm': event_id % 7}}, us) AS s FROM e GROUP BY ALL),
    k AS (SELECT user_id, i AS f, {_POSE} AS kp, count(*) OVER (PARTITION BY user_id) AS n FROM e),
    j AS (SELECT *, CASE WHEN s.l THEN kp[60] ELSE kp[69] END AS conf FROM s JOIN k USING (user_id, f) WHERE f < n)
    SELECT user_id, f AS dji_frame, round(CASE WHEN s.l THEN kp[58] ELSE kp[67] END, 6) AS heel_x, round(conf, 6) AS heel_conf,
      CASE WHEN s.l THEN s.v ELSE s.v / 2 + s.m END AS shadow_x FROM j WHERE conf >= 0.3"""
)
def heel_extraction(spark, sf):
    """The standing foot's heel in image and recording, the last of repeated frames."""
    e = rows_of(spark, sf)
    rows = steps.heel_rows(with_heels(e).withColumn("dji_frame", F.col("event_id") % 97), poses_of(e).drop("event_id"), BY, "us")
    return rows.select("user_id", "dji_frame", r6(F.col("heel_x")).alias("heel_x"), r6(F.col("heel_conf")).alias("heel_conf"), "shadow_x")


@query(
    _ISLANDS.replace("event_type IS DISTINCT FROM lag(event_type)", "(event_type < 'm') IS DISTINCT FROM lag(event_type < 'm')") + """,
    f AS (SELECT *, CASE WHEN event_type < 'm' THEN value ELSE value / 2 + event_id % 7 END AS heel FROM i),
    a AS (SELECT *, first_value(heel) OVER (PARTITION BY user_id, island ORDER BY us) AS s, max(island) OVER (PARTITION BY user_id) AS top, lead(island) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM f),
    b AS (SELECT *, coalesce(sum(CASE WHEN nx != island THEN s - heel ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM a),
    c AS (SELECT *, heel + carry + CASE WHEN island < top THEN s - heel ELSE 0 END AS fixed, event_id % 5 != 0 AND event_id % 11 != 0 AS sure FROM b),
    g AS (SELECT user_id, island, arg_min(event_type < 'm', us) AS l, arg_min(rn, us) AS frame_start, count(*) AS n_frames, count(*) FILTER (sure) AS n_valid,
      median(value * 2) FILTER (sure) AS mx, median(value + event_id % 3) FILTER (sure) AS mz, arg_min(fixed, us) AS shadow FROM c GROUP BY user_id, island)
    SELECT user_id, island::BIGINT AS step_idx, CASE WHEN l THEN 'LeftFoot' ELSE 'RightFoot' END AS stance_foot, frame_start, frame_end, n_frames, n_valid,
      round(mx, 6) AS median_hit_x, round(mz, 6) AS median_hit_z, round(shadow, 6) AS shadow_heel_x
    FROM (SELECT *, lead(frame_start) OVER (PARTITION BY user_id ORDER BY island) AS frame_end FROM g) WHERE frame_end IS NOT NULL"""
)
def step_summary(spark, sf):
    """The table of steps: islands, slip taken out, medians of sound hits."""
    e = rows_of(spark, sf)
    frames = with_heels(e).withColumns({"frame": F.col("i") + 1, "dji_frame": F.col("event_id")})
    x = F.when(F.col("event_id") % 5 != 0, F.col("value") * 2)
    hits = e.select("user_id", F.col("event_id").alias("dji_frame"), x.alias("hit_x"), F.col("value").alias("hit_y"), (F.col("value") + F.col("event_id") % 3).alias("hit_z"), (F.col("event_id") % 11 == 0).alias("outlier"))
    out = steps.step_table(frames, hits, BY, "us")
    return out.select("user_id", "step_idx", "stance_foot", F.col("frame_start").cast("long").alias("frame_start"), F.col("frame_end").cast("long").alias("frame_end"), "n_frames", "n_valid", *[r6(F.col(c)).alias(c) for c in ("median_hit_x", "median_hit_z", "shadow_heel_x")])


_TURN = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]


@query(
    _ISLANDS + """, g AS (SELECT user_id, island, min(rn) * 2 AS fs, any_value(event_type) AS et FROM i GROUP BY ALL),
    st AS (SELECT user_id, island, fs, lead(fs) OVER (PARTITION BY user_id ORDER BY island) AS fe, CASE WHEN island % 4 != 0 THEN island::DOUBLE END AS gz FROM g),
    m AS (SELECT *, (fs + fe) // 2 AS mid FROM st WHERE fe IS NOT NULL),
    d AS (SELECT user_id, rn * 2 + 1 AS frame, value FROM i), al AS (SELECT user_id, rn * 2 AS frame, event_id % 500 AS dji FROM i WHERE event_id % 7 < 2),
    j AS (SELECT *, coalesce((SELECT value FROM d WHERE d.user_id = m.user_id AND frame >= mid ORDER BY frame LIMIT 1), (SELECT value FROM d WHERE d.user_id = m.user_id ORDER BY frame DESC LIMIT 1)) AS hx,
      coalesce((SELECT {'f': frame, 'd': dji} FROM al WHERE al.user_id = m.user_id AND frame >= mid ORDER BY frame LIMIT 1), (SELECT {'f': frame, 'd': dji} FROM al WHERE al.user_id = m.user_id ORDER BY frame DESC LIMIT 1)) AS a FROM m),
    k AS (SELECT j.*, p_partkey AS pk, p_size AS ps, p_retailprice AS pr FROM j LEFT JOIN (orders JOIN part ON p_partkey = o_custkey) ON o_orderkey = CASE WHEN abs(a.f - mid) <= 12 THEN a.d END)
    SELECT user_id, island::BIGINT AS step_idx, hx AS hsx, (pr / 100 - 2)::DOUBLE AS hdx, 1.0::DOUBLE - ps AS hdy, (pk % 50)::DOUBLE - 3 AS hdz,
      pk IS NOT NULL AND (gz IS NULL OR pk % 50 - 3 - gz >= 0.3) AS valid FROM k"""
)
def head_positions(spark, sf):
    """From a step to its middle frame, the head there, the camera's name, place and other space."""
    from poseframe.operators.series import island_table

    e = rows_of(spark, sf).withColumn("rn", F.col("i") + 1)
    st = island_table(e, BY, "rn", "event_type").select("user_id", F.col("island").alias("step_idx"), (F.col("start") * 2).alias("frame_start"), (F.col("next_start") * 2).alias("frame_end"))
    st = st.withColumn("median_hit_z", F.when(F.col("step_idx") % 4 != 0, F.col("step_idx").cast("double")))
    head = F.col("value")
    detected = e.select("user_id", (F.col("rn") * 2 + 1).alias("frame"), head.alias("Head_x"), head.alias("Head_y"), head.alias("Head_z"))
    aligned = e.where("event_id % 7 < 2").select("user_id", (F.col("rn") * 2).alias("frame"), (F.col("event_id") % 500).alias("dji_frame"))
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    matches = table(spark, sf, "orders").select(F.col("o_orderkey").alias("dji_frame"), name("o_custkey").alias("aria_frame"))
    places = table(spark, sf, "part").select(name("p_partkey").alias("frame_name"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 50).cast("double").alias("z"))
    out = alignment.head_pairs(st, detected, aligned, matches, places, _TURN, BY, reach=12)
    return out.select("user_id", "step_idx", "hsx", "hdx", "hdy", "hdz", "valid")


@query(
    EV + """, p AS (SELECT user_id, event_id, us, event_id % 7 != 0 AS ok, value AS sx, event_id % 4 = 1 AS h, value + 10 AS hsx FROM ev),
    a AS (SELECT *, (sum(ok::INT) OVER (PARTITION BY user_id))::INT AS nv, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM p),
    b AS (SELECT *, least(nv, greatest(0, least(before, nv - 1) - 15) + 30) AS hi FROM a), c AS (SELECT *, greatest(0, hi - 30) AS lo FROM b),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS k FROM p WHERE ok),
    w AS (SELECT c.user_id, c.event_id, count(*) AS n, sum(v.sx) AS s, min(v.us) AS f, max(v.us) AS t FROM c JOIN v ON c.user_id = v.user_id AND v.k >= c.lo AND v.k < c.hi GROUP BY ALL)
    SELECT w.event_id, w.n + count(p.us) AS n, round((w.s + coalesce(sum(p.hsx), 0)) / (w.n + count(p.us)), 6) AS msx FROM w LEFT JOIN p ON p.user_id = w.user_id AND p.h AND p.us BETWEEN w.f AND w.t GROUP BY w.event_id, w.n, w.s"""
)
def windows_with_second_pairs(spark, sf):
    """Means over windows of valid pairs that also hold the second pairs inside their rows."""
    e = series_of(spark, sf)
    ok, second = F.col("event_id") % 7 != 0, F.col("event_id") % 4 == 1
    pair = {c: F.when(ok, F.col("value")) for c in (*fits.S, *fits.D)} | {c: F.when(second, F.col("value") + 10) for c in (*fits.HS, *fits.HD)}
    s = fits.window_sums(fits.window_bounds(e.withColumns(pair), BY, "us", F.lit(30)), BY, "us", second=True).where("n > 0")
    return s.select("event_id", F.col("n").cast("bigint").alias("n"), r6(F.col("sum_sx") / F.col("n")).alias("msx"))


_DEVICE = ((0.0, 0.0, 0.6, 0.8), (0.1, 0.2, 0.3))
_LENS = (80.0, 90.0, 50.0, 40.0)


def _turned_sql(q: tuple[str, str, str, str], v: tuple[str, str, str]) -> tuple[str, str, str]:
    x, y, z, w = q
    a, b, c = v
    return (
        f"((1-2*({y}*{y}+{z}*{z}))*{a} + 2*({x}*{y}-{z}*{w})*{b} + 2*({x}*{z}+{y}*{w})*{c})",
        f"(2*({x}*{y}+{z}*{w})*{a} + (1-2*({x}*{x}+{z}*{z}))*{b} + 2*({y}*{z}-{x}*{w})*{c})",
        f"(2*({x}*{z}-{y}*{w})*{a} + 2*({y}*{z}+{x}*{w})*{b} + (1-2*({x}*{x}+{y}*{y}))*{c})",
    )


def _gaze_sql() -> str:
    n = lambda xs: tuple(f"({x})::DOUBLE" for x in xs)
    a = _turned_sql(n(_DEVICE[0]), ("lx", "ly", "lz"))
    b = _turned_sql(("qx", "qy", "qz", "qw"), ("ax", "ay", "az_"))
    o = _turned_sql(("qx", "qy", "qz", "qw"), n(_DEVICE[1]))
    mesh = _MESH[: _MESH.index("ray AS (")]
    return (
        mesh + f"""fr AS (SELECT vec_id, label AS rec, vec_id * 10 + 3 AS ts FROM embeddings),
    q0 AS (SELECT vec_id, label AS rec, vec_id * 10 AS ts, vec_id * 100 + 7 AS track, 4 * embedding[8]::DOUBLE AS px, 4 * embedding[9]::DOUBLE AS py, 1.0::DOUBLE AS a0, 0.2 * embedding[10]::DOUBLE AS a1,
      0.2 * embedding[11]::DOUBLE AS a2, 0.2 * embedding[12]::DOUBLE AS a3 FROM embeddings),
    tr AS (SELECT *, sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) AS m FROM q0),
    gz AS (SELECT vec_id, label AS rec, vec_id * 100 AS track, 50 + 20 * embedding[13]::DOUBLE AS u, 40 + 20 * embedding[14]::DOUBLE AS v, vec_id % 3 != 0 AS seen FROM embeddings),
    f1 AS (SELECT fr.vec_id, fr.rec, (SELECT {{'track': track, 'px': px, 'py': py, 'x': a0 / m, 'y': a1 / m, 'z': a2 / m, 'w': a3 / m}} FROM tr WHERE tr.rec = fr.rec ORDER BY abs(tr.ts - fr.ts), tr.ts DESC LIMIT 1) AS t FROM fr),
    f2 AS (SELECT *, t.x AS qx, t.y AS qy, t.z AS qz, t.w AS qw, (SELECT {{'u': u, 'v': v, 'seen': seen}} FROM gz WHERE gz.rec = f1.rec ORDER BY abs(gz.track - t.track), gz.track DESC LIMIT 1) AS g FROM f1),
    f3 AS (SELECT *, (g.u - 50) / 80 AS l0, (g.v - 40) / 90 AS l1 FROM f2), f4 AS (SELECT *, sqrt(l0*l0 + l1*l1 + 1) AS l FROM f3), f5 AS (SELECT *, l0 / l AS lx, l1 / l AS ly, 1 / l AS lz FROM f4),
    f6 AS (SELECT *, {a[0]} AS ax, {a[1]} AS ay, {a[2]} AS az_ FROM f5), f7 AS (SELECT *, {b[0]} AS bx_, {b[1]} AS by0, {b[2]} AS bz_, {o[0]} + t.px AS o0, {o[1]} + t.py AS o1, {o[2]} + 5 AS o2 FROM f6),
    ray AS (SELECT vec_id AS rid, rec, g.seen AS seen, -o1 + 1 AS ox, o0 + 2 AS oy, o2 + 3 AS oz, -by0 AS dx, bx_ AS dy, bz_ AS dz FROM f7),
    """
        + _MESH[_MESH.index("m AS (SELECT *, bx - ax") :]
        + """, best AS (SELECT rid, min(t) AS t FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-9 AND t <= 200 GROUP BY rid)
    SELECT ray.rid AS dji_frame, round(ox, 6) AS ox, round(CASE WHEN seen THEN dz END, 6) AS dz, round(CASE WHEN seen THEN ox + dx * t END, 5) AS gaze_x, seen AND t IS NOT NULL AS gaze_valid FROM ray LEFT JOIN best USING (rid)"""
    )


@query(_gaze_sql())
def gaze_hits(spark, sf):
    """Frames to camera poses, gaze rays and the surface."""
    e = table(spark, sf, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    base = e.select("vec_id", F.col("label").alias("rec"), *[at(k).alias(f"e{k + 1}") for k in range(14)])
    c = F.col
    raw = (F.lit(1.0), 0.2 * c("e10"), 0.2 * c("e11"), 0.2 * c("e12"))
    n = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2] + raw[3] * raw[3])
    frames = base.select("rec", c("vec_id").alias("dji_frame"))
    matches = base.select("rec", c("vec_id").alias("dji_frame"), (c("vec_id") * 10 + 3).alias("ts"))
    path = base.select("rec", (c("vec_id") * 10).alias("ts"), (c("vec_id") * 100 + 7).alias("track"), (4 * c("e8")).alias("px"), (4 * c("e9")).alias("py"), F.lit(5.0).alias("pz"), *[(x / n).alias(f"q{a}") for x, a in zip(raw, "xyzw", strict=True)])
    looks = base.select("rec", (c("vec_id") * 100).alias("track"), (50 + 20 * c("e13")).alias("u"), (40 + 20 * c("e14")).alias("v"), (c("vec_id") % 3 != 0).alias("seen"))
    rays = gaze.camera_rays(frames, matches, path, looks, _DEVICE, _TURN, _LENS, ["rec"])
    out = gaze.gaze_points(rays, _rays_and_mesh(spark, sf)[1], ["rec"])
    return out.select("dji_frame", r6(c("ox")).alias("ox"), r6(c("dz")).alias("dz"), F.round("gaze_x", 5).alias("gaze_x"), "gaze_valid")


_ANCHOR = "SELECT user_id, us, value / 500 AS s, [sin(value), 0.3, cos(value), 0.5 + event_id % 3] AS q0 FROM ev WHERE event_type = 'view'"


@query(
    EV + f""", a0 AS ({_ANCHOR}), a AS (SELECT user_id, us, s, [x / sqrt(q0[1]**2 + q0[2]**2 + q0[3]**2 + q0[4]**2) FOR x IN q0] AS q FROM a0),
    f AS (SELECT user_id, event_id, us, (SELECT {{'t': a.us, 'q': a.q, 's': a.s}} FROM a WHERE a.user_id = l.user_id AND a.us <= l.us ORDER BY a.us DESC LIMIT 1) AS p0,
      (SELECT {{'t': a.us, 'q': a.q, 's': a.s}} FROM a WHERE a.user_id = l.user_id AND a.us >= l.us ORDER BY a.us LIMIT 1) AS n0 FROM ev l),
    g AS (SELECT *, coalesce(p0, n0) AS p, coalesce(n0, p0) AS n, CASE WHEN n0.t > p0.t THEN (us - p0.t) / (n0.t - p0.t) ELSE 0 END AS f FROM f),
    d AS (SELECT *, list_dot_product(p.q, n.q) AS dot FROM g), e AS (SELECT *, acos(least(abs(dot), 1)) AS th, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM d),
    w AS (SELECT *, CASE WHEN abs(dot) > 0.9999999 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS u, sg * CASE WHEN abs(dot) > 0.9999999 THEN f ELSE sin(f * th) / sin(th) END AS v FROM e),
    x AS (SELECT *, [u * p.q[k] + v * n.q[k] FOR k IN [1, 2, 3, 4]] AS m FROM w)
    SELECT event_id, round(m[1] / sqrt(list_dot_product(m, m)), 5) AS qx, round(m[4] / sqrt(list_dot_product(m, m)), 5) AS qw, round(p.s + f * (n.s - p.s), 6) AS tx FROM x"""
)
def transforms_of_frames(spark, sf):
    """Rotations and translations for every frame between those of the steps."""
    e = series_of(spark, sf)
    raw = [F.sin("value"), F.lit(0.3), F.cos("value"), 0.5 + F.col("event_id") % 3]
    n = F.sqrt(raw[0] ** 2 + raw[1] ** 2 + raw[2] ** 2 + raw[3] ** 2)
    s = F.col("value") / 500
    anchors = kind(e, "view").select("user_id", "us", F.array(*[x / n for x in raw]).alias("q"), F.array(s, s, s).alias("t"), F.lit(1.0).alias("scale"))
    out = alignment.frame_transforms(anchors, e.select("user_id", "event_id", "us"), BY, "us")
    return out.select("event_id", F.round(F.col("q")[0], 5).alias("qx"), F.round(F.col("q")[3], 5).alias("qw"), r6(F.col("t")[0]).alias("tx"))


@query("SELECT l_orderkey % 1000 AS frame, l_linenumber AS obj, min(l_partkey % 64) AS x1, min(l_suppkey % 48) AS y1, max(l_partkey % 64) AS x2, max(l_suppkey % 48) AS y2 FROM lineitem WHERE l_discount * 10 > 0.5 GROUP BY ALL")
def mask_boxes(spark, sf):
    """Boxes around the union of each object's masks."""
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("frame"), F.col("l_linenumber").alias("obj"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 48).alias("y"), (F.col("l_discount") * 10).alias("p"))
    return masks.mask_boxes(masks.mask_union(p, ["frame", "obj"]), ["frame", "obj"])


@query("SELECT vec_id, round(embedding[label % 5 + 2]::DOUBLE / 100, 9) AS x, round(embedding[label % 5 + 4]::DOUBLE / 100, 9) AS z FROM embeddings")
def channel_positions(spark, sf):
    """A node's position in metres out of a frame's channels."""
    x, _, z = channel_position(F.col("embedding"), F.col("label") % 5)
    return table(spark, sf, "embeddings").select("vec_id", F.round(x, 9).alias("x"), F.round(z, 9).alias("z"))


@query(
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
    k AS (SELECT unnest([0, 1, 2, 2, 3, 3, 4, 4, 1]) AS c, unnest(range(0, 9)) AS place), o AS (SELECT place, CASE c WHEN 1 THEN -0.3 WHEN 2 THEN 0.3 WHEN 3 THEN 0.3 WHEN 4 THEN -0.3 ELSE 0 END AS x,
      CASE c WHEN 1 THEN -0.2 WHEN 2 THEN -0.2 WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 ELSE 0 END AS y, CASE c WHEN 0 THEN 0 ELSE 1.0 END AS z FROM k)
    SELECT vec_id, place::INT AS place, round(a - y, 6) AS x, round(b + x, 6) AS y, round(c + z, 6) AS z FROM e, o"""
)
def frustums(spark, sf):
    """Outlines of cameras in the world."""
    at = lambda k: F.col("embedding")[k].cast("double")
    points = V.frustum_points((at(0), at(1), at(2)), V.literal_rows(_TURN), 1.0, 0.3, 0.2)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(points).alias("place", "p")).select("vec_id", "place", *[r6(F.col(f"p.{c}")).alias(c) for c in "xyz"])


def mesh_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A strip of triangles over the embeddings in order."""
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").alias("vid"), *[(4 * F.col("embedding")[k].cast("double")).alias(c) for k, c in enumerate("xyz")])
    last = v.select(F.max("vid").alias("last"))
    faces = v.select(F.col("vid").alias("fid")).join(F.broadcast(last)).where("fid + 2 <= last").select("fid", F.col("fid").alias("i0"), (F.col("fid") + 1).alias("i1"), (F.col("fid") + 2).alias("i2"))
    return v, faces


_STRIP = """WITH v AS (SELECT vec_id AS vid, 4 * embedding[1]::DOUBLE AS x, 4 * embedding[2]::DOUBLE AS y, 4 * embedding[3]::DOUBLE AS z FROM embeddings),
    f AS (SELECT a.vid AS fid, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 2),
    e AS (SELECT *, x1 - x0 AS ax, y1 - y0 AS ay, z1 - z0 AS az, x2 - x0 AS bx, y2 - y0 AS by0, z2 - z0 AS bz FROM f),
    c AS (SELECT *, ay*bz - az*by0 AS cx, az*bx - ax*bz AS cy, ax*by0 - ay*bx AS cz FROM e), n AS (SELECT *, cx / sqrt(cx*cx + cy*cy + cz*cz) AS nx, cy / sqrt(cx*cx + cy*cy + cz*cz) AS ny, cz / sqrt(cx*cx + cy*cy + cz*cz) AS nz FROM c)"""


@query(
    _STRIP + """, w AS (SELECT fid + k AS vid, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM n, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL)
    SELECT v.vid, round(mx / sqrt(mx*mx + my*my + mz*mz), 5) AS nx, round(mz / sqrt(mx*mx + my*my + mz*mz), 5) AS nz FROM v LEFT JOIN w USING (vid)"""
)
def normals_of_vertices(spark, sf):
    """Normals of vertices from their faces."""
    return spatial.vertex_normals(*mesh_of(spark, sf)).select("vid", F.round("nx", 5).alias("nx"), F.round("nz", 5).alias("nz"))


@query(
    _STRIP + """, r AS (SELECT vec_id AS rid, 4 * embedding[8]::DOUBLE AS ox, 4 * embedding[9]::DOUBLE AS oy, 6.0::DOUBLE AS oz, embedding[10]::DOUBLE AS dx, embedding[11]::DOUBLE AS dy, -1.0::DOUBLE AS dz FROM embeddings),
    s AS (SELECT r.*, ox + dx * (4.0 + 4.0 * k / 19) AS sx, oy + dy * (4.0 + 4.0 * k / 19) AS sy FROM r, (SELECT unnest(range(0, 20)) AS k)),
    m AS (SELECT DISTINCT rid, fid FROM s JOIN n ON (sx - (x0 + x1 + x2) / 3) ** 2 + (sy - (y0 + y1 + y2) / 3) ** 2 <= 0.25),
    t AS (SELECT rid, fid, nz, dy*bz - dz*by0 AS px, dz*bx - dx*bz AS py, dx*by0 - dy*bx AS pz, ox - x0 AS tx, oy - y0 AS ty, oz - z0 AS tz, dx, dy, dz, ax, ay, az, bx, by0, bz FROM m JOIN r USING (rid) JOIN n USING (fid)),
    u AS (SELECT *, ax*px + ay*py + az*pz AS det, ty*az - tz*ay AS qx, tz*ax - tx*az AS qy, tx*ay - ty*ax AS qz FROM t),
    h AS (SELECT rid, fid, abs(nz) > 0.7 AS ground, CASE WHEN abs(det) > 1e-12 AND (tx*px + ty*py + tz*pz) / det >= 0 AND (dx*qx + dy*qy + dz*qz) / det >= 0 AND (tx*px + ty*py + tz*pz) / det + (dx*qx + dy*qy + dz*qz) / det <= 1
      AND (bx*qx + by0*qy + bz*qz) / det > 1e-9 THEN (bx*qx + by0*qy + bz*qz) / det END AS t FROM u),
    b AS (SELECT rid, count(*) AS c, count(t) AS n, arg_min({'t': t, 'g': ground}, (NOT ground, t, fid)) FILTER (t IS NOT NULL) AS b FROM h GROUP BY rid)
    SELECT r.rid, round(ox + dx * b.b.t, 5) AS hx, round(oz - b.b.t, 5) AS hz, coalesce(c, 0) AS n_candidates, coalesce(n, 0) AS n_hits, b.b.g AS on_ground FROM r LEFT JOIN b USING (rid)"""
)
def ground_hits(spark, sf):
    """Rays against the triangles near them, ground before walls."""
    v, faces = mesh_of(spark, sf)
    at = lambda k: F.col("embedding")[k].cast("double")
    rays = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"), (4 * at(7)).alias("ox"), (4 * at(8)).alias("oy"), F.lit(6.0).alias("oz"), at(9).alias("dx"), at(10).alias("dy"), F.lit(-1.0).alias("dz"))
    out = spatial.ray_hits(rays, spatial.triangles(v, faces), zlo=-2.0, zhi=2.0)
    return out.select("rid", F.round("hx", 5).alias("hx"), F.round("hz", 5).alias("hz"), "n_candidates", "n_hits", "on_ground")
