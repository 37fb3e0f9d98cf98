"""Queries of the plans that go from one end to the other: contacts of feet and the aligned body."""

from __future__ import annotations

from pyspark.sql import functions as F

from poseframe.catalog import BY, query, r6, table
from poseframe.operators import spatial
from poseframe.plans import body as body_plan
from poseframe.plans import contacts
from poseframe.plans.catalog import _ANCHOR, _POSE, _STRIP, _turned_sql, mesh_of, poses_of, rows_of, with_heels

_FLAT = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
#: Events as aligned rows and poses, cameras from embeddings; the heel of each frame.
_HEELS = f""", ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events), er AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i FROM ev),
    hs AS (SELECT user_id, event_id % 97 AS df, arg_max(event_type < 'm', us) AS l FROM er GROUP BY ALL),
    hp AS (SELECT user_id, i AS df, kp FROM (SELECT user_id, i, {_POSE} AS kp FROM er)), hn AS (SELECT user_id, count(*) AS n FROM er GROUP BY user_id),
    cam AS (SELECT vec_id AS df, 4 * embedding[8]::DOUBLE AS ox, 4 * embedding[9]::DOUBLE AS oy FROM embeddings WHERE vec_id % 13 != 0),
    hr AS (SELECT user_id, df, l, CASE WHEN l THEN kp[58] ELSE kp[67] END AS px, CASE WHEN l THEN kp[59] ELSE kp[68] END AS py FROM hs JOIN hp USING (user_id, df) JOIN hn USING (user_id)
      WHERE df < n AND CASE WHEN l THEN kp[60] ELSE kp[69] END >= 0.3)"""
_HITS = (
    _STRIP
    + _HEELS
    + """, zz AS (SELECT min(least(z0, z1, z2)) - 0.5 AS lo, max(greatest(z0, z1, z2)) + 0.5 AS hi FROM n),
    r0 AS (SELECT user_id, df, l, ox, oy, (px - 48) / 100 AS a, -(py - 48) / 100 AS b FROM hr JOIN cam USING (df)),
    r AS (SELECT user_id, df, l, ox, oy, 6.0::DOUBLE AS oz, a / sqrt(a*a + b*b + 1) AS dx, b / sqrt(a*a + b*b + 1) AS dy, -1 / sqrt(a*a + b*b + 1) AS dz FROM r0),
    r1 AS (SELECT r.*, greatest(0, least((lo - oz) / dz, (hi - oz) / dz)) AS t0, greatest((lo - oz) / dz, (hi - oz) / dz) AS t1 FROM r, zz),
    s AS (SELECT *, ox + dx * (t0 + (t1 - t0) * k / 19) AS sx, oy + dy * (t0 + (t1 - t0) * k / 19) AS sy FROM r1, (SELECT unnest(range(0, 20)) AS k) WHERE t1 >= 0),
    m AS (SELECT DISTINCT user_id, df, fid FROM s JOIN n ON (sx - (x0 + x1 + x2) / 3) ** 2 + (sy - (y0 + y1 + y2) / 3) ** 2 <= 0.25),
    t AS (SELECT user_id, df, fid, n.nz, dy*bz - dz*by0 AS px, dz*bx - dx*bz AS py, dx*by0 - dy*bx AS pz, ox - x0 AS tx, oy - y0 AS ty, oz - z0 AS tz, dx, dy, dz, ax, ay, az, bx, by0, bz FROM m JOIN r USING (user_id, df) JOIN n USING (fid)),
    u AS (SELECT *, ax*px + ay*py + az*pz AS det, ty*az - tz*ay AS qx, tz*ax - tx*az AS qy, tx*ay - ty*ax AS qz FROM t),
    h AS (SELECT user_id, df, fid, abs(nz) > 0.7 AS ground, CASE WHEN abs(det) > 1e-12 AND (tx*px + ty*py + tz*pz) / det >= 0 AND (dx*qx + dy*qy + dz*qz) / det >= 0 AND (tx*px + ty*py + tz*pz) / det + (dx*qx + dy*qy + dz*qz) / det <= 1
      AND (bx*qx + by0*qy + bz*qz) / det > 1e-9 THEN (bx*qx + by0*qy + bz*qz) / det END AS t FROM u),
    hb AS (SELECT user_id, df, count(*) AS c, arg_min({'t': t, 'g': ground}, (NOT ground, t, fid)) FILTER (t IS NOT NULL) AS b FROM h GROUP BY ALL),
    hh AS (SELECT r.user_id, r.df, l, coalesce(c, 0) AS n_candidates, ox + dx * b.t AS x, oy + dy * b.t AS y, oz + dz * b.t AS z, coalesce(b.g, false) AS g FROM r LEFT JOIN hb USING (user_id, df)),
    hl AS (SELECT *, list(x) OVER w AS lx, list(y) OVER w AS ly, list(z) OVER w AS lz, row_number() OVER (PARTITION BY user_id, l ORDER BY df) AS k FROM hh WHERE x IS NOT NULL
      WINDOW w AS (PARTITION BY user_id, l ORDER BY df ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    hd AS (SELECT *, sqrt((x - list_sort([lx[greatest(1, least(len(lx), k + j))] FOR j IN range(-10, 11)])[11]) ** 2 + (y - list_sort([ly[greatest(1, least(len(ly), k + j))] FOR j IN range(-10, 11)])[11]) ** 2
      + (z - list_sort([lz[greatest(1, least(len(lz), k + j))] FOR j IN range(-10, 11)])[11]) ** 2) AS d FROM hl),
    hm AS (SELECT *, median(d) OVER (PARTITION BY user_id, l) AS mid FROM hd), hk AS (SELECT *, median(abs(d - mid)) OVER (PARTITION BY user_id, l) AS mad FROM hm),
    ho AS (SELECT hh.*, coalesce(d > 4 * greatest(mad, 0.001), false) AS outlier FROM hh LEFT JOIN (SELECT user_id, df, d, mad FROM hk) USING (user_id, df))"""
)


def _inputs(spark, sf):
    e = rows_of(spark, sf)
    steps = with_heels(e).withColumns({"frame": F.col("i") + 1, "dji_frame": F.col("event_id") % 97})
    at = lambda k: 4 * F.col("embedding")[k].cast("double")
    flat = F.array(*[F.lit(x) for row in _FLAT for x in row])
    cameras = table(spark, sf, "embeddings").where("vec_id % 13 != 0").select(F.col("vec_id").alias("frame"), at(7).alias("px"), at(8).alias("py"), F.lit(6.0).alias("pz"), flat.alias("r"), *[F.lit(x).alias(n) for n, x in (("fl_x", 100.0), ("fl_y", 100.0), ("cx", 48.0), ("cy", 48.0))])
    return steps, poses_of(e).drop("event_id"), cameras, spatial.triangles(*mesh_of(spark, sf))


@query(_HITS + " SELECT user_id, df AS dji_frame, n_candidates, outlier, CASE WHEN NOT outlier THEN round(x, 5) END AS hit_x, CASE WHEN NOT outlier THEN round(z, 5) END AS hit_z, g AND NOT outlier AS hit_is_ground FROM ho")
def contact_hits(spark, sf):
    """Heels through cameras onto the mesh, far ones blanked."""
    from poseframe.plans.steps import heel_rows

    steps, poses, cameras, tris = _inputs(spark, sf)
    out = contacts.heel_hits(heel_rows(steps, poses, BY, "us", 0.3), cameras, tris, BY, fix=_FLAT, times=4.0)
    return out.select("user_id", "dji_frame", "n_candidates", "outlier", F.round("hit_x", 5).alias("hit_x"), F.round("hit_z", 5).alias("hit_z"), "hit_is_ground")


@query(
    _HITS + """, ei AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us) - 1 AS island FROM (SELECT *, coalesce(((event_type < 'm') IS DISTINCT FROM lag(event_type < 'm') OVER (PARTITION BY user_id ORDER BY us))::INT, 1) AS st FROM er)),
    ef AS (SELECT *, CASE WHEN event_type < 'm' THEN value ELSE value / 2 + event_id % 7 END AS heel FROM ei),
    ea AS (SELECT *, first_value(heel) OVER (PARTITION BY user_id, island ORDER BY us) AS s0, max(island) OVER (PARTITION BY user_id) AS top, lead(island) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM ef),
    eb AS (SELECT *, coalesce(sum(CASE WHEN nx != island THEN s0 - heel ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carry FROM ea),
    ec AS (SELECT eb.*, heel + carry + CASE WHEN island < top THEN s0 - heel ELSE 0 END AS fixed, hx, hy, hz FROM eb
      LEFT JOIN (SELECT user_id, df, x AS hx, y AS hy, z AS hz FROM ho WHERE NOT outlier AND x IS NOT NULL) q ON q.user_id = eb.user_id AND q.df = eb.event_id % 97),
    eg AS (SELECT user_id, island, arg_min(event_type < 'm', us) AS l, min(i) + 1 AS frame_start, count(*) AS n_frames, count(hx) AS n_valid, median(hx) AS mx, median(hy) AS my, median(hz) AS mz, arg_min(fixed, us) AS shadow FROM ec GROUP BY user_id, island)
    SELECT user_id, island::BIGINT AS step_idx, CASE WHEN l THEN 'LeftFoot' ELSE 'RightFoot' END AS stance_foot, frame_start, frame_end, n_frames, n_valid, round(mx, 5) AS median_hit_x, round(my, 5) AS median_hit_y, round(mz, 5) AS median_hit_z,
      round(shadow, 6) AS shadow_heel_x FROM (SELECT *, lead(frame_start) OVER (PARTITION BY user_id ORDER BY island) AS frame_end FROM eg) WHERE frame_end IS NOT NULL"""
)
def contact_steps(spark, sf):
    """Poses, cameras and mesh to the table of steps in one plan (entry B: X6, J7, J16 to J19, W5, X7)."""
    steps, poses, cameras, tris = _inputs(spark, sf)
    out = contacts.contact_table(steps, poses, cameras, tris, BY, "us", least=0.3, fix=_FLAT, times=4.0)
    hit = [F.round(f"median_hit_{c}", 5).alias(f"median_hit_{c}") for c in "xyz"]
    return out.select("user_id", "step_idx", "stance_foot", F.col("frame_start").cast("long").alias("frame_start"), F.col("frame_end").cast("long").alias("frame_end"), "n_frames", "n_valid", *hit, r6(F.col("shadow_heel_x")).alias("shadow_heel_x"))


@query(
    "WITH z AS (SELECT 1)" + _HEELS + """, p AS (SELECT hp.*, hs.l, n, cam.df IS NOT NULL AS cam FROM hp JOIN hn USING (user_id) LEFT JOIN hs USING (user_id, df) LEFT JOIN cam USING (df)),
    w AS (SELECT user_id, CASE WHEN l IS NULL THEN 'r' WHEN NOT coalesce(CASE WHEN l THEN kp[60] ELSE kp[69] END >= 0.3, false) THEN 'l' WHEN NOT cam THEN 'c' ELSE 'k' END AS why FROM p)
    SELECT user_id, count(*) FILTER (why = 'r') AS no_row, 0::BIGINT AS no_pose, count(*) FILTER (why = 'l') AS low_confidence, count(*) FILTER (why = 'c') AS no_camera, count(*) FILTER (why = 'k') AS kept FROM w GROUP BY user_id"""
)
def contact_misses(spark, sf):
    """How many pose frames fall out, by the first reason that holds."""
    steps, poses, cameras, _ = _inputs(spark, sf)
    return contacts.miss_counts(steps, poses, cameras, BY, "us", 0.3)


# The aligned body -------------------------------------------------------------------------------------------------------


def _body_sql() -> str:
    from poseframe.catalog import EV

    turn = _turned_sql(("qx", "qy", "qz", "qw"), ("jx", "jy", "jz"))
    return EV + f""", a0 AS ({_ANCHOR}), an AS (SELECT user_id, us, s, [x / sqrt(q0[1]**2 + q0[2]**2 + q0[3]**2 + q0[4]**2) FOR x IN q0] AS q FROM a0),
    sl AS (SELECT *, event_type < 'm' AS l FROM ev), i0 AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us) - 1 AS island FROM (SELECT *, coalesce((l IS DISTINCT FROM lag(l) OVER (PARTITION BY user_id ORDER BY us))::INT, 1) AS st FROM sl)),
    i1 AS (SELECT *, CASE WHEN l THEN value ELSE value / 2 + event_id % 7 END AS hx, CASE WHEN l THEN value + 1 ELSE value / 2 END AS hy, CASE WHEN l THEN value + 2 ELSE value / 4 END AS hz FROM i0),
    i2 AS (SELECT *, first_value(hx) OVER p AS sx, first_value(hy) OVER p AS sy, first_value(hz) OVER p AS sz, max(island) OVER (PARTITION BY user_id) AS top, lead(island) OVER (PARTITION BY user_id ORDER BY us) AS nx FROM i1 WINDOW p AS (PARTITION BY user_id, island ORDER BY us)),
    i3 AS (SELECT *, coalesce(sum(CASE WHEN nx != island THEN sx - hx ELSE 0 END) OVER w, 0) + CASE WHEN island < top THEN sx - hx ELSE 0 END AS cx, coalesce(sum(CASE WHEN nx != island THEN sy - hy ELSE 0 END) OVER w, 0) + CASE WHEN island < top THEN sy - hy ELSE 0 END AS cy,
      coalesce(sum(CASE WHEN nx != island THEN sz - hz ELSE 0 END) OVER w, 0) + CASE WHEN island < top THEN sz - hz ELSE 0 END AS cz FROM i2 WINDOW w AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT user_id, event_id, us, -value / 10 + cx AS jx, value / 5 + cy AS jy, 1.7 + cz AS jz, (SELECT {{'t': an.us, 'q': an.q, 's': an.s}} FROM an WHERE an.user_id = i3.user_id AND an.us <= i3.us ORDER BY an.us DESC LIMIT 1) AS p0,
      (SELECT {{'t': an.us, 'q': an.q, 's': an.s}} FROM an WHERE an.user_id = i3.user_id AND an.us >= i3.us ORDER BY an.us LIMIT 1) AS n0 FROM i3),
    g AS (SELECT *, coalesce(p0, n0) AS p, coalesce(n0, p0) AS n, CASE WHEN n0.t > p0.t THEN (us - p0.t) / (n0.t - p0.t) ELSE 0 END AS f FROM f),
    d AS (SELECT *, list_dot_product(p.q, n.q) AS dot FROM g), e AS (SELECT *, acos(least(abs(dot), 1)) AS th, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg FROM d),
    w AS (SELECT *, CASE WHEN abs(dot) > 0.9999999 THEN 1 - f ELSE sin((1 - f) * th) / sin(th) END AS u, sg * CASE WHEN abs(dot) > 0.9999999 THEN f ELSE sin(f * th) / sin(th) END AS v FROM e),
    x AS (SELECT *, [u * p.q[k] + v * n.q[k] FOR k IN [1, 2, 3, 4]] AS m, p.s + f * (n.s - p.s) AS s FROM w), y AS (SELECT *, sqrt(list_dot_product(m, m)) AS b FROM x),
    q AS (SELECT *, m[1] / b AS qx, m[2] / b AS qy, m[3] / b AS qz, m[4] / b AS qw FROM y),
    gz AS (SELECT vec_id, vec_id % 3 != 0 AS seen, embedding[1]::DOUBLE AS gx, embedding[2]::DOUBLE AS r01 FROM embeddings)
    SELECT event_id, round(2 * {turn[0]} + s, 4) AS head_x, round(2 * {turn[1]} + s, 4) AS head_y, round(2 * {turn[2]} + s, 4) AS head_z, CASE WHEN seen THEN round(gx, 6) END AS gaze_x, seen::INT AS gaze_valid, round(r01, 6) AS cam_rot_r01
    FROM q LEFT JOIN gz ON gz.vec_id = event_id"""


@query(_body_sql())
def body_rows(spark, sf):
    """Every joint without slip and moved by its frame's transform, with camera and gaze."""
    e = with_heels(rows_of(spark, sf)).withColumn("dji_frame", F.col("event_id"))
    e = e.withColumns({"Head_x": -F.col("value") / 10, "Head_y": F.col("value") / 5, "Head_z": F.lit(1.7)})
    raw = [F.sin("value"), F.lit(0.3), F.cos("value"), 0.5 + F.col("event_id") % 3]
    n = F.sqrt(raw[0] ** 2 + raw[1] ** 2 + raw[2] ** 2 + raw[3] ** 2)
    s = F.col("value") / 500
    anchors = e.where("event_type = 'view'").select("user_id", "us", F.array(*[x / n for x in raw]).alias("q"), F.array(s, s, s).alias("t"), F.lit(2.0).alias("scale"))
    body = body_plan.aligned_body(e, anchors, BY, "us", "us")
    at = lambda k: F.col("embedding")[k].cast("double")
    seen = F.col("vec_id") % 3 != 0
    looks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("dji_frame"), *[at(3 * i + j).alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.when(seen, at(k)).alias(f"gaze_{c}") for k, c in enumerate("xyz")], seen.alias("gaze_valid"))
    looks = looks.join(e.select("user_id", "dji_frame"), "dji_frame")
    out = body_plan.body_table(body, looks, BY)
    return out.select("event_id", *[F.round(f"cam_pos_{a}", 4).alias(f"head_{a}") for a in "xyz"], r6(F.col("gaze_x")).alias("gaze_x"), F.col("gaze_valid").cast("int").alias("gaze_valid"), r6(F.col("cam_rot_r01")).alias("cam_rot_r01"))
