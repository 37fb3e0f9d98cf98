"""Operators against data with a known truth, plain versions, and edge cases."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseframe.functions import vectors as V
from poseframe.operators import fits, series, spatial
from poseframe.operators.asof import asof_join
from poseframe.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("block", [None, 3])
@pytest.mark.parametrize("tie", ["earlier", "later"])
def test_asof_equals_a_scan(spark, tie, block):
    rng = random.Random(1)
    left = [(k, rng.randint(0, 30), i) for i, k in enumerate(rng.choices([0, 1, 2], k=40))]
    right = [(k, rng.randint(0, 30), i) for i, k in enumerate(rng.choices([0, 1], k=25))]
    out = asof_join(frame(spark, left, "k int, t int, i int"), frame(spark, right, "k int, t int, j int"), "t", ["k"], tie=tie, order="j", block=block)
    got = {r["i"]: r["r_j"] for r in out.collect()}
    for k, t, i in left:
        near = sorted((abs(u - t), u if tie == "earlier" else -u, j) for q, u, j in right if q == k)
        assert got[i] == (near[0][2] if near else None)


def test_asof_empty_and_null_times(spark):
    left = frame(spark, [(1, None), (1, 5)], "k int, t int")
    none = frame(spark, [], "k int, t int, v int")
    assert [r["r_v"] for r in asof_join(left, none, "t", ["k"]).collect()] == [None, None]
    one = frame(spark, [(1, 4, 9), (1, None, 8)], "k int, t int, v int")
    assert {r["t"]: r["r_v"] for r in asof_join(left, one, "t", ["k"]).collect()} == {None: None, 5: 9}


def test_slip_walk_holds_the_heel(spark):
    rng, rows, i = random.Random(2), [], 0
    for step in range(6):
        foot = "LeftFoot" if step % 2 == 0 else "RightFoot"
        for _ in range(rng.randint(3, 6)):
            rows.append((1, i, foot, i * 0.1, i * 0.07 + 1))
            i += 1
    df = frame(spark, rows, "rec int, f int, foot string, lx double, rx double")
    out = series.slip_corrected(df, ["rec"], "f", "foot", {"LeftFoot": ["lx"], "RightFoot": ["rx"]}, [["lx"], ["rx"]]).orderBy("f").collect()
    last = max(r["island"] for r in out)
    for k in range(last):
        heel = [r["lx"] if r["foot"] == "LeftFoot" else r["rx"] for r in out if r["island"] == k]
        assert max(heel) - min(heel) < 1e-12
    # the same by going through the frames one by one
    carry, start, prev, foot = 0.0, None, None, None
    for r, (_, _, f, lx, rx) in zip(out, rows, strict=True):
        h = lx if f == "LeftFoot" else rx
        if f != foot:
            if foot is not None:
                carry += start - prev
            foot, start = f, h
        prev = h
        shift = carry + (start - h if r["island"] < last else 0.0)
        assert abs(r["lx"] - (lx + shift)) < 1e-9


def test_rigid_truth_is_recovered(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = np.array([1.0, -2.0, 0.5])
    src = rng.normal(size=(40, 3)) + 50
    dst = 1.7 * src @ q.T + t
    rows = [(1, i, *map(float, s), *map(float, d)) if i % 8 else (1, i, *[None] * 6) for i, (s, d) in enumerate(zip(src, dst, strict=True))]
    df = frame(spark, rows, "rec int, f int, " + ", ".join(f"{c} double" for c in fits.S + fits.D))
    fit = fits.global_fit(df, ["rec"], with_scale=True).first()
    assert np.allclose(np.reshape(fit["r"], (3, 3)), q, atol=1e-7) and abs(fit["c"] - 1.7) < 1e-7
    assert fit["n"] == 35
    few = fits.global_fit(df.where("f < 3"), ["rec"]).first()
    assert few["r"] is None
    # windows: with a rigid motion every row finds it; with no valid pair it takes the whole
    same = [(r[0], r[1], *r[2:5], *(None if x is None else float(x) for x in ((np.array(r[2:5]) @ q.T + t) if r[2] is not None else [None] * 3))) for r in rows]
    df = frame(spark, same, df.schema)
    for r in fits.windowed_fit(df, ["rec"], "f", F.lit(6)).collect():
        assert np.allclose(np.reshape(r["r"], (3, 3)), q, atol=1e-5)
    for r in fits.windowed_shift(df, ["rec"], "f", F.lit(7)).collect():
        assert np.allclose(r["t"], t, atol=1e-5)
    assert fits.segment_fit(df.withColumn("seg", (F.col("f") / 20).cast("int")), ["rec"], "seg").count() == 40


def test_planted_drift_is_found(spark):
    at = np.arange(0, 120, 0.1)
    wave = lambda x: np.sin(x) + 0.5 * np.sin(0.37 * x + 1)
    a = frame(spark, [(1, float(t), float(wave(t))) for t in at], "rec int, t double, v double")
    b = frame(spark, [(1, float(t), float(-wave(t - 1.237))) for t in at], "rec int, t double, v double")
    got = fits.drift(a, b, ["rec"], coarse=(3.0, 0.05), fine=(0.2, 0.001)).first()
    assert abs(got["lag"] - 1.237) < 0.0015 and got["r"] < -0.99
    short = fits.lag_correlation(a.where("t < 2"), b, spark.createDataFrame([(0.0,)], "lag double"), ["rec"]).first()
    assert short["r"] == 0.0


def test_turn_has_one_break_and_keeps_apart(spark):
    path = [(float(i), 0.0) for i in range(40)] + [(39.0, float(i)) for i in range(1, 12)] + [(39.0 + i, 11.0) for i in range(1, 40)]
    df = frame(spark, [(1, i, x, y) for i, (x, y) in enumerate(path)], "rec int, i int, x double, y double")
    turns = series.heading_change(df, ["rec"], "i", "x", "y", 4).withColumn("a", F.abs("turn"))
    breaks = series.peaks(turns, ["rec"], "i", "a", 30.0, 20).collect()
    assert len(breaks) == 1 and abs(breaks[0]["i"] - 39) <= 1
    assert len(series.peaks(turns, ["rec"], "i", "a", 30.0, 5).collect()) == 2
    assert series.peaks(turns, ["rec"], "i", "a", 300.0, 5).count() == 0


def test_spikes_are_the_outliers(spark):
    rows = [("L", i, 0.002 * i + (5.0 if i in (30, 60, 90) else 0.01 * (i * 7 % 5)), 0.0) for i in range(120)]
    out = series.outliers_blanked(frame(spark, rows, "foot string, i int, x double, y double"), ["foot"], "i", ["x", "y"])
    assert sorted(r["i"] for r in out.where("outlier").collect()) == [30, 60, 90]


def test_smoothing_keeps_a_constant_and_reflects(spark):
    df = frame(spark, [(1, i, 2.5, float(i)) for i in range(5)], "rec int, i int, c double, v double")
    out = series.gaussian_smooth(df, ["rec"], "i", ["c", "v"], 3.0).orderBy("i").collect()
    assert all(abs(r["c"] - 2.5) < 1e-12 for r in out)
    assert abs(out[0]["v"] + out[4]["v"] - 4) < 1e-9
    assert series.gaussian_smooth(df, ["rec"], "i", ["v"], 0).collect() == df.collect()


def test_gap_fill_edges_and_all_null(spark):
    rows = [(1, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [(2, i, None) for i in range(2)]
    out = series.gaps_filled(frame(spark, rows, "k int, i int, v double"), ["k"], "i", "v").orderBy("k", "i").collect()
    assert [r["v"] for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, None, None]


def test_unit_plane_prefers_ground(spark):
    verts = [(0, -5.0, -5.0, 0.0), (1, 5.0, -5.0, 0.0), (2, 5.0, 5.0, 0.0), (3, -5.0, 5.0, 0.0), (4, 0.5, -5.0, -1.0), (5, 0.5, 5.0, -1.0), (6, 0.5, 0.0, 5.0)]
    tris = spatial.triangles(frame(spark, verts, "vid int, x double, y double, z double"), frame(spark, [(0, 0, 1, 2), (1, 0, 2, 3), (2, 4, 5, 6)], "fid int, i0 int, i1 int, i2 int"))
    rays = [(1, 0.0, 0.0, 2.0, 0.5, 0.0, -1.0), (2, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0), (3, 50.0, 0.0, 2.0, 0.0, 0.0, -1.0)]
    got = {r["rid"]: r for r in spatial.ray_hits(frame(spark, rays, "rid int, ox double, oy double, oz double, dx double, dy double, dz double"), tris, radius=6.0, zlo=-1.0, zhi=1.0).collect()}
    assert got[1]["on_ground"] and abs(got[1]["hx"] - 1.0) < 1e-9 and abs(got[1]["hz"]) < 1e-9 and got[1]["n_hits"] == 2
    assert got[2]["hx"] is None and got[3]["n_candidates"] == 0


def test_quaternions_round_trip(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(50):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q) * (1 if q[3] >= 0 else -1)
        rows.append(tuple(map(float, q)))
    df = frame(spark, rows, "x double, y double, z double, w double")
    back = V.quaternion_of(V.rotation_of(V.vec("x", "y", "z") + (F.col("w"),)))
    for r in df.select("*", *[c.alias(f"b{i}") for i, c in enumerate(back)]).collect():
        assert all(abs(r[i] - r[4 + i]) < 1e-9 for i in range(4))


def test_points_are_matched(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(60, 3)) * 3
    a = 0.02
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = p @ r.T + np.array([0.05, -0.03, 0.02])
    src = frame(spark, [(i, *map(float, x)) for i, x in enumerate(p)], "pid int, sx double, sy double, sz double")
    dst = frame(spark, [tuple(map(float, x)) for x in q], "dx double, dy double, dz double")
    got_r, got_t = fits.match_points(src, dst, 1.0, rounds=6)
    assert np.allclose(got_r, r, atol=1e-6) and np.allclose(got_t, [0.05, -0.03, 0.02], atol=1e-6)


def test_ply_both_ways(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty double y\nproperty float z\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    v = [(0, 0, 0, 1), (1, 0, 0, 2), (0, 1, 0, 3), (1, 1, 0.5, 4)]
    text = head.format("ascii") + "".join(" ".join(map(str, x)) + "\n" for x in v) + "3 0 1 2\n4 0 1 2 3\n"
    binary = head.format("binary_little_endian").encode() + b"".join(struct.pack("<fdfB", *x) for x in v) + struct.pack("<B3i", 3, 0, 1, 2) + struct.pack("<B4i", 4, 0, 1, 2, 3)
    (tmp_path / "a.ply").write_text(text)
    (tmp_path / "b.ply").write_bytes(binary)
    vertices, faces = readers.read_ply(spark, str(tmp_path))
    assert vertices.count() == 8 and faces.count() == 2
    assert {(r["x"], r["y"], r["z"]) for r in vertices.where("vid = 3").collect()} == {(1.0, 1.0, 0.5)}


def test_readers_of_text_and_json(spark, tmp_path):
    srt = "1\nFrameCnt: 1, DiffTime\n2024-05-01 10:00:00.033\n[latitude: 51.5] [longitude: -0.1]\n\n2\nFrameCnt: 2\n2024-05-01 10:00:00.066\n[latitude: 51.6] [longitude: -0.2]\n"
    (tmp_path / "s.srt").write_text(srt)
    rows = readers.read_subtitles(spark, str(tmp_path / "s.srt")).orderBy("pos").collect()
    assert [(r["frame"], r["latitude"]) for r in rows] == [(1, 51.5), (2, 51.6)] and rows[1]["local_time"].microsecond == 66000
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose" / "cam_000000000007_keypoints.json").write_text('{"people": [{"pose_keypoints_2d": [1, 2, 0.9, 3, 4, 0.1]}]}')
    (tmp_path / "pose" / "cam_000000000008_keypoints.json").write_text('{"people": []}')
    poses = readers.read_poses(spark, str(tmp_path / "pose"))
    got = {r["frame"]: (r["a"], r["b"]) for r in poses.select("frame", readers.keypoint(0, 0.3)[0].alias("a"), readers.keypoint(1, 0.3)[0].alias("b")).collect()}
    assert got == {7: (1.0, None), 8: (None, None)}
    (tmp_path / "c.json").write_text('{"frames": [{"file_path": "x/frame_00012.png", "transform_matrix": [[1,0,0,7],[0,1,0,8],[0,0,1,9],[0,0,0,1]], "fl_x": 1, "fl_y": 2, "cx": 3, "cy": 4}, {"file_path": "bad.png", "transform_matrix": []}]}')
    cams = readers.read_cameras(spark, str(tmp_path / "c.json")).collect()
    assert len(cams) == 1 and cams[0]["frame"] == 12 and cams[0]["px"] == 7.0
    (tmp_path / "t.csv").write_text("frame,time,Head_x,Head_y,Head_z\n1,0.5,1,2,nan\n2,,3,,5\n")
    t = readers.read_table(spark, str(tmp_path / "t.csv"), "frame bigint, time double, Head_x double, Head_y double, Head_z double, gone string")
    long = {r["frame"]: (r["x"], r["y"], r["z"]) for r in readers.joints_long(t, ["frame"]).collect()}
    assert long == {1: (1.0, 2.0, None), 2: (3.0, None, 5.0)}


def test_mesh_hits_size_their_search_by_the_triangles(spark):
    rng = np.random.default_rng(5)
    base = rng.uniform(-40, 40, (25, 1, 3))
    tris = [(i, *map(float, t.ravel()), *map(float, t.mean(0)[:2])) for i, t in enumerate(base + rng.uniform(-9, 9, (25, 3, 3)))]
    cols = ["fid", *[f"{c}{k}" for k in range(3) for c in "xyz"], "cx", "cy"]
    mesh = spark.createDataFrame(tris, ", ".join(f"{c} {'long' if c == 'fid' else 'double'}" for c in cols))
    aims = [(i, np.array(rng.uniform(-60, 60, 3)), np.array(t[1:10]).reshape(3, 3).mean(0)) for i, t in enumerate(tris)]
    rows = [(i, *map(float, o), *map(float, (p - o) / np.linalg.norm(p - o))) for i, o, p in aims]
    rows += [(100 + i, float(p[0] - 50), float(p[1] - 3), float(p[2]), 1.0, 0.06, 0.0) for i, _, p in aims]
    rays = spark.createDataFrame(rows, "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    t = V.ray_triangle(V.vec("ox", "oy", "oz"), V.vec("dx", "dy", "dz"), *[V.vec(f"x{k}", f"y{k}", f"z{k}") for k in range(3)])
    want = rays.crossJoin(mesh).withColumn("t", t).where("t is not null").groupBy("rid").agg(F.min("t").alias("t"), F.count("*").alias("n_hits"))
    got = spatial.mesh_hits(rays, mesh)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 40
    assert spatial.mesh_hits(rays.where("false"), mesh).count() == spatial.mesh_hits(rays, mesh.where("false")).count() == 0


def test_whole_tables_are_read(spark, sf):
    from poseframe.catalog import QUERIES

    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    assert QUERIES["all_frames"](spark, sf).where("o_custkey is not null").count() == read("orders").count()
    every = {r["rid"] for r in QUERIES["all_ray_hits"](spark, sf).collect()}
    assert {k % 5 for k in every} == {0, 1, 2, 3, 4}
    best = {r["s_nationkey"]: r["best"] for r in QUERIES["best_of_all"](spark, sf).collect()}
    s = [(r["s_nationkey"], r["s_acctbal"], r["s_suppkey"]) for r in read("supplier").collect()]
    assert all((n, b, best[n]) in s and b == max(x[1] for x in s if x[0] == n) for n, b, k in s if k == best[n]) and set(best) == {x[0] for x in s}
