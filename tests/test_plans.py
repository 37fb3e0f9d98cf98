"""The composed pipelines against plain versions in NumPy, and on recordings with a known truth."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseframe.operators import fits, spatial
from poseframe.operators.asof import asof_join, bracketed
from poseframe.plans import alignment, clock_sync, gaze, steps


def smooth(x, sigma):
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    pad = np.pad(x, [(r, r)] + [(0, 0)] * (x.ndim - 1), mode="symmetric")
    return sum(w * pad[i : i + len(x)] for i, w in enumerate(k))


def rigid(s, d):
    u, _, vt = np.linalg.svd((d - d.mean(0)).T @ (s - s.mean(0)))
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))]) @ vt
    return r, d.mean(0) - r @ s.mean(0)


def walk(n=90, seed=4):
    """A turning walk at large coordinates with noise: pairs, some missing, and second pairs on some rows."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 3, n)
    src = np.c_[1e6 + 10 * t, 2e6 + 4 * np.sin(t), rng.normal(0, 0.3, n)]
    turn = 0.3 + 0.2 * np.tanh(4 * (t - 1.5))
    c, s = np.cos(turn), np.sin(turn)
    x = src - src.mean(0)
    dst = np.c_[c * x[:, 0] - s * x[:, 1], s * x[:, 0] + c * x[:, 1], x[:, 2] + 1] + rng.normal(0, 0.02, (n, 3)) + 5e5
    valid = rng.random(n) > 0.2
    head_src, has = src + [0, 0, 1.7], rng.random(n) > 0.6
    head_dst = dst + [0, 0, 1.7] + rng.normal(0, 0.05, (n, 3))
    return src, dst, valid, head_src, head_dst, has


def table_of(spark, src, dst, valid, hs, hd, has):
    row = lambda i, v, on: [float(x) if on else None for x in v[i]]
    rows = [(1, i, *row(i, src, True), *row(i, dst, valid[i]), *row(i, hs, has[i]), *row(i, hd, has[i])) for i in range(len(src))]
    return spark.createDataFrame(rows, "rec int, step int, " + ", ".join(f"{c} double" for c in (*fits.S, *fits.D, *fits.HS, *fits.HD)))


def plain_adaptive(src, dst, valid, hs, hd, has, rotate, second, widest=30, narrowest=8, sigma=2.0):
    n, at = len(src), np.flatnonzero(valid)
    heads = lambda lo, hi: np.flatnonzero(has & (np.arange(n) >= lo) & (np.arange(n) < hi)) if second else np.zeros(0, int)
    every = heads(0, n)
    whole = rigid(np.r_[src[at], hs[every]], np.r_[dst[at], hd[every]])

    def window(pos, width):
        hi = min(len(at), max(0, pos - width // 2) + width)
        return max(0, hi - width), hi

    def fit(pos, width, with_heads):
        lo, hi = window(pos, width)
        h = heads(at[lo], at[hi - 1] + 1) if with_heads else np.zeros(0, int)
        s, d = np.r_[src[at[lo:hi]], hs[h]], np.r_[dst[at[lo:hi]], hd[h]]
        if rotate:
            return rigid(s, d) if len(s) >= 3 else whole
        return whole[0], (d - s @ whole[0].T).mean(0)

    res = []
    for k in range(len(at)):
        r, t = fit(k, widest, rotate)
        res.append(np.linalg.norm(r @ src[at[k]] + t - dst[at[k]]))
    res = np.interp(np.arange(n), at, res)
    share = np.clip((res - res.mean()) / (1.5 * res.std() + 1e-9), 0, 1)
    width = np.clip(np.round(smooth(np.round(widest - share * (widest - narrowest)), sigma)), narrowest, widest).astype(int)
    moved = []
    for i in range(n):
        r, t = fit(min(int((at < i).sum()), len(at) - 1), width[i], True)
        w = math.sqrt(max(0.0, 1 + np.trace(r))) / 2  # turns here are small
        moved.append([(r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w), w, *t])
    sm = smooth(np.array(moved), sigma)
    q = sm[:, :4] / np.linalg.norm(sm[:, :4], axis=1, keepdims=True)
    x, y, z, w = q.T
    rows = np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)], 1)
    return np.einsum("nij,nj->ni", rows, src) + sm[:, 4:], width, res


@pytest.mark.parametrize("rotate", [True, False])
@pytest.mark.parametrize("second", [True, False])
def test_adaptive_alignment_equals_a_plain_one(spark, rotate, second):
    data = list(walk())
    for k in (0, 3):
        data[k] = data[k] - [1e6, 2e6, 0]  # the plain version's shift is far from its points else
    df = table_of(spark, *data)
    out = alignment.adaptive_alignment(df, ["rec"], "step", widest=30, narrowest=8, sigma=2.0, rotate=rotate, second=second).orderBy("step").collect()
    points, width, res = plain_adaptive(*data, rotate=rotate, second=second)
    assert [r["width"] for r in out] == width.tolist()
    assert np.allclose([r["residual"] for r in out], res, atol=1e-6)
    assert np.allclose([[r["ax"], r["ay"], r["az"]] for r in out], points, atol=1e-4)


def test_windows_far_from_the_origin_keep_their_digits(spark):
    src, dst, valid, *_ = data = walk()
    near = [d - [1e6, 2e6, 0] if k in (0, 3) else d for k, d in enumerate(data)]
    rows = lambda d: [r["res"] for r in fits.windowed_fit(table_of(spark, *d), ["rec"], "step", F.lit(30)).orderBy("step").select(alignment._misfit().alias("res")).collect()]
    a, b = rows(data), rows(near)
    assert [x is None for x in a] == [x is None for x in b]
    assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], atol=1e-6)


def test_segment_alignment_recovers_each_segment(spark):
    src, _, _, hs, _, has = walk(60)
    src = src - src.mean(0)
    label = np.arange(60) // 30
    dst = np.where(label[:, None] == 0, src + [1.0, 0, 0], src @ np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]]) + [0, 2.0, 0])
    df = table_of(spark, src, dst, np.arange(60) % 5 != 0, hs, hs, has).withColumn("label", (F.col("step") / 30).cast("int"))
    out = alignment.segment_alignment(df, ["rec"], "step", "label", sigma=1.0).orderBy("step").collect()
    got = np.array([[r["ax"], r["ay"], r["az"]] for r in out])
    far = [i for i in range(60) if abs(i - 29.5) > 6]
    assert np.allclose(got[far], dst[far], atol=1e-6)
    assert all(abs(sum(x * x for x in r["q"]) - 1) < 1e-9 for r in out)


def test_clocks_of_two_recordings_meet(spark):
    rng = np.random.default_rng(8)
    signal = lambda t: 20 * np.sin(1.3 * t) + 9 * np.sin(0.37 * t + 1)
    start = datetime.datetime(2024, 7, 1, 12, 0, 0)
    utc0 = (start - datetime.datetime(1970, 1, 1)).total_seconds() + 4 * 3600  # New York in July
    frames, poses = [], []
    for k in range(600):
        frames.append((1, k, start + datetime.timedelta(seconds=k / 10)))
        kp = [0.0] * 69
        kp[3 * 19 + 1], kp[3 * 22 + 1] = 100.0, 100.0 - float(signal(k / 10))
        kp[3 * 19 + 2] = kp[3 * 22 + 2] = 0.1 if rng.random() < 0.05 else 0.9
        if rng.random() > 0.05:
            poses.append((1, k, kp))
    shadow = [(1, utc0 + 1.25 + j / 20, float(signal(j / 20)), j) for j in range(1000)]
    out = clock_sync.clocks_aligned(
        spark.createDataFrame(frames, "rec int, frame long, local timestamp_ntz"), spark.createDataFrame(poses, "rec int, frame long, keypoints array<double>"),
        spark.createDataFrame(shadow, "rec int, t double, v double, j long"), ["rec"], "America/New_York", coarse=(3.0, 0.1), fine=(0.2, 0.01),
    ).collect()
    assert out and abs(out[0]["drift"] - 1.25) < 0.02
    assert all(abs(r["r_j"] / 20 - r["frame"] / 10) <= 0.06 for r in out) and len(out) == 500


def test_steps_of_odd_tables(spark):
    heels = ", ".join(f"{c} double" for cols in steps.HEELS.values() for c in cols)
    frames = spark.createDataFrame([], f"rec int, t long, frame long, dji_frame long, max_pressure_foot string, {heels}")
    hits = spark.createDataFrame([], "rec int, dji_frame long, hit_x double, hit_y double, hit_z double, outlier boolean")
    assert steps.step_table(frames, hits, ["rec"], "t").count() == 0
    rows = [(1, i, i, 10 + i, "LeftFoot" if i < 3 else "RightFoot", *[float(i)] * 6) for i in range(6)]
    some = spark.createDataFrame(rows, frames.schema)
    met = spark.createDataFrame([(1, 10, 1.0, 2.0, 3.0, False), (1, 11, 3.0, None, 3.0, False), (1, 12, 9.0, 9.0, 9.0, True)], hits.schema)
    one = steps.step_table(some, met, ["rec"], "t").collect()
    assert [(r["step_idx"], r["n_frames"], r["n_valid"], r["median_hit_x"], r["frame_start"], r["frame_end"]) for r in one] == [(0, 3, 1, 1.0, 0, 3)]
    assert steps.step_table(some, hits, ["rec"], "t").first()["median_hit_x"] is None


def test_gaze_without_a_surface_and_far_hits(spark):
    rays = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 0.0, 0.0, -1.0), (1, 1, 0.0, 0.0, 5.0, None, None, None), (1, 2, 0.0, 0.0, 500.0, 0.0, 0.0, -1.0), (1, 3, -3.0, 0.1, 0.5, 1.0, 0.0, 0.0)], "rec int, dji_frame long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert gaze.gaze_points(rays, None, ["rec"]).where("gaze_valid").count() == 0
    corners = [(0, -1.0, -1.0, 0.0), (1, 1.0, -1.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.5, -1.0, 0.0), (4, 0.5, 1.0, 0.0), (5, 0.5, 0.2, 3.0)]
    tris = spatial.triangles(spark.createDataFrame(corners, "vid int, x double, y double, z double"), spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "fid int, i0 int, i1 int, i2 int"))
    got = {r["dji_frame"]: r for r in gaze.gaze_points(rays, tris, ["rec"]).collect()}
    assert got[0]["gaze_valid"] and abs(got[0]["gaze_z"]) < 1e-9 and not got[1]["gaze_valid"] and not got[2]["gaze_valid"]
    assert got[3]["gaze_valid"] and abs(got[3]["gaze_x"] - 0.5) < 1e-9  # a level ray


def test_null_keys_meet_nothing(spark):
    left = spark.createDataFrame([(None, 1), (1, 1)], "k int, t int")
    right = spark.createDataFrame([(None, 1, 7), (1, 2, 8)], "k int, t int, v int")
    assert {(r["k"], r["r_v"]) for r in asof_join(left, right, "t", ["k"]).collect()} == {(None, None), (1, 8)}
    got = {r["k"]: (r["_p"], r["_n"]) for r in bracketed(left, right, "t", ["k"]).collect()}
    assert got[None] == (None, None) and got[1][0] is None and got[1][1]["v"] == 8


def test_lags_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(2)
    a = [(1, float(t), float(v)) for t, v in zip(np.sort(rng.random(300)) * 100, rng.normal(size=300), strict=True)]
    b = [(1, float(t), float(v)) for t, v in zip(np.sort(rng.random(400)) * 100, rng.normal(size=400), strict=True)]
    fa, fb = (spark.createDataFrame(x, "rec int, t double, v double") for x in (a, b))
    lags = spark.range(21).select((F.col("id") * 0.3 - 3).alias("lag"))
    got = {round(r["lag"], 3): (r["n"], r["r"]) for r in fits.lag_correlation(fa, fb, lags, ["rec"], block=7.0).collect()}
    ta, va = np.array(a)[:, 1], np.array(a)[:, 2]
    tb, vb = np.array(b)[:, 1], np.array(b)[:, 2]
    for k in range(21):
        x = ta + k * 0.3 - 3
        ok = (x >= tb[0]) & (x <= tb[-1])
        want = np.corrcoef(va[ok], np.interp(x[ok], tb, vb))[0, 1]
        n, r = got[round(k * 0.3 - 3, 3)]
        assert n == ok.sum() and abs(r - want) < 1e-9


def test_of_poses_only_heels_reach_the_join(spark, sf):
    from poseframe.catalog import BY
    from poseframe.plans import contacts, steps
    from poseframe.plans.contact_catalog import _inputs

    rows, poses, cameras, _ = _inputs(spark, sf)
    poses = poses.localCheckpoint()
    for out in (steps.heel_rows(rows, poses, BY, "us"), contacts.miss_counts(rows, poses, cameras, BY, "us", 0.3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "keypoints" not in plan[: plan.rindex("Join")]
