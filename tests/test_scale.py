"""Cut series, crowded cells, meshes of mixed sizes and clouds, against plain versions and known shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poseframe.functions import casting
from poseframe.operators import blocks, clouds, fits, series, spatial
from poseframe.operators.asof import asof_join, bracketed


def bursts(spark, n=400):
    """A series whose rows come in bursts, one without a key, a short one."""
    rng = np.random.default_rng(7)
    t = np.sort(np.r_[rng.uniform(0, 1000, n // 4), 500 + rng.uniform(0, 1e-3, n - n // 4)])
    rows = [(1, float(x), i, float(rng.normal()), i // 7 % 3) for i, x in enumerate(t)]
    rows += [(None, float(i), 1000 + i, float(i), 0) for i in range(30)] + [(2, float(i), 2000 + i, 1.0, i % 2) for i in range(5)]
    return spark.createDataFrame(rows, "k int, t double, i int, v double, w int")


def test_blocks_follow_bursts(spark):
    cut = blocks.blocked(bursts(spark), ["k"], "t", 40)
    sizes = {(r["k"], r["_block"]): r["n"] for r in cut.groupBy("k", "_block").agg(F.count("*").alias("n")).collect()}
    assert len([s for s in sizes if s[0] == 1]) >= 2 and sizes[(2, 0)] == 5 and sum(sizes.values()) == 435
    order = [r["_block"] for r in cut.where("k = 1").orderBy("t").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("rows", [9, 10_000])
def test_sums_lags_and_places_are_those_of_the_whole_series(spark, rows):
    df = bursts(spark)
    got = blocks.running_sums(df, ["k"], "t", {"s": F.col("w").cast("long")}, rows)
    got = blocks.previous(got, ["k"], "t", {"b": F.col("i")}, rows)
    got = blocks.row_numbers(got, ["k"], "t", "n", rows)
    at, total = {}, {}
    rowsof = {r["i"]: r for r in got.collect()}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        k = r["k"]
        total[k] = total.get(k, 0) + r["w"]
        seen = at.get(k, [])
        g = rowsof[r["i"]]
        assert (g["s"], g["b"], g["n"]) == (total[k], seen[-1] if seen else None, len(seen))
        at[k] = [*seen, r["i"]]


@pytest.mark.parametrize("rows", [7, 10_000])
def test_margins_hold_what_a_window_needs(spark, rows):
    df = bursts(spark, 120)
    out = blocks.margined(df, ["k"], "t", 5, rows)
    own = out.where("_own").collect()
    assert sorted(r["i"] for r in own) == sorted(r["i"] for r in df.collect())
    held = {}
    for r in out.collect():
        held.setdefault((r["k"], r["_block"]), set()).add(r["_place"])
    assert all(set(range(max(0, r["_place"] - 5), min(r["_size"], r["_place"] + 6))) <= held[(r["k"], r["_block"])] for r in own)


def test_cut_asof_joins(spark, rows=8):
    df = bursts(spark)
    left, right = df.where("i % 3 = 0").select("k", "t", "i"), df.where("i % 7 = 1").select("k", "t", F.col("i").alias("j"))
    for how in ({"tie": "later"}, {"direction": "forward", "clamp": True}):
        want = asof_join(left, right, "t", ["k"], order="j", **how)
        assert sorted(map(str, asof_join(left, right, "t", ["k"], order="j", rows=rows, **how).collect())) == sorted(map(str, want.collect()))
    got = {r["i"]: (r["_p"], r["_n"]) for r in bracketed(left, right, "t", ["k"], rows=rows).collect()}
    have = [(r["k"], r["t"], r["j"]) for r in right.collect() if r["k"] is not None]
    for r in left.collect():
        before, after = [x for x in have if x[0] == r["k"] and x[1] <= r["t"]], [x for x in have if x[0] == r["k"] and x[1] >= r["t"]]
        p, n = got[r["i"]]
        assert (p and p["j"]) == (max(before, key=lambda x: x[1])[2] if before else None) and (n and n["j"]) == (min(after, key=lambda x: x[1])[2] if after else None)


def test_asof_without_keys_is_cut_too(spark):
    df = bursts(spark).drop("k")
    left, right = df.where("i % 3 = 0").select("t", "i"), df.where("i % 7 = 1").select("t", F.col("i").alias("j"))
    assert sorted(map(str, asof_join(left, right, "t", [], rows=8).collect())) == sorted(map(str, asof_join(left, right, "t", []).collect()))


@pytest.mark.parametrize("most", [3, 10_000])
def test_medians_of_groups_that_are_narrowed(spark, most):
    rng = np.random.default_rng(8)
    groups = {
        "even": list(rng.normal(size=60)), "odd": list(rng.normal(size=61)), "tied": [1.0] * 50 + [2.0] * 50, "same": [4.0] * 80, "wild": list(np.exp(rng.normal(size=70) * 20)),
        "far": [1.0, 2.0, 3.0, 1e300, -1e300, float("inf"), float("-inf")] * 9, "one": [5.0], "two": [1.0, 4.0],
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("even", float("nan")), (None, 3.0), (None, 4.0)]
    got = {r["k"]: r["m"] for r in series.exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), "m", most).collect()}
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.median(v), rel=1e-12), k
    assert got[None] == 3.5
    both = series.mad_keep(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 2.0, most=most)
    assert both.count() == len(rows)
    for k in ("even", "odd", "tied", "same"):
        mad = np.median(np.abs(np.array(groups[k]) - np.median(groups[k])))
        kept = [r["v"] for r in both.where((F.col("k") == k) & F.col("keep")).collect()]
        assert sorted(kept) == sorted(x for x in groups[k] if x <= 2 * max(mad, 1e-3))


def test_turns_have_two_directions(spark):
    line = spark.createDataFrame([(1, i, 0.0, float(i)) for i in range(6)] + [(2, i, 1.0, 1.0) for i in range(4)], "rec int, i int, x double, y double")
    assert {r["turn"] for r in series.heading_change(line, ["rec"], "i", "x", "y", 2).collect()} == {0.0}
    corner = spark.createDataFrame([(1, i, float(min(i, 5)), float(max(0, i - 5))) for i in range(11)], "rec int, i int, x double, y double")
    for rows in (3, 1000):
        got = {r["i"]: round(r["turn"], 6) for r in series.heading_change(corner, ["rec"], "i", "x", "y", 2, rows=rows).collect()}
        assert got[5] == 90.0 and got[0] == got[10] == 0.0 and got[2] == 0.0


def greedy(values, least, apart):
    out, last, run = [], 0, None
    for i, v in [*list(enumerate(values))[1:], (len(values), -1.0)]:
        if v >= least:
            run = i if run is None or v > values[run] else run
        elif run is not None:
            if run - last >= apart:
                out.append(run)
                last = run
            run = None
    return out


@pytest.mark.parametrize("rows", [6, 10_000])
def test_peaks_are_taken_in_turn_from_the_first_row(spark, rows):
    spikes = lambda at, n=40: [9.0 if i in at else 0.0 for i in range(n)]
    rng = np.random.default_rng(9)
    walks = {1: spikes({2, 30}), 2: spikes({3}), 3: spikes({0, 1, 25}), 4: spikes({5, 11, 17, 23, 29, 35}), 5: [float(x) for x in rng.uniform(0, 10, 200)], 6: [0.0] * 5, 7: [9.0] * 9}
    df = spark.createDataFrame([(k, i, v) for k, vs in walks.items() for i, v in enumerate(vs)] + [(None, 0, 0.0), (None, 1, 9.0)], "rec int, i int, v double")
    for apart in (20, 5):
        got = {}
        for r in series.peaks(df, ["rec"], "i", "v", 8.0, apart, rows=rows).collect():
            got.setdefault(r["rec"], []).append(r["i"])
        for k, vs in walks.items():
            assert sorted(got.get(k, [])) == greedy(vs, 8.0, apart), (k, apart)
    assert greedy(walks[1], 8.0, 20) == [30]


def test_smoothing_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, i, 2.0 if i != 3 else None) for i in range(9)] + [(2, i, None) for i in range(3)], "rec int, i int, v double")
    got = {(r["rec"], r["i"]): r["v"] for r in series.gaussian_smooth(df, ["rec"], "i", ["v"], 1.0).collect()}
    assert all(abs(got[(1, i)] - 2.0) < 1e-12 for i in range(9)) and got[(2, 1)] is None


def crowd(spark, n=1500):
    """Nine in ten points in one cell, a third of them at one place."""
    rng = np.random.default_rng(10)
    p = np.r_[rng.uniform(0, 0.9, (n * 6 // 10, 2)), np.full((n * 3 // 10, 2), 0.25), rng.uniform(-20, 20, (n // 10, 2))]
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double"), p


def test_a_crowded_cell_is_split_and_loses_no_pair(spark):
    df, p = crowd(spark)
    few = df.where("id % 5 = 0")
    for l, r in ((df, few), (few, df)):
        got = spatial.radius_join(l, r, ["x", "y"], 1.0, crowd=40)
        a, b = p[[x["id"] for x in l.orderBy("id").select("id").collect()]], p[[x["id"] for x in r.orderBy("id").select("id").collect()]]
        want = int((((a[:, None] - b[None]) ** 2).sum(axis=2) <= 1.0).sum())
        assert got.count() == want == got.select("id", "r_id").distinct().count()
    assert spatial.radius_join(df.where("false"), df, ["x", "y"], 1.0).count() == 0


def test_no_task_of_a_crowded_join_holds_the_cell(spark):
    df, _ = crowd(spark)
    cells = df.select("*", F.floor("x").alias("_c0"), F.floor("y").alias("_c1"))
    right = df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
    right = right.select("*", F.explode(F.sequence(F.floor("r_x") - 1, F.floor("r_x") + 1)).alias("_c0")).select("*", F.explode(F.sequence(F.floor("r_y") - 1, F.floor("r_y") + 1)).alias("_c1"))
    counts = cells.groupBy("_c0", "_c1").agg(F.count("*").alias("_nl")).join(right.groupBy("_c0", "_c1").agg(F.count("*").alias("_nr")), ["_c0", "_c1"]).where("_nl > 40 or _nr > 40")
    met = spatial._crowded(cells, right, counts, ["_c0", "_c1"], ["x", "y"], 1.0, 40)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan and met.count() >= 1


def mesh(spark, tris):
    return spark.createDataFrame([(i, *map(float, np.ravel(t))) for i, t in enumerate(tris)], "fid int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))


def test_one_huge_triangle_leaves_the_small_ones_cells_small(spark):
    rng = np.random.default_rng(11)
    n = 20_000
    base = np.c_[rng.uniform(0, 200, (n, 2)), rng.uniform(0, 1, n)]
    small = base[:, None, :] + rng.uniform(0, 0.8, (n, 3, 3)) * [1, 1, 0.1]
    huge = np.array([[[-1e4, -1e4, -1.0], [1e4, -1e4, -1.0], [0.0, 2e4, -1.0]]])
    tris = mesh(spark, np.r_[small, huge])
    rays = spark.createDataFrame([(i, float(rng.uniform(0, 200)), float(rng.uniform(0, 200)), 5.0, float(rng.normal() * 0.2), float(rng.normal() * 0.2), -1.0) for i in range(300)], "rid int, ox double, oy double, oz double, dx double, dy double, dz double")
    levelled = spatial.size_levels(tris)
    assert levelled.where("fid < 20000").agg(F.max("_level")).first()[0] <= 0 and levelled.where("fid = 20000").first()["_level"] == 15
    levels = levelled.withColumns({"_z0": F.least("z0", "z1", "z2"), "_z1": F.greatest("z0", "z1", "z2")}).groupBy("_level").agg(
        *[F.min(f"_{c}0").alias(f"_b{c}0") for c in "xyz"], *[F.max(f"_{c}1").alias(f"_b{c}1") for c in "xyz"]
    )
    assert spatial._walk(rays, levels).count() < 300 * 30
    got = {r["rid"]: r for r in spatial.mesh_hits(rays, tris).collect()}
    assert len(got) == 300
    corners = np.r_[small, huge]
    for r in rays.limit(40).collect():
        o, d = np.array([r["ox"], r["oy"], r["oz"]]), np.array([r["dx"], r["dy"], r["dz"]])
        a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
        p = np.cross(d, c - a)
        det = ((b - a) * p).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((o - a) * p).sum(axis=1) / det
            q = np.cross(o - a, b - a)
            v, t = (q @ d) / det, ((c - a) * q).sum(axis=1) / det
        hit = (np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-9)
        assert got[r["rid"]]["n_hits"] == hit.sum() and abs(got[r["rid"]]["t"] - t[hit].min()) < 1e-9


def test_rays_along_axes_borders_and_corners(spark):
    tris = mesh(spark, [[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 1, 0], [1, 0, 0], [0, 1, 0]], [[4, 4, 4], [4, 4, 4], [4, 4, 4]], [[2, 0, -1], [2, 2, -1], [2, 0, 3]]])
    rows = [(1, 0.5, 0.25, 2.0, 0.0, 0.0, -1.0), (2, -3.0, 1.0, 0.5, 1.0, 0.0, 0.0), (3, 1.0, 0.0, 1.0, 0.0, 0.0, -1.0), (4, 9.0, 9.0, 9.0, 1.0, 1.0, 1.0), (5, 2.0, 5.0, 0.0, 0.0, -1.0, 0.0), (6, None, 1.0, 1.0, 0.0, 0.0, -1.0)]
    rays = spark.createDataFrame(rows, "rid int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["rid"]: (round(r["t"], 9), r["n_hits"]) for r in spatial.mesh_hits(rays, tris).collect()}
    assert got[1] == (2.0, 1) and got[2] == (5.0, 1) and got[3][0] == 1.0 and set(got) == {1, 2, 3}


def cloud(spark, points, name="pid"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"{name} long, x double, y double, z double")


def test_normals_of_a_plane_and_a_sphere(spark):
    rng = np.random.default_rng(12)
    flat = np.c_[rng.uniform(0, 4, (300, 2)), np.zeros(300)] + [1e6, 1e6, 50.0]
    got = clouds.cloud_normals(cloud(spark, flat), 0.8)
    assert all(abs(abs(r["nz"]) - 1) < 1e-6 for r in got.collect())
    lone = {r["pid"]: r for r in clouds.cloud_normals(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0)], "pid long, x double, y double, z double"), 1.0).collect()}
    assert (lone[1]["nx"], lone[1]["nz"], lone[1]["least"], lone[2]["nz"]) == (0.0, 1.0, None, None)
    k = np.arange(400) + 0.5
    lat, lon = np.arccos(1 - 2 * k / 400), np.pi * (1 + 5**0.5) * k
    ball = np.c_[np.cos(lon) * np.sin(lat), np.sin(lon) * np.sin(lat), np.cos(lat)]
    turned = clouds.oriented(clouds.cloud_normals(cloud(spark, np.r_[ball, ball + [5, 0, 0]]), 0.35, most=12), 0.35)
    for r in turned.collect():
        middle = np.array([0.0 if r["pid"] < 400 else 5.0, 0, 0])
        out = (np.array([r["x"], r["y"], r["z"]]) - middle) @ np.array([r["nx"], r["ny"], r["nz"]])
        assert out > 0.97


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_uneven_clouds(spark, k):
    rng = np.random.default_rng(15)
    goal = np.r_[rng.normal(0, 0.02, (300, 3)), rng.uniform(-3, 3, (60, 3)), np.full((9, 3), 0.5)]
    own = np.r_[rng.normal(0, 0.02, (40, 3)), rng.uniform(-4, 4, (60, 3)), [[0.5, 0.5, 0.5]]]
    left, right = cloud(spark, own), cloud(spark, goal, "tid")
    got = {}
    for r in spatial.nearest_join(left, right, ["x", "y", "z"], 1.0, "pid", "tid", k).collect():
        got.setdefault(r["pid"], []).append((round(r["distance"], 12), r["r_tid"]))
    d = np.sqrt(((own[:, None] - goal[None]) ** 2).sum(axis=2))
    for i in range(len(own)):
        want = sorted((round(float(x), 12), j) for j, x in enumerate(d[i]) if x <= 1.0)[:k]
        assert sorted(got.get(i, [])) == want
    assert spatial.nearest_join(left, right.where("false"), ["x", "y", "z"], 1.0, "pid", "tid", k).count() == 0


def test_planes_let_points_slide(spark):
    """A corner of three planes, seen by points shifted along them: point to plane ends there, point to point drags."""
    rng = np.random.default_rng(13)
    side = lambda a, b, c, n: np.c_[rng.uniform(0, 4, (n, 2)), np.zeros(n)][:, [a, b, c]]
    goal = np.r_[side(0, 1, 2, 500), side(0, 2, 1, 500), side(2, 0, 1, 500)]
    normals = np.r_[np.tile([0, 0, 1.0], (500, 1)), np.tile([0, 1.0, 0], (500, 1)), np.tile([1.0, 0, 0], (500, 1))]
    own = np.r_[side(0, 1, 2, 150), side(0, 2, 1, 150), side(2, 0, 1, 150)] * 0.8 + 0.3 * (np.r_[side(0, 1, 2, 150), side(0, 2, 1, 150), side(2, 0, 1, 150)] > 0)
    w = np.array([0.01, -0.02, 0.015])
    r0, t0 = clouds.turn_of(w), np.array([0.05, -0.04, 0.06])
    moved = (own - t0) @ r0  # what r0 and t0 bring onto the planes
    target = spark.createDataFrame([(i, *map(float, p), *map(float, n)) for i, (p, n) in enumerate(zip(goal, normals, strict=True))], "tid long, x double, y double, z double, nx double, ny double, nz double")
    r, t, log = clouds.match_planes(cloud(spark, moved), target, 0.6, rounds=8)
    assert np.allclose(r, r0, atol=1e-4) and np.allclose(t, t0, atol=1e-3) and log[-1]["rms"] < 1e-3 < log[0]["rms"]
    src = cloud(spark, moved).select("pid", *[F.col(a).alias(b) for a, b in zip("xyz", fits.S, strict=True)])
    dst = target.select(*[F.col(a).alias(b) for a, b in zip("xyz", fits.D, strict=True)])
    pr, pt = fits.match_points(src, dst, 0.6, rounds=4)
    miss = lambda r, t: np.linalg.norm(moved @ np.asarray(r).T + t - own, axis=1).mean()
    assert miss(r, t) < miss(pr, pt) / 5


def test_a_single_plane_holds_only_what_it_can(spark):
    rng = np.random.default_rng(14)
    target = spark.createDataFrame([(i, float(x), float(y), 0.0, 0.0, 0.0, 1.0) for i, (x, y) in enumerate(rng.uniform(0, 3, (400, 2)))], "tid long, x double, y double, z double, nx double, ny double, nz double")
    src = cloud(spark, np.c_[rng.uniform(0.5, 2.5, (100, 2)), np.full(100, 0.2)])
    r, t, log = clouds.match_planes(src, target, 0.8, rounds=5)
    assert np.allclose(t, [0, 0, -0.2], atol=1e-9) and np.allclose(r, np.eye(3), atol=1e-9) and log[0]["condition"] > 1e9
    assert clouds.match_planes(src, target, 0.01, rounds=5)[2] == []


def test_last_position_of_a_name_counts(spark):
    from poseframe.plans.alignment import head_pairs

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    steps = frame([(1, 0, 0, 2, 0.0)], "rec int, step_idx int, frame_start int, frame_end int, median_hit_z double")
    detected = frame([(1, 1, 1.0, 2.0, 3.0)], "rec int, frame int, Head_x double, Head_y double, Head_z double")
    aligned = frame([(1, 1, 7)], "rec int, frame int, dji_frame int")
    matches = frame([(7, "a", 0), (7, "b", 1)], "dji_frame int, aria_frame string, nth int")
    positions = frame([("b", 0, 9.0, 9.0, 9.0), ("b", 1, 4.0, 4.0, 4.0), ("a", 2, 1.0, 1.0, 1.0)], "frame_name string, nth int, x double, y double, z double")
    got = head_pairs(steps, detected, aligned, matches, positions, np.eye(4).tolist(), ["rec"]).collect()
    assert [r["hdx"] for r in got] == [4.0]
    assert T.BooleanType() == head_pairs(steps, detected, aligned, matches, positions, np.eye(4).tolist(), ["rec"]).schema["valid"].dataType


def _crowd_of_rays(spark):
    rng = np.random.default_rng(5)
    n = 60
    ray = np.column_stack([rng.integers(-2, 3, (n, 2)) + rng.choice([0.0, 0.25], (n, 2)), np.full(n, 5.0), rng.choice([-0.5, 0.0, 0.25], (n, 2)), np.full(n, -1.0)])
    at = rng.integers(-2, 3, (n, 3)) / 1.0
    tri = np.hstack([at, at + rng.choice([0.0, 1.0, -2.0, 0.5], (n, 3)), at + rng.choice([0.0, 1.0, -1.0, 0.25], (n, 3))])
    rays = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ray)], "rid int, ox double, oy double, oz double, dx double, dy double, dz double")
    tris = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(tri)], "fid int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    k, i = np.divmod(np.arange(n * n), n)
    t = casting.exact_distances(ray[k, :3].T, ray[k, 3:].T, tri[i, :3].T, tri[i, 3:6].T, tri[i, 6:].T).reshape(n, n)
    return rays, tris, t


def test_crowded_rays_and_triangles_meet_in_arrays_and_count_once(spark):
    rays, tris, t = _crowd_of_rays(spark)
    want = {i: (row.min(), int(np.isfinite(row).sum())) for i, row in enumerate(t) if np.isfinite(row).any()}
    for pairs, lot in ((0, 7), (20, 1000), (10**9, 10)):
        got = spatial.mesh_hits(rays.withColumn("rid", F.struct("rid")), tris, pairs=pairs, lot=lot)
        plan = got._jdf.queryExecution().toString()
        assert "fid" not in plan[plan.index("Aggregate") :].split("\n")[0], "no row for a pair is shuffled"
        assert {r["rid"]["rid"]: (r["t"], r["n_hits"]) for r in got.collect()} == want
    assert sum(c for _, c in want.values()) > 50


def test_crowded_candidates_of_rays_are_those_of_plain_ones(spark):
    rays, tris, _ = _crowd_of_rays(spark)
    mesh = tris.withColumns({f"c{x}": (F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3 for x in "xyz"})
    mesh = mesh.withColumn("nz", F.when(F.col("fid") % 7 != 0, (F.col("fid") % 10 - 5) / 5.0))
    mesh = mesh.withColumn("z2", F.when(F.col("fid") % 13 != 0, F.col("z2")))
    rows = lambda **how: sorted(map(tuple, spatial.ray_hits(rays, mesh, zlo=-3.0, zhi=3.0, **how).fillna(-99.0).fillna(False).collect()))
    plain = rows(pairs=10**9)
    assert rows(pairs=0, lot=9) == rows(pairs=0) == plain
    assert sum(r[4] for r in plain) > 200 and sum(r[5] for r in plain) > 10


def _cloud_of_triangles(m, n, seed=7):
    """Triangles (some without extent, some at one place, of three kinds) and rays that go down, up, level and straight, with their samples."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.5, (m + 2, 3))
    tri = np.hstack([v[:-2], v[1:-1], v[2:]])
    tri[::50, 3:6] = tri[::50, :3]
    tri[::40] = tri[0]
    ray = np.hstack([rng.normal(0, 0.5, (n, 2)), np.full((n, 1), 6.0), rng.uniform(-0.4, 0.4, (n, 2)), np.full((n, 1), -1.0)])
    ray[::7, 2], ray[::7, 5] = -5.0, 0.9
    ray[1::11, 3:5] = 0.0
    ray[2::13, 2], ray[2::13, 5] = 0.1, 0.0
    lo, step = np.where(ray[:, 5] == 0, 0.0, 3.5), np.where(ray[:, 5] == 0, 0.4, 5 / 19)
    return ray, lo, step, tri, rng.choice([-1.0, 0.0, 1.0], m, p=[0.05, 0.25, 0.7])


def test_counts_by_squares_and_first_hits_by_fronts_are_those_of_all_pairs():
    for m, n in ((1, 50), (40, 200), (6000, 300)):
        ray, lo, step, tri, kinds = _cloud_of_triangles(m, n)
        centres = (tri[:, :2] + tri[:, 3:5] + tri[:, 6:8]) / 3
        with np.errstate(all="ignore"):
            places = casting.Places(centres, 0.5)
            count = places.counts(ray, lo, step, 20)
            kind, best = casting.first_hits(places, ray, lo, step, 20, tri[places.order], kinds[places.order])
            i, k = np.divmod(np.arange(n * m), m)
            near = casting._near_exact(ray[i], lo[i], step[i], centres[k], 0.5, 20)
            t = np.where(near, casting.exact_distances(ray[i, :3].T, ray[i, 3:].T, tri[k, :3].T, tri[k, 3:6].T, tri[k, 6:].T), np.inf).reshape(n, m)
        assert (count == near.reshape(n, m).sum(1)).all()
        least = np.where(np.isfinite(t), kinds, np.inf).min(1)
        assert (kind == least).all() and (best == np.where(kinds == least[:, None], t, np.inf).min(1)).all()
    assert np.isfinite(best).sum() > 100 and count.max() > 1000 and set(kind[np.isfinite(kind)]) == {-1.0, 0.0, 1.0}


def test_a_ray_looks_at_few_of_many_triangles(monkeypatch):
    seen = {}

    def watch(owner, name, much):
        plain = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a: (seen.__setitem__(name, seen.get(name, 0) + much(*a)), plain(*a))[1])

    watch(casting.Triangles, "hits", lambda mesh, rays, *_: len(rays) * mesh.det.shape[1])
    watch(casting.Places, "_of_leaves", lambda p, rays, lo, step, n, lines, level, i, node, *_: int(level["n"][node].sum()))
    watch(casting.Lines, "away", lambda lines, i, px, py: np.size(px))
    looked = []
    for m in (5000, 80_000):
        rng = np.random.default_rng(2)
        v = rng.normal(0, 0.5, (m + 2, 3))
        tri = np.hstack([v[:-2], v[1:-1], v[2:]])
        ray = np.hstack([rng.normal(0, 0.2, (400, 2)), np.full((400, 1), 6.0), rng.uniform(-0.05, 0.05, (400, 2)), np.full((400, 1), -1.0)])
        seen.clear()
        with np.errstate(all="ignore"):
            places = casting.Places((tri[:, :2] + tri[:, 3:5] + tri[:, 6:8]) / 3, 0.5)
            count = places.counts(ray, np.full(400, 3.5), np.full(400, 5 / 19), 20)
            casting.first_hits(places, ray, np.full(400, 3.5), np.full(400, 5 / 19), 20, tri[places.order], np.zeros(m))
        looked.append(sum(seen.values()) / 400)
        assert count.mean() > 0.4 * m
    assert looked[1] < 0.2 * 80_000 and looked[1] < 6 * looked[0], "not sixteen times as many"


def test_hits_without_their_number_are_those_with_it(spark):
    rays, tris, _ = _crowd_of_rays(spark)
    mesh = tris.withColumns({f"c{x}": (F.col(f"{x}0") + F.col(f"{x}1") + F.col(f"{x}2")) / 3 for x in "xyz"})
    mesh = mesh.withColumn("nz", F.when(F.col("fid") % 7 != 0, (F.col("fid") % 10 - 5) / 5.0))
    mesh = mesh.withColumn("z2", F.when(F.col("fid") % 13 != 0, F.col("z2")))
    rows = lambda **how: sorted(map(tuple, spatial.ray_hits(rays, mesh, zlo=-3.0, zhi=3.0, **how).drop("n_hits").fillna(-99.0).fillna(False).collect()))
    plain = rows(pairs=10**9)
    assert rows(hits=False, pairs=0, lot=9, room=7) == rows(hits=False, pairs=0) == rows(hits=False) == plain
    assert "n_hits" not in spatial.ray_hits(rays, mesh, hits=False).columns and sum(r[4] for r in plain) > 200


def test_steps_of_contacts_through_trees_are_those_of_pairs(spark, monkeypatch):
    from poseframe.plans import contact_catalog, contacts

    rows = lambda: sorted(map(tuple, contact_catalog.contact_steps(spark, "/root/testdata/sf0.001").fillna(-99.0).collect()))
    plain, asked = rows(), []

    def crowded(*a, **how):
        asked.append(how["hits"])
        return spatial.ray_hits(*a, **how, pairs=0, lot=50, room=100)

    monkeypatch.setattr(contacts, "ray_hits", crowded)
    assert rows() == plain and len(plain) > 100 and asked == [False], "the number of hits isn't used, so not all are looked for"


def test_a_ray_is_in_each_cell_around_its_samples_once(spark):
    ray, *_ = _cloud_of_triangles(1, 120)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ray)], "rid int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = [(r["rid"], r["_cx"], r["_cy"]) for r in spatial._sample_cells(df, 0.5, -2.0, 2.0, 20).collect()]
    spans = {r["rid"]: (r["_lo"], r["_hi"]) for r in spatial.slab_spans(df, -2.0, 2.0).collect()}
    want = set()
    for i, (lo, hi) in spans.items():
        t = lo + (hi - lo) / 19 * np.arange(20)
        at = np.floor(np.stack([ray[i, 0] + ray[i, 3] * t, ray[i, 1] + ray[i, 4] * t], 1) / 0.5).astype(int)
        want |= {(i, x + a, y + b) for x, y in at.tolist() for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert len(got) == len(set(got)) and set(got) == want


def test_short_floats_lose_no_hit_far_from_the_origin():
    rng = np.random.default_rng(3)
    far = np.array([5e5, -4e6, 300.0])
    tri = np.hstack([far + rng.normal(0, 1, (300, 3)) for _ in range(3)])
    ray = np.hstack([far + rng.normal(0, 40, (200, 3)), np.zeros((200, 3))])
    ray[:, 3:] = far + rng.normal(0, 0.5, (200, 3)) - ray[:, :3]
    i, k = np.divmod(np.arange(200 * 300), 300)
    t = casting.exact_distances(ray[i, :3].T, ray[i, 3:].T, tri[k, :3].T, tri[k, 3:6].T, tri[k, 6:].T)
    a, b, c = casting.Triangles(tri).hits(ray)
    assert set(zip(a, b, c, strict=True)) == {(x, y, z) for x, y, z in zip(i, k, t, strict=True) if z < np.inf} and len(a) > 500


def test_few_rows_allowed_in_a_cell_make_no_flood_of_copies(spark):
    p = np.random.default_rng(8).normal(0, 0.1, (400, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double")
    want = int((((p[:, None] - p[None]) ** 2).sum(2) <= 0.01).sum())
    assert spatial.COPIES >= 125 and spatial.radius_join(df, df, ["x", "y"], 0.1, crowd=3).count() == want
    assert spatial.radius_join(df, df, ["x", "y"], 0.1, crowd=3, least=3).count() == want  # in lots of three rows


@pytest.mark.parametrize("second", [False, True])
@pytest.mark.parametrize("rows", [9, 10_000])
def test_windows_meet_their_pairs_in_one_shuffle(spark, monkeypatch, rows, second):
    kept = []
    for m in (fits, blocks):
        monkeypatch.setattr(m, "stored", lambda df, name, real=m.stored: kept.append(name) or real(df, name))
    rng = np.random.default_rng(5)
    src, dst = rng.normal(size=(80, 3)), rng.normal(size=(80, 3))
    ok, has, width = rng.random(80) < 0.7, rng.random(80) < 0.4, rng.choice([2, 5, 14, 30], 80)
    none = [None] * 3
    data = [(1, i, int(width[i]), *(src[i].tolist() if ok[i] else none), *dst[i].tolist(), *((dst[i].tolist() + src[i].tolist()) if has[i] else none * 2)) for i in range(80)]
    df = spark.createDataFrame(data, "k int, step int, w int, " + ", ".join(f"{c} double" for c in (*fits.S, *fits.D, *fits.HS, *fits.HD)))
    out = fits.windowed_fit(df, ["k"], "step", F.col("w"), second=second, rows=rows, pairs="pairs")
    got = {r["step"]: r for r in out.collect()}
    bounds = {r["step"]: (r["lo"], r["hi"]) for r in fits.window_bounds(df, ["k"], "step", F.col("w"), rows=rows).collect()}
    places = np.flatnonzero(ok)
    assert len(got) == 80
    for i in range(80):
        lo, hi = bounds[i]
        at = [(src[j], dst[j]) for j in places[lo:hi]]
        if second:
            at += [(dst[j], src[j]) for j in range(places[lo], places[hi - 1] + 1) if has[j]]
        assert got[i]["pairs"] == len(at)
        if len(at) >= 3:
            a, b = (np.array(x) for x in zip(*at, strict=True))
            u, _, vt = np.linalg.svd((b - b.mean(0)).T @ (a - a.mean(0)))
            r = (u * [1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))]) @ vt
            assert np.allclose(np.reshape(got[i]["r"], (3, 3)), r, atol=1e-6) and np.allclose(got[i]["t"], b.mean(0) - r @ a.mean(0), atol=1e-6)
    assert kept.count("windows") == 0 and kept.count("blocks") <= 2  # one for the fits, one for window_bounds() here
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") <= 1


def test_distances_of_many_pairs_are_rounded_as_in_sql(spark, sf):
    import duckdb

    from poseframe import catalog
    from poseframe.plans import scale_catalog

    # decimal ties, of which some lie below the half once multiplied
    values = [(2 * i + 1) / 2e6 for i in range(0, 400_000, 37)] + [0.0, 1e-7, 4.999e-7, 0.05]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(catalog.r6_many(F.col("v")).alias("x")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    # a decimal text for each pair took most of the join's time
    for q in (catalog.radius_2d, scale_catalog.radius_crowded):
        assert "round(" not in q(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
