"""Point clouds: normals from neighbourhoods, one side for all of them, and point-to-plane matching.

Neighbours meet by a radius join on cells; what is learnt of a neighbourhood or of a whole cloud are sums. Only the
decomposition of 3 x 3 matrices runs in NumPy, over Arrow batches, and one 6 x 6 system a round on the driver.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseframe.functions.scratch import drop_stored, stored
from poseframe.operators.spatial import nearest_join, radius_join

XYZ = ("x", "y", "z")
#: Products of two coordinates, each pair once.
SQUARES = [f"{a}{b}" for a, b in combinations_with_replacement(XYZ, 2)]
#: The unknowns of a small motion: three turns and three shifts.
MOTION = [*(f"w{c}" for c in XYZ), *(f"t{c}" for c in XYZ)]
NORMAL_SUMS = [*(f"{a}_{b}" for a, b in combinations_with_replacement(MOTION, 2)), *(f"{a}_e" for a in MOTION)]


def neighbour_sums(cloud: DataFrame, radius: float, most: int | None = 30) -> DataFrame:
    """Per point (pid, x, y, z): n neighbours within the radius, itself included, their mean offset ox.. oz and covariance xx .. zz.

    most: only that many of the nearest count, equally near ones by pid; None: all. Offsets are from the point itself, so that
    coordinates far from the origin keep their digits.
    """
    p = cloud.select("pid", *[F.col(c).cast("double").alias(c) for c in XYZ])
    met = radius_join(p, p, list(XYZ), radius) if most is None else nearest_join(p, p, list(XYZ), radius, "pid", "pid", most)
    off = {c: F.col(f"r_{c}") - F.col(c) for c in XYZ}
    sums = met.groupBy("pid").agg(F.count("*").alias("n"), *[F.avg(off[c]).alias(f"o{c}") for c in XYZ], *[F.avg(off[a] * off[b]).alias(f"{a}{b}") for a, b in SQUARES])
    return sums.withColumns({f"{a}{b}": F.col(f"{a}{b}") - F.col(f"o{a}") * F.col(f"o{b}") for a, b in SQUARES})


def cloud_normals(cloud: DataFrame, radius: float, most: int | None = 30) -> DataFrame:
    """cloud (pid, x, y, z and more) with nx, ny, nz, least and n: the direction in which a neighbourhood spreads least, and how much.

    Each normal is a line's direction only; its side is settled by oriented(). Under three neighbours the normal is (0, 0, 1) and
    least is null. A point without a coordinate has nulls.
    """

    def run(batches):
        for pdf in batches:
            c = pdf[SQUARES].to_numpy(float)
            m = np.empty((len(c), 3, 3))
            for k, (i, j) in enumerate(combinations_with_replacement(range(3), 2)):
                m[:, i, j] = m[:, j, i] = c[:, k]
            values, vectors = np.linalg.eigh(m)
            few = pdf["n"].to_numpy() < 3
            normal = np.where(few[:, None], [0.0, 0.0, 1.0], vectors[:, :, 0])
            yield pd.DataFrame({"_pid": pdf["pid"], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "least": pd.array(np.where(few, np.nan, values[:, 0]), "Float64"), "n": pdf["n"]})

    sums = neighbour_sums(cloud, radius, most)
    kind = sums.schema["pid"].dataType.simpleString()
    found = sums.mapInPandas(run, f"_pid {kind}, nx double, ny double, nz double, least double, n long").withColumn("least", F.nanvl("least", F.lit(None).cast("double")))
    return cloud.join(found, F.col("pid") == F.col("_pid"), "left").drop("_pid")


def oriented(cloud: DataFrame, radius: float, most: int = 30) -> DataFrame:
    """cloud (pid, x .. z, nx .. nz) with all normals of a connected part on one side.

    The nearest points within the radius, `most` of them, are neighbours. Along the spanning tree whose neighbours' normals are most alike, a normal is turned where
    it points against the one before (Hoppe et al. 1992); each part is turned so that its highest point's normal points up.
    The tree is grown by Boruvka's rounds: every part takes its best link to another one, chains of parts are shortened by doubling
    pointers, and turns are carried along as signs; so a round is a few joins and the number of rounds is logarithmic.
    """
    p = cloud.where(" and ".join(f"{c} is not null" for c in (*XYZ, "nx", "ny", "nz"))).select("pid", *XYZ, "nx", "ny", "nz")
    met = nearest_join(p, p, list(XYZ), radius, "pid", "pid", most + 1).where("pid != r_pid")
    along = F.col("nx") * F.col("r_nx") + F.col("ny") * F.col("r_ny") + F.col("nz") * F.col("r_nz")
    ends = met.select(F.least("pid", "r_pid").alias("a"), F.greatest("pid", "r_pid").alias("b"), (1 - F.abs(along)).alias("cost"), F.when(along < 0, -1).otherwise(1).alias("sign"))
    links = stored(ends.dropDuplicates(["a", "b"]), "links")
    part = stored(p.select(F.col("pid").alias("node"), F.col("pid").alias("part"), F.lit(1).alias("turn")), "parts")
    while True:
        at = lambda n: part.select(F.col("node").alias(n), F.col("part").alias(f"p{n}"), F.col("turn").alias(f"s{n}"))  # noqa: B023, E731
        between = links.join(at("a"), "a").join(at("b"), "b").where("pa != pb")
        between = stored(between.select("a", "b", "cost", "sign", "pa", "pb", (F.col("sign") * F.col("sa") * F.col("sb")).alias("turn")), "links")
        if between.isEmpty():
            drop_stored(between)
            break
        drop_stored(links)
        links = between.select("a", "b", "cost", "sign")
        links.stored_at = between.stored_at
        out = F.struct("cost", "a", "b")  # the order of all links is the same from either side, so no rings but of two
        ends = between.select(F.col("pa").alias("part"), F.col("pb").alias("to"), "turn", out.alias("by")).unionByName(between.select(F.col("pb").alias("part"), F.col("pa").alias("to"), "turn", out.alias("by")))
        best = stored(ends.groupBy("part").agg(F.min_by(F.struct("to", "turn"), "by").alias("m")).select("part", "m.*"), "hooks")
        back = best.select(F.col("part").alias("to"), F.col("to").alias("_to"))
        mutual = best.join(back, "to").where("part = _to and part < to").select("part")
        hooks = stored(best.join(mutual, "part", "left_anti"), "hooks")
        drop_stored(best)
        while True:  # pointers to the part of all parts in a chain
            ahead = hooks.select(F.col("part").alias("to"), F.col("to").alias("_to"), F.col("turn").alias("_turn"))
            further = hooks.join(ahead, "to", "left")
            moved = stored(further.select("part", F.coalesce("_to", "to").alias("to"), (F.col("turn") * F.coalesce("_turn", F.lit(1))).alias("turn"), F.col("_to").isNotNull().alias("went")), "hooks")
            drop_stored(hooks)
            done = moved.where("went").isEmpty()
            hooks = moved.drop("went")
            hooks.stored_at = moved.stored_at
            if done:
                break
        grown = part.join(hooks.select("part", F.col("to").alias("_to"), F.col("turn").alias("_turn")), "part", "left")
        grown = stored(grown.select("node", F.coalesce("_to", "part").alias("part"), (F.col("turn") * F.coalesce("_turn", F.lit(1))).alias("turn")), "parts")
        drop_stored(part, hooks)
        part = grown
    placed = p.join(part, F.col("pid") == F.col("node"))
    up = F.when(F.col("nz") * F.col("turn") < 0, -1).otherwise(1)
    tops = placed.groupBy("part").agg(F.max_by(up, F.struct("z", "x", "y", "pid")).alias("up"))
    signs = stored(placed.join(tops, "part").select(F.col("pid").alias("_pid"), (F.col("turn") * F.col("up")).alias("_sign")), "signs")
    drop_stored(links, part)
    return cloud.join(signs, F.col("pid") == F.col("_pid"), "left").withColumns({c: F.col(c) * F.col("_sign") for c in ("nx", "ny", "nz")}).drop("_pid", "_sign")


def nearest_planes(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """Per row of source (pid, px, py, pz) within reach of target (tid, x .. z, nx .. nz): the nearest one's qx .. qz and nx .. nz; ties by tid."""
    goal = target.where("nx is not null").select("tid", *[F.col(c).cast("double").alias(f"p{c}") for c in XYZ], "nx", "ny", "nz")
    met = nearest_join(source.select("pid", "px", "py", "pz"), goal, ["px", "py", "pz"], reach, "pid", "tid")
    return met.select("pid", "px", "py", "pz", *[F.col(f"r_p{c}").alias(f"q{c}") for c in XYZ], *[F.col(f"r_n{c}").alias(f"n{c}") for c in XYZ])


def plane_terms(about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, Column]:
    """Of rows of nearest_planes(): what a small turn about a point and a small shift do to the distance e from the plane, and e."""
    n = [F.col(f"n{c}") for c in XYZ]
    r = [F.col(f"p{c}") - F.lit(float(o)) for c, o in zip(XYZ, about, strict=True)]
    e = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * F.col(f"n{c}") for c in XYZ[1:]), (F.col("px") - F.col("qx")) * F.col("nx"))
    turn = [r[1] * n[2] - r[2] * n[1], r[2] * n[0] - r[0] * n[2], r[0] * n[1] - r[1] * n[0]]
    return dict(zip(MOTION, [*turn, *n], strict=True)) | {"e": e}


def plane_sums(pairs: DataFrame, about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """One row: n, the 27 sums of the least-squares system of one point-to-plane step, and e_e."""
    t = plane_terms(about)
    product = lambda name: t[name.rsplit("_", 1)[0]] * t[name.rsplit("_", 1)[1]]
    return pairs.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(product(name)), F.lit(0.0)).alias(name) for name in [*NORMAL_SUMS, "e_e"]])


def small_motion(row: dict, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """The turn and shift that a row of plane_sums() asks for, and the system's condition.

    Directions in which the planes don't hold the points (below `least` of the strongest) are left as they are.
    """
    a, b = np.zeros((6, 6)), np.array([row[f"{m}_e"] for m in MOTION])
    for i, j in combinations_with_replacement(range(6), 2):
        a[i, j] = a[j, i] = row[f"{MOTION[i]}_{MOTION[j]}"]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))  # turns and shifts in like units
    values, vectors = np.linalg.eigh(a / size[:, None] / size[None, :])
    held = values > least * max(values[-1], 1e-300)
    x = -(vectors[:, held] @ ((vectors[:, held].T @ (b / size)) / values[held])) / size
    return x[:3], x[3:], float(values[-1] / max(values[0], 1e-300))


def turn_of(w: np.ndarray) -> np.ndarray:
    """The rotation by the length of w about w (Rodrigues)."""
    angle = float(np.linalg.norm(w))
    if angle < 1e-15:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / angle
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def match_planes(source: DataFrame, target: DataFrame, reach: float, rounds: int = 30, start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Iterated closest points, point to plane: R and t that move source (pid, x .. z) onto target (tid, x .. z, nx .. nz).

    Each round is one radius join and one aggregate; its 29 sums reach the driver. Also returned: each round's n, root mean square
    distance from the planes and condition. Ends where a round moves nothing, or fewer than 6 points have a plane in reach.
    """
    r, t = (np.eye(3), np.zeros(3)) if start is None else (np.asarray(start[0], float), np.asarray(start[1], float))
    mean = target.agg(*[F.avg(c).alias(c) for c in XYZ]).first()  # one row
    about = tuple(float(mean[c] or 0.0) for c in XYZ)
    log: list[dict] = []
    known = source.where(" and ".join(f"{c} is not null" for c in XYZ))
    for _ in range(rounds):
        moved = known.select("pid", *[sum((float(r[i, j]) * F.col(XYZ[j]) for j in range(3)), F.lit(float(t[i]))).alias(f"p{c}") for i, c in enumerate(XYZ)])
        row = plane_sums(nearest_planes(moved, target, reach), about).first().asDict()
        if row["n"] < 6:
            break
        w, shift, condition = small_motion(row)
        log.append({"n": row["n"], "rms": float(np.sqrt(max(row["e_e"], 0.0) / row["n"])), "condition": condition})
        step, o = turn_of(w), np.array(about)
        r, t = step @ r, step @ (t - o) + o + shift
        if np.abs(w).max() < 1e-10 and np.abs(shift).max() < 1e-10:
            break
    return r, t, log
