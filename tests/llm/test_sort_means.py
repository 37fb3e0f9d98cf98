"""Sort-means against a plain clustering that looks at every centroid."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poseframe.llm.sort_means import clustered, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3, size=64):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e, _ in rows if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for i in range(rounds + 1):
        put = [min((away(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
        if i < rounds:
            for n in range(len(cents)):
                mine = [v for (_, v), (_, m) in zip(kept, put, strict=True) if m == n]
                if mine:
                    cents[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    part = {n: sum(d for d, m in put if m == n) for n in range(len(cents))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, n, d, part[n], sum(part.values()), name[n]) for (i, _), (d, n) in zip(kept, put, strict=True)], key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast("string") for c in ("v", "cluster", "distance", "place", "part", "key")})
    return sorted((tuple(r) for r in clustered(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.4, 64)], 0) for i in range(150)]
    rows += rows[:20] * 3  # repeated rows and ties
    rows += [(None, [0.5] * 64, 0), (900, None, 0), (901, [1.0] * 63, 0), (902, [1.0] * 65, 0), (903, [None] + [1.0] * 63, 0), (904, [float("nan")] * 64, 0), (905, [float("-inf")] * 64, 0), (906, [], 0)]
    assert got(spark, rows) == plain(rows)


def test_few_vectors_ties_and_none(spark):
    rows = [(i, [float(i // 2)] * 64, 0) for i in range(6)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, [1e30] * 64, 0)]) == []


def test_any_start_gives_the_smallest_nearest():
    rng = np.random.default_rng(3)
    v, cents = rng.integers(-3, 3, (500, 4)), rng.integers(-3, 3, (12, 4))
    cents[7] = cents[2]
    d = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
    for before in (np.zeros(500, np.int64), rng.integers(0, 12, 500)):
        cluster, distance = nearest(v, before, cents)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
