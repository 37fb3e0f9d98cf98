"""Lloyd's clustering with Sort-means: the triangle inequality tells where to stop looking for a nearer centroid.

Each round orders, for each centroid, the others by their distance from it. A vector starts at the centroid it was assigned to and
looks at the others in that order; once one is farther from it than twice the vector's distance, no later one can be
nearer, nor as near. All arithmetic is on integers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from poseframe.llm.common import drop_stored, stored

SIZE, CENTROIDS, ROUNDS, UNITS = 64, 16, 3, 64
#: Components are below this in size, so that a long holds any squared distance.
LIMIT = 2**27


def components_of(embeddings: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (vec_id, v): components in whole 64ths, of vectors with `size` known and finite components."""
    x = F.col("embedding")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / UNITS)
    rows = embeddings.where((F.size(x) == size) & F.forall(x, fine))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * UNITS).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids; equal ids by their components. At most k rows reach the driver."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()], np.int64)


def nearest(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of v the number of its nearest centroid (of equally near ones the smallest) and the squared distance.

    before: where each row was assigned; any start is as right, a near one is quicker.
    """
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    cluster, distance = before.copy(), np.empty(len(v), np.int64)
    for c in np.unique(before):
        at = np.flatnonzero(before == c)
        x = v[at]
        own = ((x - centroids[c]) ** 2).sum(axis=1)
        best, which = own.copy(), np.full(len(at), c)
        left = np.arange(len(at))
        for other in order[c]:
            # d(c, other) > 2 d(x, c) in squares; later centroids are farther still
            left = left[between[c, other] <= 4 * own[left]]
            if not len(left):
                break
            if other != c:
                d = ((x[left] - centroids[other]) ** 2).sum(axis=1)
                better = (d < best[left]) | ((d == best[left]) & (other < which[left]))
                best[left[better]], which[left[better]] = d[better], other
        cluster[at], distance[at] = which, best
    return cluster, distance


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, SIZE)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors (vec_id, v and, but in the first round, cluster) with cluster and distance."""
    again = "cluster" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            before = b.column(2).to_numpy().astype(np.int64) if again else np.zeros(len(v), np.int64)
            cluster, distance = nearest(v, before, centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    rows = vectors.select("vec_id", "v", *(["cluster"] if again else []))
    return rows.mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean, a cluster without vectors as it was. Tasks add up their rows; k x size sums reach the driver."""
    k, size = centroids.shape
    schema = StructType([StructField(c, LongType()) for c in ("cluster", "place", "total")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, size + 1), np.int64), 0
        for b in batches:
            v, cluster = _matrix(b.column(0)), b.column(1).to_numpy()
            n += len(v)
            for c in np.unique(cluster):
                mine = v[cluster == c]
                sums[c] += np.r_[mine.sum(axis=0), len(mine)]
        if n:
            at = np.indices(sums.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at[0], at[1], sums.ravel())], ["cluster", "place", "total"])

    parts = rows.select("v", "cluster").mapInArrow(run, schema)
    out = centroids.copy()
    total: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
        total.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
    for c, sums in total.items():
        if sums[size]:
            out[c] = [sums[i] // sums[size] for i in range(size)]
    return out


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Left out are vectors of another length, with a null or non-finite component, or with one of 2**21 or more in size, whose
    squared distances a long can't hold. Repeated vectors are so many rows. Fewer than k vectors make fewer centroids. A null vec_id
    is hashed as an empty text. Other columns are ignored; an empty table gives an empty result. The table is written once a
    round with its clusters, so that the next round starts from them.
    """
    rows = stored(components_of(embeddings, size), "means-vectors")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)
    for i in range(rounds + 1):
        new = stored(assigned(rows, centroids), "means-round")
        drop_stored(rows)
        rows = new
        if i < rounds:
            centroids = means(rows, centroids)
    names = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("part"))
    whole = per.agg(F.sum("part").alias("whole"))
    per = per.join(rows.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster").crossJoin(whole)  # one row
    fit = lambda c: F.expr(f"try_cast({c} as long)")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", fit("part").alias("cluster_inertia"), fit("whole").alias("inertia"), "centroid_sha256")


def _sql() -> str:
    near = """, d{i} AS (SELECT n, c, sum((x - y) * (x - y)) AS d FROM (SELECT n, c, unnest(v) AS x, unnest(w) AS y FROM e CROSS JOIN m{i}) GROUP BY n, c),
a{i} AS (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY n)"""
    step = """, m{j} AS (SELECT m{i}.c, coalesce(w2, w) AS w FROM m{i} LEFT JOIN (SELECT c, list(floor_div ORDER BY p) AS w2 FROM (
  SELECT c, p, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT a{i}.c, unnest(v) AS x, unnest(range({s})) AS p FROM a{i} JOIN e USING (n)) GROUP BY c, p) GROUP BY c) USING (c))"""
    sql = """WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {s} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 2097152)) = {s}),
m0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS c, v AS w FROM e ORDER BY c LIMIT {k})"""
    for i in range(ROUNDS + 1):
        sql += near.replace("{i}", str(i))
        if i < ROUNDS:
            sql += step.replace("{i}", str(i)).replace("{j}", str(i + 1))
    sql += """ SELECT vec_id, a{r}.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a{r}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM e JOIN a{r} USING (n) JOIN m{r} ON m{r}.c = a{r}.c"""
    return sql.replace("{s}", str(SIZE)).replace("{k}", str(CENTROIDS)).replace("{r}", str(ROUNDS))


SQL = _sql()
