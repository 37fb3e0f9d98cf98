"""What the operators of this package share: shared scratch tables, connected components, word hashes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a temporary folder; on a cluster that is an error, since executors
    would each write to their own disk.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dirs.setdefault(sc.applicationId, "")
        if not path:
            path = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like stored(), in as many buckets of `key` as a shuffle has partitions: joins on the key don't move this table."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).saveAsTable(name)
    back = spark.table(name)
    back.stored_at, back.stored_as = path, name
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that stored() or bucketed() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if getattr(df, "stored_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are out of use; it does so when the driver collects garbage."""
    for _ in range(2):  # the first lets go of what Python holds, the second of what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp the smallest node of the component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are stars: each node has one edge to a
    smaller one, which itself has none. No step gathers a group in memory: each is a minimum per node and a join back. Nodes
    without edges are not returned. The result is stored.
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(new, "cc")
        drop_stored(e)
        e = new
        ends = e.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = stored(out.union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "cc")
    drop_stored(e)
    return out


#: Space, tab, line feed, vertical tab, form feed, return: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORDS = r"[^\x20\x09-\x0D]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240601)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (np.uint64(_BASE), np.uint64(_INV))]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and where each row starts; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - (offs[0] if len(offs) else 0)


def word_hashes(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE, head: int = 0, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, and the row of each word.

    With head, the hash of only the first `head` bytes of a word. Works on about `piece` bytes at a time, cut at a byte
    of `space`, so that memory does not follow the length of a text.
    """
    hashes, rows, lo, n = [], [], 0, len(data)
    heads = offs[:-1]
    while lo < n:
        hi = min(n, lo + piece)
        while hi < n:
            gap = np.flatnonzero(space[data[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
                break
            hi = min(n, hi + piece)
        part = LOWER[data[lo:hi]]
        solid = ~space[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)] - lo] = True
        before = np.r_[False, solid[:-1]]
        starts = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.r_[solid[1:], False]
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
        if head:
            ends = np.minimum(ends, starts + head)
        up, down = _power_tables(len(part) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)])]
        hashes.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        rows.append(np.searchsorted(offs, starts + lo, side="right") - 1)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about `most` bytes of the column `text`, a row at least; an empty batch as it is."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        if not b.num_rows:
            yield b


_K = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(arr: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles of `width` words; see set_of_texts()."""
    data, offs = utf8(arr)
    words, rows = word_hashes(data, offs)
    at = np.searchsorted(rows, np.arange(len(offs)))
    grams = words[: max(0, len(words) - width + 1)].copy()
    for j in range(1, width):
        grams = grams * _K + words[j : len(words) - width + 1 + j]
    grams = mix64(grams)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            h = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    h = h * _K + w
            yield mix64(np.array([h ^ _K]))
        else:
            yield words[:0]
