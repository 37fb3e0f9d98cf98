"""Removal of long repeated byte strings with a sparse, distributed suffix array.

A string of LENGTH bytes is given to one suffix that starts in it: at its smallest 32-byte gram by hash (the leftmost of
equals), so that equal strings choose alike and only about two suffixes in LENGTH bytes exist. A suffix serves a run of
consecutive strings; the run is cut in strips of STRIP strings by their distance to the suffix. All strings of a strip
share a core. Suffixes are ordered by fingerprints instead of by the bytes themselves, which would not fit the shuffle:
first the leading token, the fingerprint of the core, then that of all bytes that the strip covers. Sampled splitters
range-partition the suffixes by leading token, each range is sorted, and neighbours are compared:

* neighbours that agree in both are copies of each other: all strings of the strip repeat;
* neighbours that agree in the core alone may share some of their strings, which are then compared one by one, also
  sorted and compared with neighbours;
* all other strings occur once.

A leading token never spans two ranges, so no neighbours are missed at a boundary. Work is linear in the text: no pairs
of suffixes are formed, however many share a core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseframe.llm.common import _BYTE, _power_tables, drop_stored, mix64, release_shuffles, stored, utf8

LENGTH, GRAM, STRIP = 400, 32, 41
#: Strings that start in one piece of this many bytes are handled together.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' values times powers of the base, and the inverse powers."""
    up, down = _power_tables(len(data) + 1)
    return np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)])], down


def _prints(sums: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte ranges [lo, hi), alike wherever the bytes stand."""
    return mix64((sums[hi] - sums[lo]) * down[lo])


def _least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values, from minima that run forwards and backwards inside blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def strips(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first, last, core print, full print) of the strips of all rows; first and last string by where they start."""
    n, lo = len(data), 0
    while lo + LENGTH <= n:
        hi = min(n, lo + PIECE + LENGTH - 1)
        part = data[lo:hi]
        sums, down = _sums(part)
        grams = np.arange(len(part) - GRAM + 1)
        keys = (_prints(sums, down, grams, grams + GRAM) & ~_PLACE) | grams.astype(np.uint64)
        anchor = (_least_in_window(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(anchor))
        row = np.searchsorted(offs, start + lo, side="right") - 1
        inside = start + lo + LENGTH <= offs[row + 1]
        start, row, anchor = start[inside], row[inside], anchor[inside]
        lo += PIECE
        if not len(start):
            continue
        strip = (anchor - start) // STRIP
        head = np.r_[True, (np.diff(start) > 1) | (np.diff(row) > 0) | (np.diff(anchor) != 0) | (np.diff(strip) != 0)]
        heads = np.flatnonzero(head)
        first, last = start[heads], start[np.r_[heads[1:], len(start)] - 1]
        a, j = anchor[heads], strip[heads]
        core = _prints(sums, down, a - STRIP * j, a - STRIP * (j + 1) + 1 + LENGTH)
        core = mix64(core ^ (j + 1).astype(np.uint64))
        full = _prints(sums, down, first, last + LENGTH)
        full = mix64(full ^ mix64(((a - first) * 512 + (a - last)).astype(np.uint64)))
        base = lo - PIECE - offs[row[heads]]
        yield row[heads], first + base, last + base, core, full


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy()
        data, offs = utf8(b.column(1))
        for row, first, last, core, full in strips(data, offs):
            yield pa.RecordBatch.from_arrays(
                [_signed(core), _signed(full), pa.array(ids[row]), pa.array(first), pa.array((last - first + 1).astype(np.int16))], ["core", "full", "id", "first", "n"]
            )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the single strings of the strips that a text comes with."""
    for b in batches:
        ids, todo = b.column(0).to_numpy(), b.column(2).to_pylist()
        for i in range(b.num_rows):
            data, _ = utf8(b.column(1).slice(i, 1))
            prints, starts = [], []
            at = np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in todo[i]])
            at = np.unique(at)
            lo = 0
            while lo < len(data):
                here = at[(at >= lo) & (at < lo + PIECE)] - lo
                if len(here):
                    sums, down = _sums(data[lo : lo + PIECE + LENGTH - 1])
                    prints.append(_prints(sums, down, here, here + LENGTH))
                    starts.append(here + lo)
                lo += PIECE
            if prints:
                p, s = np.concatenate(prints), np.concatenate(starts)
                yield pa.RecordBatch.from_arrays([_signed(p), pa.array(np.full(len(p), ids[i])), pa.array(s)], ["core", "id", "first"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = b.column(2)
        total, removed, spans, kept = [], [], [], []
        for i in range(b.num_rows):
            data, _ = utf8(b.column(1).slice(i, 1))
            runs = gone[i].as_py() or []
            total.append(len(data))
            if not runs:
                removed.append(0)
                spans.append(0)
                kept.append(hashlib.sha256(data).hexdigest())
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            lo = np.array([r["first"] for r in runs])
            np.add.at(edge, lo, 1)
            np.add.at(edge, np.array([r["first"] + r["n"] - 1 + LENGTH for r in runs]), -1)
            off = np.cumsum(edge[:-1]) > 0
            removed.append(int(off.sum()))
            spans.append(int((off & ~np.r_[False, off[:-1]]).sum()))
            kept.append(hashlib.sha256(data[~off]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _row_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def repeated(docs: DataFrame) -> DataFrame:
    """Rows (id, first, n): n consecutive strings from byte `first` on that occur elsewhere also."""
    spark = docs.sparkSession
    src = _row_id(docs)
    suffixes = stored(src.where(F.octet_length("text") >= LENGTH).select("id", "text").mapInArrow(_suffixes, "core long, full long, id long, first long, n short"), "suffixes")
    parts = max(suffixes.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = suffixes.repartitionByRange(parts, "core")
    sort = Window.partitionBy("core").orderBy("full")
    ends = sort.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev, after = F.lag("full").over(sort), F.lead("full").over(sort)
    seen = ranged.select("id", "first", "n", "full", prev.alias("prev"), after.alias("after"), F.first("full").over(ends).alias("lo"), F.last("full").over(ends).alias("hi"))
    same = lambda c: F.coalesce(F.col(c) == F.col("full"), F.lit(False))
    found = seen.select("id", "first", "n", (same("prev") | same("after")).alias("copied"), ((F.col("lo") != F.col("hi")) & ~same("prev")).alias("open"))
    found = stored(found.where("copied or open"), "suffix-runs")
    drop_stored(suffixes)
    release_shuffles(spark)
    todo = found.where("open").groupBy("id").agg(F.collect_set(F.struct("first", "n")).alias("todo")).withColumnRenamed("id", "t_id")
    single = src.select("id", "text").join(todo, F.col("id") == F.col("t_id")).select("id", "text", "todo").mapInArrow(_strings, "core long, id long, first long")
    by = Window.partitionBy("core").orderBy("id", "first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    twice = single.select("id", "first", F.count("*").over(by).alias("c")).where("c > 1").select("id", "first", F.lit(1).cast("short").alias("n"))
    return found.where("copied").select("id", "first", "n").union(twice)


def long_repeats_removed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts under LENGTH bytes keep every byte. Rows that repeat each other are copies of each
    other and lose everything that is long enough. Other columns are ignored; an empty table gives an empty result.
    """
    # equal rows have the same id and the same runs, which count once
    runs = repeated(docs).groupBy("id").agg(F.collect_set(F.struct("first", "n")).alias("gone")).withColumnRenamed("id", "g_id")
    joined = _row_id(docs).join(runs, F.col("id") == F.col("g_id"), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
