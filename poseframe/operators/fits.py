"""Rigid fits from sums: whole tables, windows of valid pairs and segments.

Counts, sums and products of paired points determine a fit, so any window is a difference of two prefix rows. Rows and the pairs
of their windows meet in one shuffle of points, so sums are never shuffled. Only the decomposition of a 3 x 3 matrix runs in
NumPy, over Arrow batches of those sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poseframe.functions.scratch import stored
from poseframe.operators.blocks import ROWS, blocked, cut, too_long

S, D = ("sx", "sy", "sz"), ("dx", "dy", "dz")
#: A second pair that a row may have beside its own: it counts in the windows that span the row.
HS, HD = ("hsx", "hsy", "hsz"), ("hdx", "hdy", "hdz")
PRODUCTS = [(d, s) for d in D for s in S]
SUMS = ["n", *[f"sum_{c}" for c in (*S, *D)], *[f"sum_{d}_{s}" for d, s in PRODUCTS]]
FIT = "r array<double>, t array<double>, c double, rmse double"


def _terms(second: bool = False) -> list[Column]:
    name = dict(zip((*S, *D), (*HS, *HD), strict=True)) if second else {c: c for c in (*S, *D)}
    return [F.lit(1.0), *[F.col(name[c]) for c in (*S, *D)], *[F.col(name[d]) * F.col(name[s]) for d, s in PRODUCTS]]


def second_pairs() -> Column:
    return F.col(HS[0]).isNotNull() & F.col(HD[0]).isNotNull()


def uncentred_shift(r: Column, t: Column) -> Column:
    """The shift between points as they were, of a rotation and a shift between centred() ones."""
    moved = [r[3 * i] * F.col("_m_sx") + r[3 * i + 1] * F.col("_m_sy") + r[3 * i + 2] * F.col("_m_sz") for i in range(3)]
    return F.array(*[t[i] + F.col(f"_m_{D[i]}") - moved[i] for i in range(3)])


def valid_pairs() -> Column:
    """A pair counts if both points are known; the first coordinate says so."""
    return F.col("sx").isNotNull() & F.col("dx").isNotNull()


def _pair_sums(second: bool = False) -> list[Column]:
    aggs = [F.coalesce(F.sum(F.when(valid_pairs(), t)), F.lit(0.0)).alias(n) for t, n in zip(_terms(), SUMS, strict=True)]
    if second:
        more = [F.coalesce(F.sum(F.when(second_pairs(), t)), F.lit(0.0)) for t in _terms(True)]
        aggs = [(a + b).alias(n) for a, b, n in zip(aggs, more, SUMS, strict=True)]
    return aggs


def pair_sums(df: DataFrame, by: list[str], second: bool = False) -> DataFrame:
    """The sums of each group's valid pairs, with second ones too if asked for."""
    return df.groupBy(*by).agg(*_pair_sums(second))


def decompose(sums: np.ndarray, with_scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, translations and scales for rows of SUMS."""
    n = np.maximum(sums[:, :1], 1)
    ms, md = sums[:, 1:4] / n, sums[:, 4:7] / n
    cov = sums[:, 7:16].reshape(-1, 3, 3) / n[:, :, None] - md[:, :, None] * ms[:, None, :]
    u, sv, vt = np.linalg.svd(cov)
    flip = np.ones((len(sums), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    r = (u * flip[:, None, :]) @ vt
    spread = sums[:, 16] / n[:, 0] - (ms * ms).sum(axis=1) if sums.shape[1] > 16 else np.ones(len(sums))
    c = np.where(spread > 1e-300, (sv * flip).sum(axis=1) / np.where(spread > 1e-300, spread, 1), 1.0) if with_scale else np.ones(len(sums))
    t = md - c[:, None] * np.einsum("nij,nj->ni", r, ms)
    return r, t, c


def fitted(sums: DataFrame, with_scale: bool = False, least: int = 3, kept: list[str] | None = None) -> DataFrame:
    """Adds r (row-major), t and c to rows that hold SUMS (and sum_ss for a scale); null under `least` pairs.

    kept: the columns that stay beside them, all by default.
    """
    read = SUMS + (["sum_ss"] if with_scale else [])
    kept = sums.columns if kept is None else kept
    sums = sums.select(*kept, *[c for c in read if c not in kept])
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[sums.schema[c] for c in kept], T.StructField("r", vector), T.StructField("t", vector), T.StructField("c", T.DoubleType())])

    def lists(x: np.ndarray, few: np.ndarray) -> pa.Array:
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(few))

    def run(batches):
        for b in batches:
            x = np.stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in read], 1)
            r, t, c = decompose(x, with_scale)
            few = x[:, 0] < least
            new = [lists(r.reshape(-1, 9), few), lists(t, few), pa.array(c, mask=few)]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], *new], [*kept, "r", "t", "c"])

    return sums.mapInArrow(run, schema)


def global_fit(df: DataFrame, by: list[str], with_scale: bool = False, second: bool = False) -> DataFrame:
    """One fit for each group of pairs (sx.. sz, dx.. dz)."""
    sums = pair_sums(df, by, second)
    if with_scale:
        ss = F.sum(F.when(valid_pairs(), F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2))
        sums = sums.join(df.groupBy(*by).agg(F.coalesce(ss, F.lit(0.0)).alias("sum_ss")), by)
    return fitted(sums, with_scale).select(*by, "n", "r", "t", "c")


def applied(r: Column, t: Column, c: Column | float, p: tuple[str, str, str] = S) -> list[Column]:
    """c R p + t as three columns."""
    return [c * (r[3 * i] * F.col(p[0]) + r[3 * i + 1] * F.col(p[1]) + r[3 * i + 2] * F.col(p[2])) + t[i] for i in range(3)]


def residuals(df: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """df with the length of dst - fit(src) as residual."""
    out = df.join(fit.select(*by, "r", "t", "c"), by)
    x, y, z = applied(F.col("r"), F.col("t"), F.col("c"))
    d = F.sqrt((F.col("dx") - x) ** 2 + (F.col("dy") - y) ** 2 + (F.col("dz") - z) ** 2)
    return out.withColumn("residual", F.when(valid_pairs(), d)).drop("r", "t", "c")


def residual_report(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse"), F.avg("residual").alias("mean"), F.max("residual").alias("worst"))


def _group(by: list[str]) -> Column:
    """The keys of a series as one value, in which null equals null."""
    return F.struct(*by) if by else F.lit(0)


def _counted(df: DataFrame, by: list[str], order: str, rows: int | None, wide: Column) -> DataFrame:
    """df with _k, the valid pairs of a series up to each row, itself included, and _valid, all of them.

    Where series are cut also _widest, the largest `wide` of the series, and _size, the places of a home (see _summed()).
    """
    ok = valid_pairs().cast("long")
    base = cut(df, by, order, rows)
    first = Window.unboundedPreceding
    if "_block" not in base.columns:
        w = Window.partitionBy(*by)
        return base.withColumns({"_k": F.sum(ok).over(w.orderBy(order).rowsBetween(first, 0)), "_valid": F.sum(ok).over(w)})
    base = base.withColumn("_g", _group(by))
    w, keys = Window.partitionBy("_g"), ["_g", "_block"]
    counts = base.groupBy(*keys).agg(F.sum(ok).alias("_o"), F.max(wide).alias("_widest"))
    before = F.sum("_o").over(w.orderBy("_block").rowsBetween(first, 0)) - F.col("_o")
    counts = counts.select(*keys, before.alias("_before"), F.sum("_o").over(w).alias("_valid"), F.greatest(F.lit(1), F.max("_widest").over(w)).alias("_widest"))
    own = base.withColumn("_k", F.sum(ok).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(first, 0)))
    out = own.join(counts, keys).withColumn("_k", F.col("_k") + F.col("_before")).drop("_before", "_g", "_block")
    return out.withColumn("_size", _home_size(rows))


def _home_size(rows: int) -> Column:
    return F.greatest(F.lit(rows).cast("long"), F.col("_widest"))


def _wide() -> Column:
    """How many valid pairs a window _w spans at most; any number where that is null."""
    return F.coalesce(F.col("_w").cast("long"), F.lit(2**31 - 1))


def _bounded(df: DataFrame, by: list[str], order: str, rows: int | None) -> DataFrame:
    """_counted() rows with lo and hi of windows of _w valid pairs, see window_bounds()."""
    df = _counted(df, by, order, rows, _wide()).withColumnRenamed("_valid", "n_valid")
    pos = F.least(F.col("_k") - valid_pairs().cast("long"), F.col("n_valid") - 1)
    lo = F.greatest(F.lit(0), pos - F.floor(F.col("_w") / 2))
    hi = F.least(F.col("n_valid"), lo + F.col("_w"))
    return df.withColumn("hi", hi.cast("int")).withColumn("lo", F.greatest(F.lit(0), F.col("hi") - F.col("_w")).cast("int"))


def window_bounds(df: DataFrame, by: list[str], order: str, width: Column, rows: int | None = ROWS) -> DataFrame:
    """Adds lo and hi: the valid pairs, by their place among the valid, of a window of `width` centred on each row.

    The place is the number of valid pairs before the row (the last place at most); the window starts width // 2 before it and
    keeps its width at both ends.
    """
    return _bounded(df.withColumn("_w", width.cast("int")), by, order, rows).drop("_w", "_k", "_widest", "_size")


def _summed(df: DataFrame, by: list[str], kept: list[str], second: bool = False, series: DataFrame | None = None) -> DataFrame:
    """Columns `kept` of _counted() rows with lo and hi, and SUMS over the valid pairs in [lo, hi).

    A series has homes of _size places (one home where it isn't cut). A row asks in the home of its lo for the sums up to lo and up to hi, and pairs
    go to their own home and to the one before if its windows reach them, so that all meet in one shuffle of points. series: a row
    (_g, _home, _series) for each home; _series comes to all rows of the home, and points are taken less its means _m_sx .. _m_dz.
    """
    points = [*S, *D, *((*HS, *HD) if second else ())]
    used = (valid_pairs() | second_pairs()) if second else valid_pairs()
    k = F.col("_k")
    at = lambda home, place, turn: F.struct(home.cast("long").alias("_home"), place.cast("long").alias("_at"), turn.cast("int").alias("_turn"))
    # of one place: its valid pair, windows that end with it, second pairs up to the next valid one, windows that start there
    pair, end, start = F.when(valid_pairs(), 0).otherwise(2), 1, 3
    if "_size" in df.columns:
        in_home = lambda place: F.floor(place / F.col("_size"))
        homes = F.sequence(F.greatest(F.lit(0), F.floor((k - F.col("_widest")) / F.col("_size"))).cast("long"), in_home(k - 1))
    else:
        in_home = lambda place: F.lit(0)
        homes = F.array(F.lit(0).cast("long"))
    pairs = F.when(used & (k > 0), F.transform(homes, lambda h: at(h, k, pair)))
    home = in_home(F.col("lo"))
    asked = F.array(at(home, F.col("lo"), F.lit(start)), at(home, F.col("hi"), F.lit(end)))
    out = df.withColumns({"_g": _group(by), "_id": F.monotonically_increasing_id(), "_row": F.struct(*kept)})
    out = out.select("_g", "_id", "_row", *points, F.inline(F.concat(F.coalesce(pairs, F.slice(asked, 1, 0)), asked)))
    is_pair = F.col("_turn").isin(0, 2)
    out = out.select("_g", "_home", "_at", "_turn", F.when(~is_pair, F.col("_id")).alias("_id"), *[F.when(is_pair, F.col(c)).alias(c) for c in points], F.when(F.col("_turn") == end, F.col("_row")).alias("_row"))
    upto = Window.partitionBy("_g", "_home").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    if series is not None:
        out = out.unionByName(series.withColumns({"_at": F.lit(-1).cast("long"), "_turn": F.lit(0)}), allowMissingColumns=True)
        out = out.withColumn("_series", F.first("_series", ignorenulls=True).over(upto))
        out = out.withColumns({c: F.col(c) - F.col(f"_series._m_{m}") for c, m in zip(points, [*S, *D] * 2, strict=False)})
    terms = [F.when(valid_pairs(), t).otherwise(F.lit(0.0)) for t in _terms()]
    if second:
        terms = [a + F.when(second_pairs(), b).otherwise(F.lit(0.0)) for a, b in zip(terms, _terms(True), strict=True)]
    more = ["_series"] if series is not None else []
    out = out.select("_g", "_home", "_id", "_at", "_turn", "_row", *more, F.struct(*[F.coalesce(F.sum(t).over(upto), F.lit(0.0)).alias(n) for t, n in zip(terms, SUMS, strict=True)]).alias("_hi"))
    out = out.where(F.col("_turn").isin(start, end))
    two = Window.partitionBy("_g", "_home", "_id").orderBy(F.desc("_turn"))
    out = out.withColumns({"_lo": F.lag("_hi").over(two), "_from": F.lag("_at").over(two)}).where(F.col("_turn") == end)
    some = F.col("_at") > F.col("_from")
    for c in by:
        some &= F.col(f"_g.{c}").isNotNull()
    return out.select("_row", *more, *[F.when(some, F.col(f"_hi.{n}") - F.col(f"_lo.{n}")).otherwise(F.lit(0.0)).alias(n) for n in SUMS])


def window_sums(df: DataFrame, by: list[str], order: str, second: bool = False, rows: int | None = ROWS) -> DataFrame:
    """Rows with lo and hi get SUMS over the valid pairs in [lo, hi): the difference of two prefix rows; 0 for a series without a key.

    second: second pairs of the rows from the window's first valid row to its last count as well. Prefix sums run in homes of at
    most `rows` pairs of a series, or as many as its widest window has.
    """
    kept = [c for c in df.columns if c not in SUMS]
    out = _summed(_counted(df, by, order, rows, (F.col("hi") - F.col("lo")).cast("long")), by, kept, second)
    return out.select("_row.*", *SUMS)


def _windowed(df: DataFrame, by: list[str], order: str, width: Column, second: bool, rows: int, second_in_fit: bool) -> DataFrame:
    """A row (_row, _r, _t, _m_sx .. _m_dz, SUMS) for each row of df: its columns, its series' fit and means, sums of points less these.

    Rows of long series are stored, cut, since counts, fits and windows all come from them. Rows without a key or a place are left out in the end.
    """
    rows = rows if too_long(df, by, rows) else None
    base = df.withColumn("_w", width.cast("int"))
    base = base if rows is None else stored(blocked(base, by, order, rows), "blocks")
    means = {f"_m_{c}": F.coalesce(F.avg(F.when(valid_pairs(), F.col(c))), F.lit(0.0)) for c in (*S, *D)}
    sizes = [F.sum(valid_pairs().cast("long")).alias("_valid"), F.greatest(F.lit(1), F.max(_wide())).alias("_widest")]
    series = base.groupBy(_group(by).alias("_g")).agg(*_pair_sums(second_in_fit), *[m.alias(n) for n, m in means.items()], *sizes)
    series = fitted(series, kept=["_g", *means, "_valid", "_widest"])
    last = F.lit(0).cast("long") if rows is None else F.floor(F.col("_valid") / _home_size(rows))
    series = series.select("_g", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_home"), F.struct(F.col("r").alias("_r"), F.col("t").alias("_t"), *means).alias("_series"))
    out = _summed(_bounded(base, by, order, rows), by, df.columns, second, series)
    known = F.lit(True)
    for c in (*by, order):
        known &= F.col(f"_row.{c}").isNotNull()
    return out.where(known).select("_row", "_series.*", *SUMS)


def windowed_fit(df: DataFrame, by: list[str], order: str, width: Column, least: int = 3, second: bool = False, rows: int = ROWS, pairs: str | None = None) -> DataFrame:
    """A fit (r, t, c) for each row from the window around it; where that has too few pairs, the whole series' fit.

    pairs: a name under which rows get the number of pairs in their windows.
    """
    sums = _windowed(df, by, order, width, second, rows, second)
    out = fitted(sums, least=least, kept=["_row", "_r", "_t", *[f"_m_{c}" for c in (*S, *D)], "n"])
    local = F.col("r").isNotNull()
    t = F.coalesce(F.when(local, uncentred_shift(F.col("r"), F.col("t"))), F.col("_t"))
    count = [F.col("n").alias(pairs)] if pairs else []
    return out.select("_row.*", F.coalesce("r", "_r").alias("r"), t.alias("t"), F.coalesce("c", F.lit(1.0)).alias("c"), *count)


def windowed_shift(df: DataFrame, by: list[str], order: str, width: Column, second: bool = False, second_in_rotation: bool | None = None, rows: int = ROWS) -> DataFrame:
    """One rotation for a series, a translation for each row: the window's mean of dst - R src (whole series if empty).

    second_in_rotation: whether second pairs count for the rotation, if not as for the translations.
    """
    out = _windowed(df, by, order, width, second, rows, second if second_in_rotation is None else second_in_rotation)
    mean = lambda c: F.when(F.col("n") > 0, F.col(f"sum_{c}") / F.col("n"))
    r = F.col("_r")
    t = F.array(*[mean(D[i]) - (r[3 * i] * mean("sx") + r[3 * i + 1] * mean("sy") + r[3 * i + 2] * mean("sz")) for i in range(3)])
    return out.select("_row.*", r.alias("r"), F.when(F.col("n") > 0, uncentred_shift(r, t)).otherwise(F.col("_t")).alias("t"))


def segment_fit(df: DataFrame, by: list[str], label: str, second: bool = False) -> DataFrame:
    """One fit for each label of a series, given to its rows; labels with too few pairs take the series' fit."""
    local = global_fit(df, [*by, label], second=second).select(*by, label, "r", "t")
    whole = global_fit(df, by, second=second).select(*by, F.col("r").alias("_r"), F.col("t").alias("_t"))
    out = df.join(local, [*by, label]).join(whole, by)
    return out.withColumn("r", F.coalesce("r", "_r")).withColumn("t", F.coalesce("t", "_t")).drop("_r", "_t")


def match_points(source: DataFrame, target: DataFrame, reach: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Iterated closest points: R and t that move source (pid, sx.. sz) onto target (dx.. dz); each round is one radius join.

    Only the 16 sums of a round reach the driver.
    """
    from poseframe.operators.spatial import nearest_in

    r, t = np.eye(3), np.zeros(3)
    goal = target.select(F.col("dx").alias("px"), F.col("dy").alias("py"), F.col("dz").alias("pz"))
    for _ in range(rounds):
        moved = source.select("pid", *S, *[sum((float(r[i, j]) * F.col(S[j]) for j in range(3)), F.lit(float(t[i]))).alias(p) for i, p in enumerate(("px", "py", "pz"))])
        met = nearest_in(moved, goal, ["px", "py", "pz"], reach, "pid").select("pid", F.col("r_px").alias("dx"), F.col("r_py").alias("dy"), F.col("r_pz").alias("dz"))
        row = pair_sums(source.join(met, "pid"), []).first()
        x = np.array([[row[n] for n in SUMS]])
        if x[0, 0] < 3:
            break
        new_r, new_t, _ = decompose(x, False)
        done = np.abs(new_r[0] - r).max() < 1e-9 and np.abs(new_t[0] - t).max() < 1e-9
        r, t = new_r[0], new_t[0]
        if done:
            break
    return r, t


def lag_correlation(a: DataFrame, b: DataFrame, lags: DataFrame, by: list[str], least: int = 50, block: float | None = None) -> DataFrame:
    """Pearson's r of b, read `lag` later on the line between its samples, with a: rows (by, lag, n, r).

    a and b are (by, t, v), lags (lag) or (by, lag). Time is cut into blocks: a task holds a block's samples of a and the
    stretch of b that any lag reaches from there, and emits sums for each lag, which are then added up. So neither a long
    recording nor many candidates need one task. block: its length, by default twice what the lags span, and 1000 samples at least. r is 0 under
    `least` common samples or without variance.
    """
    have = lambda df: df.where(" and ".join(f"{c} is not null" for c in (*by, "t", "v"))).select(*by, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    a, b = have(a), have(b)
    keys = [c for c in by if c in lags.columns]
    span = lags.groupBy(*keys).agg(F.min("lag").alias("_l0"), F.max("lag").alias("_l1"), F.array_sort(F.collect_set("lag")).alias("_lags"))
    ends = b.groupBy(*by).agg(F.min("t").alias("_b0"), F.max("t").alias("_b1"), F.avg("v").alias("_bm"), F.count("*").alias("_bn")).join(a.groupBy(*by).agg(F.avg("v").alias("_am")), by)
    ends = ends.join(span, keys) if keys else ends.join(F.broadcast(span))
    ends = ends.withColumn("_size", F.lit(block) if block else F.greatest(2 * (F.col("_l1") - F.col("_l0")), 1000 * (F.col("_b1") - F.col("_b0")) / F.col("_bn"), F.lit(1e-9)))
    ends = stored(ends, "spans")  # a row for each series, which four joins below read
    cell = lambda t: F.floor(t / F.col("_size"))
    left = a.join(ends, by).groupBy(*by, cell(F.col("t")).alias("_block")).agg(F.collect_list("t").alias("_at"), F.collect_list(F.col("v") - F.col("_am")).alias("_av"))
    w = Window.partitionBy(*by).orderBy("t")
    near = b.withColumns({"_p": F.coalesce(F.lag("t").over(w), "t"), "_n": F.coalesce(F.lead("t").over(w), "t")}).join(ends, by)
    near = near.withColumn("_block", F.explode(F.sequence(cell(F.col("_p") - F.col("_l1")), cell(F.col("_n") - F.col("_l0")))))
    right = near.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("v") - F.col("_bm")).alias("v")))).alias("_b"))
    rows = left.join(right, [*by, "_block"]).join(ends.select(*by, "_b0", "_b1", "_lags"), by)
    rows = rows.select(*by, "_at", "_av", F.transform("_b", lambda p: p["t"]).alias("_bt"), F.transform("_b", lambda p: p["v"]).alias("_bv"), "_b0", "_b1", "_lags")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at, av, bt, bv = (np.asarray(x, float) for x in row[len(by) : len(by) + 4])
                first, last, cand = row[-3], row[-2], np.asarray(row[-1], float)
                out = []
                for lag in cand:
                    x = at + lag
                    ok = (x >= first) & (x <= last)
                    if ok.any():
                        p, q = av[ok], np.interp(x[ok], bt, bv)
                        out.append((*row[: len(by)], float(lag), len(p), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum()))
                yield pd.DataFrame(out, columns=[*by, "lag", "n", "p", "q", "pp", "qq", "pq"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    parts = rows.mapInPandas(run, f"{kinds}, lag double, n long, p double, q double, pp double, qq double, pq double")
    sums = parts.groupBy(*by, "lag").agg(*[F.sum(c).alias(c) for c in ("n", "p", "q", "pp", "qq", "pq")])
    every = ends.select(*by, F.explode("_lags").alias("lag")).join(sums, [*by, "lag"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col
    cov = c("pq") - c("p") * c("q") / c("n")
    var = F.sqrt(F.greatest(c("pp") - c("p") * c("p") / c("n"), F.lit(0.0)) * F.greatest(c("qq") - c("q") * c("q") / c("n"), F.lit(0.0)))
    return every.select(*by, "lag", "n", F.when((c("n") >= least) & (var > 0), cov / var).otherwise(0.0).alias("r"))


def least_lag(scores: DataFrame, by: list[str]) -> DataFrame:
    """The lag of the smallest r of each series (axes are opposite); of ones equal to nine digits the smallest lag."""
    return scores.groupBy(*by).agg(F.min_by(F.struct("lag", "r"), F.struct(F.round("r", 9), "lag")).alias("m")).select(*by, "m.lag", "m.r")


def drift(a: DataFrame, b: DataFrame, by: list[str], center: float = 0.0, coarse: tuple[float, float] = (20.0, 0.033), fine: tuple[float, float] = (3.0, 0.001)) -> DataFrame:
    """Two sweeps over lags: wide and coarse, then narrow and fine around the best; rows (by, lag, r)."""
    spark = a.sparkSession
    a, b = (stored(df.select(*by, "t", "v"), "signal") for df in (a, b))  # both sweeps read them
    steps = int(round(2 * coarse[0] / coarse[1])) + 1
    wide = spark.range(steps).select((F.lit(center - coarse[0]) + F.col("id") * coarse[1]).alias("lag"))
    first = least_lag(lag_correlation(a, b, wide, by), by)
    n = int(round(2 * fine[0] / fine[1])) + 1
    near = first.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), F.col("lag").alias("_l")).select(*by, (F.col("_l") - fine[0] + F.col("k") * fine[1]).alias("lag"))
    return least_lag(lag_correlation(a, b, near, by), by)


def match_reach(a: DataFrame, b: DataFrame, share: float = 0.01) -> float:
    """How far apart points may be to match: a share of the diagonal of the smaller cloud's box; clouds are (x, y, z)."""

    def diagonal(df: DataFrame) -> float:
        row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
        return float(np.sqrt(sum((row[c] or 0.0) ** 2 for c in "xyz")))

    return share * min(diagonal(a), diagonal(b))
