"""As-of joins with explicit rules for ties and tolerance, built on windows over both sides' union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.operators.blocks import ROWS, blocked, too_long


def _carried(rows: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """For each block the right row before it and the one after it, as rows of that block."""
    at = F.struct("_t", "_r")
    per = rows.groupBy(*by, "_block").agg(F.min_by(at, F.when(F.col("_side") == 0, F.struct("_t", rank))).alias("lo"), F.max_by(at, F.when(F.col("_side") == 0, F.struct("_t", -rank))).alias("hi"))
    along = Window.partitionBy(*by).orderBy("_block")
    per = per.withColumn("before", F.last("hi", True).over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("lo", True).over(along.rowsBetween(1, Window.unboundedFollowing)))
    return per.select(*by, "_block", F.inline(F.array_compact(F.array("before", "after")))).withColumns({"_row": F.lit(None).cast(rows.schema["_row"].dataType), "_side": F.lit(0)})


def _neighbours(left: DataFrame, right: DataFrame, on: str, by: list[str], order: str | None, block: float | None, rows: int) -> DataFrame:
    """Rows of left as (_row, _t, _p, _n): right's last row at or before and its first one after, with the prefix r_.

    One shuffle of both sides' union. Where a series has more than `rows` rows of both sides together, or a block is given, it is cut and
    each block gets the nearest right row on either side of it.
    """
    cols = [c for c in right.columns if c not in by]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, on)])
    packed = right.where(known).select(*by, F.col(on).alias("_t"), F.struct(*[F.col(c).alias(f"r_{c}") for c in cols]).alias("_r"))
    l = left.withColumn("_row", F.struct(*left.columns)).select(*by, F.col(on).alias("_t"), F.lit(None).cast(packed.schema["_r"].dataType).alias("_r"), "_row", F.lit(1).alias("_side"))
    r = packed.select(*by, "_t", "_r", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"))
    both = l.unionByName(r)
    rank = F.col(f"_r.r_{order}") if order else F.lit(0)
    keys = list(by)
    if block:
        both = both.withColumn("_block", F.floor(F.col("_t") / block))
    elif too_long(both.select(*by), by, rows):
        both = blocked(both, by, "_t", rows)
    if "_block" in both.columns:
        keys = [*by, "_block"]
        both = both.unionByName(_carried(both, by, rank))
    # at one time right rows stand first, the one that counts last of them
    ahead = Window.partitionBy(*keys).orderBy("_t", "_side", rank.desc()).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").desc(), rank.desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"_p": F.last("_r", True).over(ahead), "_n": F.last("_r", True).over(behind)}).where("_side = 1")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str],
    *,
    direction: str = "nearest",
    tie: str = "earlier",
    tolerance: float | None = None,
    clamp: bool = False,
    order: str | None = None,
    block: float | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """left with the row of right that matches in time: columns of left, then of right with the prefix r_ (and r_<on>).

    direction: nearest, backward (last at or before) or forward (first at or after). tie: which of two equally near rows.
    Of right rows at one time the first by `order` (a number) counts. clamp: forward takes the last row where none follows. Rows
    beyond the tolerance, and without any match, get nulls. A series with more than `rows` rows of both sides is cut into blocks
    of about that many, with the nearest rows outside carried in, so no task needs a whole recording; block cuts at multiples of
    that many units instead. A left row without a time, or with a null key, matches nothing.
    """
    cols = [c for c in right.columns if c not in by]
    out = _neighbours(left, right, on, by, order, block, rows)
    if clamp:  # one row for each series: its last
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, on)])
        rank = F.col(order) if order else F.lit(0)
        whole = F.struct(*[F.col(c).alias(f"r_{c}") for c in cols])
        last = right.where(known).groupBy(*by).agg(F.max_by(whole, F.struct(F.col(on), -rank)).alias("_last"))
        out = out.join(last, by, "left") if by else out.join(F.broadcast(last))
    dp, dn = F.col("_t") - F.col(f"_p.r_{on}"), F.col(f"_n.r_{on}") - F.col("_t")
    exact = F.when(dp == 0, F.col("_p"))
    if direction == "backward":
        hit = F.col("_p")
    elif direction == "forward":
        hit = F.coalesce(exact, "_n", *(["_last"] if clamp else []))
    else:
        first = dp <= dn if tie == "earlier" else dp < dn
        hit = F.when(F.col("_n").isNull() | first | (dp == 0), F.coalesce("_p", "_n")).otherwise(F.col("_n"))
    out = out.withColumn("_hit", F.when(F.col("_t").isNotNull(), hit))
    if tolerance is not None:
        out = out.withColumn("_hit", F.when(F.abs(F.col("_t") - F.col(f"_hit.r_{on}")) <= tolerance, F.col("_hit")))
    return out.select("_row.*", *[F.col(f"_hit.r_{c}").alias(f"r_{c}") for c in cols])


def bracketed(left: DataFrame, right: DataFrame, on: str, by: list[str], rows: int = ROWS) -> DataFrame:
    """left with _p and _n: right's last row at or before its time and the first at or after, as structs of right's columns.

    Both neighbours come from one shuffle of both sides' union; longer series than `rows` are cut as in asof_join(). A null where
    there is none; rows with a null key or time meet nothing.
    """
    cols = [c for c in right.columns if c not in by]
    out = _neighbours(left, right, on, by, None, None, rows)
    plain = lambda n: F.struct(*[F.col(f"{n}.r_{c}").alias(c) for c in cols])
    here = F.col("_p").isNotNull() & (F.col(f"_p.r_{on}") == F.col("_t"))
    met = F.col("_t").isNotNull()
    follows = F.when(met & here, plain("_p")).when(met & F.col("_n").isNotNull(), plain("_n"))
    return out.select("_row.*", F.when(met & F.col("_p").isNotNull(), plain("_p")).alias("_p"), follows.alias("_n"))


def between(on: str) -> Column:
    """Where a row of bracketed() lies between its neighbours, 0 to 1; null where only one is known or both are the same."""
    return F.when(F.col(f"_n.{on}") > F.col(f"_p.{on}"), (F.col(on) - F.col(f"_p.{on}")) / (F.col(f"_n.{on}") - F.col(f"_p.{on}")))


def resample_linear(values: DataFrame, at: DataFrame, on: str, value: str, by: list[str], rows: int = ROWS) -> DataFrame:
    """Rows of `at` with `value` of the other table interpolated at their time; the end values are held outside."""
    known = values.where(F.col(value).isNotNull()).select(*by, on, value)
    line = F.col(f"_p.{value}") + between(on) * (F.col(f"_n.{value}") - F.col(f"_p.{value}"))
    return bracketed(at, known, on, by, rows).withColumn(value, F.coalesce(line, f"_p.{value}", f"_n.{value}")).drop("_p", "_n")
