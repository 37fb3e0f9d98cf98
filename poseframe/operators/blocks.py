"""Long series in blocks, so that no task holds a whole recording.

A series of more rows than a task should hold is cut into blocks of about that many rows. Sums run inside a block and the sums of
earlier blocks are added (two levels); what a block needs of its neighbours is carried in: their last row, or a margin of
rows. Series that are short anyway (a count tells) take the plain window, which gives the same rows with one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.functions.scratch import stored

#: Rows of a series that one task may hold.
ROWS = 2_000_000
#: Bins for each block that the rows of a long series are counted in before it is cut.
BINS = 16


def joined(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """df with the columns of `small`, joined on keys where null equals null."""
    other = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    return df.join(other, on, how).drop(*[f"_k_{k}" for k in keys])


def too_long(df: DataFrame, by: list[str], rows: int) -> bool:
    """Whether any series has more than `rows` rows; one small job."""
    return not df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > rows).isEmpty()


def blocked(df: DataFrame, by: list[str], on: str, rows: int = ROWS) -> DataFrame:
    """df with _block: numbers, ascending with `on`, of blocks of about `rows` rows; 0 for a series with fewer.

    The rows of a long series are counted in bins of equal width, and bins are put together by their running count, so bursts get
    blocks of their own. Rows of one time stay together. Only counts per bin are held for a whole series.
    """
    t = F.col(on).cast("double")
    span = df.where(F.col(on).isNotNull()).groupBy(*by).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count("*").alias("_n")).where(F.col("_n") > rows)
    span = span.select(*by, "_t0", ((F.col("_t1") - F.col("_t0")) / (BINS * F.ceil(F.col("_n") / rows))).alias("_width"))
    bins = joined(df, span, by).withColumn("_bin", F.when(F.col("_width") > 0, F.floor((t - F.col("_t0")) / F.col("_width")))).drop("_t0", "_width")
    counts = bins.where("_bin is not null").groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    cut = counts.select(*by, "_bin", F.floor(before / rows).alias("_block"))
    return joined(bins, cut, [*by, "_bin"]).drop("_bin").withColumn("_block", F.coalesce("_block", F.lit(0)))


def cut(df: DataFrame, by: list[str], on: str, rows: int | None = ROWS) -> DataFrame:
    """df as it is if no series has more than `rows` rows; else blocked(), stored, so that what follows reads it and doesn't work it out again.

    rows None: series are known to be short. A table that is cut already stays so.
    """
    if rows is None or "_block" in df.columns:
        return df
    return stored(blocked(df, by, on, rows), "blocks") if too_long(df, by, rows) else df


def _running(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], before: bool) -> DataFrame:
    last = -1 if before else 0
    zero = {n: F.lit(0).cast(df.select(c.alias(n)).schema[n].dataType) for n, c in sums.items()}
    keys = [*by, "_block"] if "_block" in df.columns else by
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    own = df.withColumns({n: F.coalesce(F.sum(c).over(w), zero[n]) for n, c in sums.items()})
    if keys is by:
        return own
    totals = df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), zero[n]).alias(f"_o_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_o_{n}").over(earlier), zero[n]).alias(f"_o_{n}") for n in sums])
    return joined(own, offsets, keys).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop(*[f"_o_{n}" for n in sums])


def _previous(df: DataFrame, by: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    if "_block" not in df.columns:
        w = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({n: F.lag(c).over(w) for n, c in values.items()})
    keys = [*by, "_block"]
    held = F.struct(*[c.alias(n) for n, c in values.items()])
    own = df.withColumn("_before", F.lag(held).over(Window.partitionBy(*keys).orderBy(order)))
    lasts = df.groupBy(*keys).agg(F.max_by(held, order).alias("_held"))
    lasts = lasts.select(*keys, F.lag("_held").over(Window.partitionBy(*by).orderBy("_block")).alias("_held"))
    out = joined(own, lasts, keys).withColumn("_before", F.coalesce("_before", "_held"))
    return out.withColumns({n: F.col(f"_before.{n}") for n in values}).drop("_before", "_held")


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], rows: int | None = ROWS, before: bool = False) -> DataFrame:
    """df with each named sum over the rows of the series up to each row, or before it; 0 where there is nothing to add."""
    return _running(cut(df, by, order, rows), by, order, sums, before).drop("_block")


def row_numbers(df: DataFrame, by: list[str], order: str, name: str, rows: int | None = ROWS) -> DataFrame:
    """df with each row's place in its series, from 0."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")}, rows, before=True)


def previous(df: DataFrame, by: list[str], order: str, values: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """df with, under each name, the value in the series' row before; null in the first."""
    return _previous(cut(df, by, order, rows), by, order, values).drop("_block")


def changes_numbered(df: DataFrame, by: list[str], order: str, values: dict[str, Column], change: Column, name: str, rows: int | None = ROWS) -> DataFrame:
    """df with `name`, the number of rows so far for which `change` holds, where change may look at the row before (values, by name)."""
    out = _previous(cut(df, by, order, rows), by, order, values)
    return _running(out, by, order, {name: F.coalesce(change.cast("long"), F.lit(0))}, False).drop("_block", *values)


def margined(df: DataFrame, by: list[str], order: str, reach: int, rows: int = ROWS) -> DataFrame:
    """Rows with _place (from 0), _size (rows of the series) and _block, repeated in each block that has them within `reach` rows.

    _own tells a block's own rows from its margin. A window over (by, _block) that looks at most `reach` rows away sees for own rows
    what a window over the whole series would. Series of at most `rows` rows are one block.
    """
    blocks = cut(df, by, order, rows)
    if "_block" not in blocks.columns:
        one = Window.partitionBy(*by)
        return df.withColumns({"_place": F.row_number().over(one.orderBy(order)).cast("long") - 1, "_size": F.count("*").over(one), "_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    placed = _running(blocks, by, order, {"_place": F.lit(1).cast("long")}, True).drop("_block")
    sized = joined(placed, blocks.groupBy(*by).agg(F.count("*").alias("_size")), by)
    to = lambda p: F.floor(p / rows)
    around = F.sequence(to(F.greatest(F.col("_place") - reach, F.lit(0))), to(F.least(F.col("_place") + reach, F.col("_size") - 1)))
    return sized.withColumn("_block", F.explode(around)).withColumn("_own", F.col("_block") == to(F.col("_place")))
