"""Operators on ordered series: islands, slip correction, robust filters, filling, smoothing, heading changes.

`by` always names the series; `order` orders it. All of it is windows and joins on keys. `rows` is how many rows of a series one task
may hold: a longer one is worked on in blocks (see blocks.py), with the same rows as a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.functions.scratch import drop_stored, stored
from poseframe.operators.asof import asof_join, between, bracketed
from poseframe.operators.blocks import ROWS, changes_numbered, cut, joined, margined, row_numbers, running_sums, too_long


def _w(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def islands(df: DataFrame, by: list[str], order: str, value: str, name: str = "island", rows: int | None = ROWS) -> DataFrame:
    """Numbers the runs of equal values from 0; the first row starts one, null equals null."""
    starts = F.col("_was").isNull() | ~F.col(f"_was.{value}").eqNullSafe(F.col(value))
    return changes_numbered(df, by, order, {"_was": F.struct(value)}, starts, name, rows).withColumn(name, F.col(name) - 1)


def island_table(df: DataFrame, by: list[str], order: str, value: str, rows: int = ROWS) -> DataFrame:
    """One row per run that another one follows: island, value, first and next start, rows."""
    runs = islands(df, by, order, value, rows=rows).groupBy(*by, "island").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count("*").alias("n"))
    return runs.withColumn("next_start", F.lead("start").over(_w(by, "island"))).where("next_start is not null")


def gap_runs(df: DataFrame, by: list[str], order: str, gap: float, value: str, rows: int = ROWS) -> DataFrame:
    """Runs of rows that are at most `gap` apart: start, end, rows and the least value."""
    df = changes_numbered(df, by, order, {"_was": F.col(order)}, F.col(order) - F.col("_was") > gap, "run", rows)
    return df.groupBy(*by, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), F.min(value).alias("least"))


def slip_corrected(df: DataFrame, by: list[str], order: str, foot: str, stance: dict[str, list[str]], move: list[list[str]], rows: int = ROWS) -> DataFrame:
    """Holds the standing foot still: df with the columns in `move` corrected.

    stance: for each value of `foot` the coordinate columns of that heel; move: groups of columns to correct, in the order of
    the coordinates. Within a run of one foot every frame is shifted so that the heel stays where the run began; what the
    heel slipped is carried on as a sum over earlier runs. The last run only gets what was carried. Runs become small rows
    (first and last heel), the carry is a running sum over those, and the rows take their run's shift by a join.
    """
    base = cut(df, by, order, rows)
    rows = rows if "_block" in base.columns else None
    run = islands(base, by, order, foot, rows=rows)
    dims = range(len(next(iter(stance.values()))))

    def heel(k: int) -> Column:
        out = F.lit(None).cast("double")
        for name, cols in stance.items():
            out = F.when(F.col(foot) == name, F.col(cols[k])).otherwise(out)
        return out

    run = run.withColumns({f"_h{k}": heel(k) for k in dims})
    ends = F.struct(*[f"_h{k}" for k in dims])
    runs = run.groupBy(*by, "island").agg(F.min_by(ends, order).alias("_s"), F.max_by(ends, order).alias("_e"))
    # a run's last row carries start minus end into all later rows
    slip = {f"_c{k}": F.coalesce(F.col(f"_s._h{k}") - F.col(f"_e._h{k}"), F.lit(0.0)) for k in dims}
    runs = running_sums(runs, by, "island", slip, rows, before=True)
    runs = runs.withColumn("_goes_on", F.lead("island").over(_w(by, "island")).isNotNull())
    out = joined(run, runs.drop("_e"), [*by, "island"])
    inside = F.col("_goes_on")
    shift = [F.col(f"_c{k}") + F.when(inside, F.col(f"_s._h{k}") - F.col(f"_h{k}")).otherwise(0.0) for k in dims]
    out = out.withColumns({c: F.col(c) + shift[k] for group in move for k, c in enumerate(group)})
    return out.drop(*[f"_{x}{k}" for x in "hc" for k in dims], "_s", "_goes_on")


def sliding_medians(df: DataFrame, by: list[str], order: str, names: dict[str, str], width: int = 21, rows: int = ROWS) -> DataFrame:
    """For each column its median of `width` rows around each, under the name given; the first and last value stand in beyond the ends."""
    half = width // 2
    out = margined(df, by, order, half, rows)
    w = Window.partitionBy(*by, "_block").orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.greatest(F.lit(0), half - F.col("_place")).cast("int")
    after = F.greatest(F.lit(0), F.col("_place") + half + 1 - F.col("_size")).cast("int")

    def median(v: str) -> Column:
        # a block that reaches an end holds the end's row in its margin
        held = F.concat(F.array_repeat(f"_a_{v}", ahead), f"_v_{v}", F.array_repeat(f"_z_{v}", after))
        return F.element_at(F.array_sort(held), half + 1)

    for v in names:
        out = out.withColumns({f"_a_{v}": F.first(v).over(every), f"_z_{v}": F.last(v).over(every), f"_v_{v}": F.collect_list(v).over(w.rowsBetween(-half, half))})
    return out.where("_own").withColumns({n: median(v) for v, n in names.items()}).select(*df.columns, *names.values())


def sliding_median(df: DataFrame, by: list[str], order: str, value: str, width: int = 21, name: str = "median", rows: int = ROWS) -> DataFrame:
    """The median of `width` rows around each; the first and last value stand in beyond the ends."""
    return sliding_medians(df, by, order, {value: name}, width, rows)


#: Distances of a group that one task may put in order.
EXACT = 1_000_000
#: Bins that a longer group's values are counted in, round by round.
STEPS = 2048


def _narrowed(values: DataFrame, by: list[str], most: int) -> DataFrame:
    """For groups with more than `most` values: each of the two middle ranks with the least interval of values that holds it.

    Rows (by, rank, lo, hi, n, at): at is the place of the rank, from 1, among the n values in [lo, hi]. Each round counts the values
    of the interval in bins and takes the bin with the rank, from its smallest to its largest value, until it holds few
    values or a single one. Only counts per bin meet in a task.
    """
    n = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).where(F.col("n") > most)
    left = stored(n.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("rank"), F.floor((F.col("n") + k) / 2).alias("at")) for k in (1, 2)])), "n", "lo", "hi"), "median")
    done: list[DataFrame] = []
    while True:
        few = (F.col("n") <= most) | (F.col("lo") == F.col("hi"))
        done.append(left.where(few))
        todo = left.where(~few)
        if todo.isEmpty():
            break
        at = joined(values, todo, by, "inner").where("_d between lo and hi")
        end = lambda c: F.greatest(F.least(c, F.lit(1e308)), F.lit(-1e308)) / 2
        share = F.when(F.col("_d") >= F.col("hi"), 1.0).otherwise((end(F.col("_d")) - end(F.col("lo"))) / (end(F.col("hi")) - end(F.col("lo"))))
        bins = at.groupBy(*by, "rank", "at", F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
        w = Window.partitionBy(*by, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("before", F.sum("n").over(w) - F.col("n")).where("at > before and at <= before + n")
        left = stored(bins.select(*by, "rank", (F.col("at") - F.col("before")).alias("at"), "n", "lo", "hi"), "median")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_median(df: DataFrame, by: list[str], value: Column, name: str = "median", most: int | None = EXACT) -> DataFrame:
    """Each group's median of the known values, exact: the mean of the two middle ones.

    A group of up to `most` values is an aggregate of (value, count) pairs. In a larger one the middle ranks are first narrowed down to
    intervals of at most that many values, so no task holds the group. most None: groups are known to be small.
    """
    values = df.select(*by, value.cast("double").alias("_d")).where("_d is not null and not isnan(_d)")
    if most is None or not too_long(values, by, most):
        return values.groupBy(*by).agg(F.median("_d").alias(name))
    counts = values.groupBy(*by).agg(F.count("*").alias("_n"))
    small = joined(values, counts.where(F.col("_n") <= most), by, "inner").groupBy(*by).agg(F.median("_d").alias(name))
    spans = _narrowed(values, by, most)
    near = joined(values, spans.where("lo < hi"), by, "inner").where("_d between lo and hi")
    ranked = near.groupBy(*by, "rank", "at").agg(F.array_sort(F.collect_list("_d")).alias("vs"))
    found = ranked.select(*by, "rank", F.element_at("vs", F.col("at").cast("int")).alias("_d"))
    found = found.unionByName(spans.where("lo = hi").select(*by, "rank", F.col("lo").alias("_d")))
    return small.unionByName(found.groupBy(*by).agg(F.avg("_d").alias(name)))


def mad_keep(df: DataFrame, by: list[str], distance: str, times: float = 10.0, floor: float = 1e-3, most: int = EXACT) -> DataFrame:
    """Adds keep: whether a distance is at most `times` the median absolute deviation of its group's distances (at least `floor`).

    The limit holds for the distance itself, not for how far it lies from their median. Medians are exact (see exact_median) and
    come back as small rows.
    """
    back = lambda small: joined(df, small, by) if by else df.join(F.broadcast(small))
    most = most if too_long(df, by, most) else None
    mid = exact_median(df, by, F.col(distance), "_mid", most)
    dev = exact_median(back(mid), by, F.abs(F.col(distance) - F.col("_mid")), "_mad", most)
    return back(dev).withColumn("keep", F.col(distance) <= times * F.greatest(F.col("_mad"), F.lit(floor))).drop("_mad")


def outliers_blanked(df: DataFrame, by: list[str], order: str, coords: list[str], width: int = 21, times: float = 10.0, rows: int = ROWS, most: int = EXACT) -> DataFrame:
    """Adds outlier, and nulls the coordinates of points far from the sliding median of their neighbours.

    The distances are stored before their medians are taken, so they are worked out once.
    """
    out = sliding_medians(df.where(F.col(coords[0]).isNotNull()), by, order, {c: f"_m_{c}" for c in coords}, width, rows)
    d = F.sqrt(sum(((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in coords[1:]), (F.col(coords[0]) - F.col(f"_m_{coords[0]}")) ** 2))
    far = stored(out.select(*df.columns, d.alias("_d")), "distances")
    out = mad_keep(far, by, "_d", times, most=most).withColumn("outlier", ~F.col("keep"))
    seen = out.select(*df.columns, "outlier").withColumns({c: F.when(~F.col("outlier"), F.col(c)) for c in coords})
    return seen.unionByName(df.where(F.col(coords[0]).isNull()).withColumn("outlier", F.lit(False)))


def gaps_filled(df: DataFrame, by: list[str], order: str, value: str, rows: int = ROWS) -> DataFrame:
    """Nulls get the value on the line between their neighbours in `order`; at the ends the nearest value."""
    if too_long(df, by, rows):
        known = df.where(F.col(value).isNotNull())
        at = bracketed(df.where(F.col(value).isNull()).withColumn("_t", F.col(order)), known.select(*by, F.col(order).alias("_t"), F.col(value).alias("_v")), "_t", by, rows)
        line = F.col("_p._v") + between("_t") * (F.col("_n._v") - F.col("_p._v"))
        return known.unionByName(at.withColumn(value, F.coalesce(line, "_p._v", "_n._v")).select(*df.columns))
    w = _w(by, order)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    df = df.withColumn("_p", F.last(pair, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(pair, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    f = (F.col(order) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    line = F.col("_p.v") + f * (F.col("_n.v") - F.col("_p.v"))
    return df.withColumn(value, F.coalesce(F.col(value), line, "_p.v", "_n.v")).drop("_p", "_n")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian_smooth(df: DataFrame, by: list[str], order: str, values: list[str], sigma: float, rows: int = ROWS) -> DataFrame:
    """Smooths along the rows of each series, which reflects at its ends (d c b a | a b c d | d c b a); sigma 0: as it is.

    Rows near an end are repeated at the places beyond it (as often as a short series needs); then each row's window holds
    the whole kernel. A null value has no weight: the weights of the known ones are scaled up to 1, and a window without any
    known value gives null.
    """
    if sigma <= 0:
        return df
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    near_rows = margined(df, by, order, r, rows)
    i, n = F.col("_place"), F.col("_size")
    turns = F.sequence(-F.floor((n + r) / (2 * n)) - 1, F.floor((n + r) / (2 * n)) + 1)
    places = F.flatten(F.transform(turns, lambda k: F.array(i + 2 * n * k, 2 * n * k - 1 - i)))
    spread = near_rows.withColumn("_j", F.explode(F.filter(places, lambda j: (j >= -r) & (j < n + r))))
    near = Window.partitionBy(*by, "_block").orderBy("_j").rowsBetween(-r, r)
    weights = F.array(*[F.lit(x) for x in kernel])

    def smoothed(v: str) -> Column:
        # one entry for each place, NaN for none
        held = F.collect_list(F.coalesce(F.col(v).cast("double"), F.lit(float("nan")))).over(near)
        total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        known = lambda x, w: F.when(F.isnan(x), 0.0).otherwise(w)
        whole = total(F.zip_with(held, weights, lambda x, w: x * w))
        rest = F.try_divide(total(F.zip_with(held, weights, lambda x, w: F.nanvl(x, F.lit(0.0)) * w)), total(F.zip_with(held, weights, known)))
        return F.when(F.isnan(whole), rest).otherwise(whole)

    out = spread.withColumns({v: smoothed(v) for v in values})
    return out.where("_j = _place and _own").select(*df.columns)


def rolling_any(df: DataFrame, by: list[str], order: str, flag: str, n: int = 4, rows: int = ROWS) -> DataFrame:
    """The flag of any of the last n rows, this one included; n 0 or 1 leaves it."""
    if n <= 1:
        return df
    w = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(-(n - 1), 0)
    return margined(df, by, order, n - 1, rows).withColumn(flag, F.bool_or(flag).over(w)).where("_own").select(*df.columns)


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str = "total", rows: int = ROWS) -> DataFrame:
    return running_sums(df, by, order, {name: F.col(value)}, rows)


def since_first(df: DataFrame, by: list[str], order: str, name: str = "elapsed") -> DataFrame:
    """Adds the time since the series' first row, which is an aggregate joined back."""
    first = df.groupBy(*by).agg(F.min(order).alias("_first"))
    return joined(df, first, by).withColumn(name, F.col(order) - F.col("_first")).drop("_first")


#: Shorter moves have no direction.
STILL = 1e-8


def heading_change(df: DataFrame, by: list[str], order: str, x: str, y: str, lag: int, rows: int = ROWS) -> DataFrame:
    """Adds turn: degrees, 0 to 180, between the directions from `lag` rows before and to `lag` rows after, ends held.

    0 where one of the two has no direction: at the first and last row, and where the walker stands still.
    """
    out = margined(df, by, order, lag, rows)
    w = Window.partitionBy(*by, "_block").orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c, a in ((x, "_x"), (y, "_y")):
        out = out.withColumns({f"{a}b": F.col(c) - F.coalesce(F.lag(c, lag).over(w), F.first(c).over(every)), f"{a}f": F.coalesce(F.lead(c, lag).over(w), F.last(c).over(every)) - F.col(c)})
    turn = F.abs(F.pmod(F.degrees(F.atan2("_yf", "_xf") - F.atan2("_yb", "_xb")) + 180, F.lit(360.0)) - 180)
    moves = (F.hypot("_xb", "_yb") > STILL) & (F.hypot("_xf", "_yf") > STILL)
    return out.where("_own").withColumn("turn", F.when(moves, turn).otherwise(0.0)).select(*df.columns, "turn")


def peaks(df: DataFrame, by: list[str], order: str, value: str, least: float, apart: int, rows: int = ROWS) -> DataFrame:
    """Rows (by, order, value) of the first maximum of each run at or above `least`, at least `apart` rows after the last taken.

    The first row counts as a taken one, so it is no peak itself and an early peak is passed over. Which peaks are taken in turn is found by
    pointers: each peak points to the first one far enough behind it, and the pointers' lengths double each round, from the
    first row on, so a series with n peaks takes log2(n) joins and no task holds its peaks.
    """
    placed = row_numbers(df, by, order, "_i", rows)
    runs = islands(placed.withColumn("_over", F.coalesce(F.col(value) >= least, F.lit(False)) & (F.col("_i") > 0)), by, order, "_over", "_run", rows).where("_over")
    top = runs.groupBy(*by, "_run").agg(F.max_by(F.struct("_i", order, value), F.struct(value, -F.col("_i"))).alias("p"))
    known = stored(top.select(*by, "p.*"), "peaks")
    steps = known.select(*by, "_i").unionByName(known.select(*by).distinct().withColumn("_i", F.lit(0).cast("long")))
    keys = [f"_b{k}" for k in range(len(by))]
    named = [F.coalesce(F.to_json(F.struct(b)), F.lit("")).alias(k) for b, k in zip(by, keys, strict=True)]  # no null keys, for the as-of join
    places = steps.select(*named, "_i")
    onward = asof_join(places.withColumn("_from", F.col("_i") + apart), places.where("_i > 0").select(*keys, F.col("_i").alias("_from"), F.col("_i").alias("to")), "_from", keys, direction="forward", rows=rows)
    jump = stored(onward.where("r_to is not null").select(*keys, F.col("_i").alias("at"), F.col("r_to").alias("to")), "peaks")
    taken = stored(places.where("_i = 0").select(*keys, F.col("_i").alias("at")), "peaks")
    while True:
        more = taken.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        grown = stored(taken.unionByName(more).distinct(), "peaks")
        drop_stored(taken)
        taken = grown
        far = jump.alias("a").join(jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to")), [*keys, "to"]).select(*keys, "at", F.col("_to").alias("to"))
        further = stored(far, "peaks")
        drop_stored(jump)
        jump = further
        if jump.isEmpty():
            break
    drop_stored(jump)
    marked = known.withColumns(dict(zip(keys, [F.coalesce(F.to_json(F.struct(b)), F.lit("")) for b in by], strict=True)))
    return marked.join(taken.withColumnRenamed("at", "_i"), [*keys, "_i"], "left_semi").drop(*keys, "_i")


def segment_labels(df: DataFrame, breaks: DataFrame, by: list[str], order: str, rows: int = ROWS) -> DataFrame:
    """Adds segment: how many breaks lie at or before each row."""
    marks = breaks.select(*by, order, F.lit(1).cast("long").alias("_b"))
    out = joined(df, marks, [*by, order])
    return running_sums(out, by, order, {"segment": F.coalesce("_b", F.lit(0))}, rows).drop("_b")


def adaptive_width(residual: Column, mean: Column, std: Column, widest: int, narrowest: int, k: float = 1.5) -> Column:
    """The width for a residual: widest at the mean or below, narrowest from k deviations above it; halves go to even."""
    share = F.least(F.greatest((residual - mean) / (k * std + 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.bround(widest - share * (widest - narrowest)).cast("int")
