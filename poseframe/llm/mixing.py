"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys form a random order; the prefix sums of sizes along it
say where the source's exact budget ends. The order is cut into ranges of the key first: sizes are summed inside a range
and the sums of earlier ranges are added, so a source of any size spreads over all tasks. Budgets beyond a source's size
repeat whole epochs and cut the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.llm.common import WORDS, stored

#: Fixed values of the mix: weights of the sources in order, repeating, and the most epochs.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Documents for which a source gets 16 times as many ranges of the key, 16 ** LEAST_DIGITS at least: so a range stays small.
RANGE_ROWS, LEAST_DIGITS = 20_000, 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def range_digits(n: int) -> int:
    """Hexadecimal digits of the key that make ranges of RANGE_ROWS documents at most, if one source holds all n."""
    digits = LEAST_DIGITS
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, none above EPOCHS sizes, the rest reshared.

    Filling from the source that reaches its limit first, every other source gets its weight times one level; the level
    is what is left after the full ones, by the weight that is left. This needs only running sums over the sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("weight", F.get(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * float(EPOCHS)).withColumn("full_at", F.col("limit") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("limits", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(every) - F.col("limits")) / F.col("weights")
    s = s.withColumn("first", F.min(F.when(level <= F.col("full_at"), F.struct("full_at", level.alias("level")))).over(every))
    return s.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.coalesce("first.level", F.lit(0.0))).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    A null or blank text has size 0 and takes nothing; a null source is a source, the last one. A document without a doc_id
    has the key of its text. Ties of the key go by doc_id (null first) and size; rows that repeat each other are taken one after the other. An empty table gives an
    empty result. Other columns are ignored.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    key = F.md5(F.concat(F.lit(SEED + ":"), own))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("key"))
    rows = stored(rows, "mix-sizes")
    rows = rows.withColumn("part", F.substring("key", 1, range_digits(rows.count())))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    # one row for each range of a source
    along = Window.partitionBy("source").orderBy("part")
    sums = sums.select("source", "part", F.coalesce(F.sum("part_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), "part_size")
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    parts = sums.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "earlier", "source_size", "target")
    joined = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("earlier") - F.col("before")))
    return joined.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS lim FROM s),
f AS (SELECT *, lim / weight AS full_at FROM w),
g AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limits,
             sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
             sum(source_size) OVER ()::DOUBLE AS total FROM f),
h AS (SELECT (total - limits) / weights AS level FROM g WHERE (total - limits) / weights <= full_at ORDER BY full_at, level LIMIT 1),
t AS (SELECT source, source_size, least(lim, weight * coalesce((SELECT level FROM h), 0)) AS target FROM g),
b AS (SELECT source, source_size, target, round(target)::BIGINT AS budget FROM t),
o AS (SELECT d.doc_id, d.size, d.source, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT o.doc_id, o.size, b.source_size, b.target,
       CASE WHEN b.source_size > 0 THEN (b.budget // b.source_size) * o.size
            + greatest(0, least(o.size, b.budget % b.source_size - o.before)) ELSE 0 END::BIGINT AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source
"""
