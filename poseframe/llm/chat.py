"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation again after each turn. A rolling hash names every prefix of turns; a conversation whose
name is a proper prefix of another one is dropped by an anti-join, equal ones keep one, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poseframe.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NO_ROLE = "unknown"


def _rolling(seed: int, w: Window) -> Column:
    """A hash of the turns so far: places differ, so the exclusive or of hashes of (place, role, text) names the list.

    The seed comes first, so that hashes of two seeds are of different states from the first byte on.
    """
    return F.bit_xor(F.xxhash64(F.lit(seed), "place", "role", "text")).over(w)


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text), in the order of turn (null first), role and text; equal rows count once."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    this = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.lag(this).over(w).eqNullSafe(this)).where("not again")
    return rows.withColumn("place", F.row_number().over(w))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, h1, h2, last): the rolling hashes, 128 bits in all; stored."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    named = turns(conversations).select("conv_id", "place", _rolling(1, sofar).alias("h1"), _rolling(2, sofar).alias("h2"), F.lead("place").over(w).isNull().alias("last"))
    return stored(named, "chat-prefixes")


def maximal(names: DataFrame) -> DataFrame:
    """Of prefixes(): conv_id, n_turns and n_logged (equal logs) of the conversations that are no other's proper prefix.

    Of equal ones the smallest conv_id stays, a null one only if it is alone.
    """
    proper = names.where("not last").select("place", "h1", "h2").distinct()
    whole = names.where("last").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    left = whole.join(proper, ["place", "h1", "h2"], "left_anti")
    return left.select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_logged")


def rendered(conversations: DataFrame) -> DataFrame:
    """Per maximal conversation: conv_id, n_turns, n_logged, text.

    Turns stand in order, each as <|im_start|>role, a new line, its text and <|im_end|>. A null role is `unknown`, a null
    text is empty; rows without a conv_id are one conversation. Equal rows count once. Other columns are ignored; an
    empty table gives an empty result.
    """
    best = maximal(prefixes(conversations)).withColumnRenamed("conv_id", "c_id")
    rows = turns(conversations)
    joined = rows.join(best, F.col("conv_id").eqNullSafe(F.col("c_id")))
    line = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE))
    whole = joined.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return whole.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


SQL = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM r GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_logged, t FROM c GROUP BY t),
p AS (SELECT DISTINCT t[1 : i] AS t FROM (SELECT t, unnest(range(1, len(t))) AS i FROM u))
SELECT conv_id, len(t) AS n_turns, n_logged,
       array_to_string([concat('<|im_start|>', x.role, chr(10), x.text, '<|im_end|>') FOR x IN t], chr(10)) AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = u.t)
"""
