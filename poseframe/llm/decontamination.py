"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers and capitalised words become typed placeholders, in documents and benchmark items alike, so
that a question asked again with other values keeps its template. Windows of WINDOW template words are hash-joined. What
the placeholders stood for is compared along each alignment of a document and an item: where values differ, one value of
the item must always have become the same value, else those windows are a coincidence of templates and do not count. Short
items, and items that are nearly all placeholders, are found by their words as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poseframe.llm.common import stored

WINDOW = 8
#: A window of a benchmark item's template has this many words that aren't placeholders.
LITERALS = 5
#: Items of under WINDOW words are found inside other texts from so many words on.
SHORT = 4
#: A document leaks an item if it has this share of the item's windows, or so many of them.
SHARE, ENOUGH = 0.5, 6
#: Windows of the benchmark that are broadcast at most; a larger benchmark is joined by shuffling.
BROADCAST_ROWS = 100_000
#: Units of measure that count as such after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "ml", "cl", "l", "s", "ms", "min", "h", "hours", "minutes",
    "seconds", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent",
    "degrees", "liters", "litres", "grams", "kilograms", "kilometers", "kilometres", "mph", "kmh", "w", "kw", "v", "a", "hz",
)
BREAKS = r"[^\p{L}\p{N}]+"
NUMBER, UNIT, NAME = "0", "U", "N"
_SEP = "\u0001"


def _templates(df: DataFrame, text: str) -> DataFrame:
    """Adds words (as written), tokens (their templates) and n."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS), lambda w: w != "")
    df = df.withColumn("words", words)
    digit = lambda w: F.coalesce(F.substring(w, 1, 1).between("0", "9"), F.lit(False))

    def token(w: Column, i: Column) -> Column:
        first = F.substring(w, 1, 1)
        return (
            F.when(digit(w), F.lit(NUMBER))
            .when(F.lower(first) != first, F.lit(NAME))
            .when(w.isin(*UNITS) & digit(F.get("words", i - 1)), F.lit(UNIT))
            .otherwise(F.lower(w))
        )

    return df.withColumn("tokens", F.transform("words", token)).withColumn("n", F.size("words"))


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, UNIT, NAME)


#: Kinds of windows: templates; words as they are but for case; whole texts of few words.
TEMPLATE, EXACT, WHOLE = "t", "w", "x"


def _windows(df: DataFrame, keys: list[str], kinds: list[tuple[str, int]], counted: bool = False) -> DataFrame:
    """Rows (keys, at, h, slots) of the windows of some kinds and widths: place, hash, what its placeholders stood for.

    A window of a kind other than templates has no placeholders. counted adds kind, width and n_slots, which only the
    benchmark's windows need.
    """
    df = df.withColumn("filled", F.zip_with("tokens", "words", lambda t, w: F.when(_is_slot(t), w)))
    if any(kind != TEMPLATE for kind, _ in kinds):
        df = df.withColumn("low", F.transform("words", F.lower))

    def of(kind: str, width: int) -> Column:
        part = lambda name, i: F.slice(name, i + 1, width)

        def one(i: Column) -> Column:
            if kind == TEMPLATE:
                h, slots = F.xxhash64(part("tokens", i)), F.array_join(part("filled", i), _SEP)
            else:
                h, slots = F.xxhash64(F.lit(kind), part("low", i)), F.lit("")
            more = [F.lit(kind).alias("kind"), F.lit(width).alias("width"), F.size(F.filter(part("filled", i), lambda s: s.isNotNull())).alias("n_slots")]
            return F.struct(i.alias("at"), h.alias("h"), slots.alias("slots"), *(more if counted else []))

        fits = F.col("n") == width if kind == WHOLE else F.col("n") >= width
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.size("tokens") - width), one))

    every = [of(*k) for k in kinds]
    if len(every) > 1:
        every = [F.flatten(F.array_compact(F.array(*every)))]
    return df.where("n > 0").select(*keys, F.inline(every[0]))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Rows (h, kind, width, item_id, item_at, item_slots, item_windows); stored.

    Items have the windows of their templates that say enough; items without one have windows of their words, and so have
    items under WINDOW words, in one window of their own width. Items of under SHORT words are only met by whole texts.
    """
    base = _templates(benchmark.select("item_id", "text"), "text")
    rich = _windows(base, ["item_id"], [(TEMPLATE, WINDOW)], counted=True).where(F.col("width") - F.col("n_slots") >= LITERALS)
    plain = _windows(base.join(rich.select("item_id").distinct(), "item_id", "left_anti"), ["item_id"], [(EXACT, WINDOW)], counted=True)
    brief = [_windows(base.where(f"n = {n}"), ["item_id"], [(EXACT if n >= SHORT else WHOLE, n)], counted=True) for n in range(1, WINDOW)]
    w = rich.union(plain)
    for b in brief:
        w = w.union(b)
    total = w.groupBy("item_id").agg(F.countDistinct("kind", "width", "at").alias("item_windows"))
    return stored(w.join(total, "item_id").select("h", "kind", "width", "item_id", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "item_windows").distinct(), "bench-windows")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, item_id, n_hits, item_windows, changed) of documents that hold benchmark items.

    n_hits: windows of the item that the document has with the same slots, or with slots that changed alike along the
    alignment; changed: some of these have another value. Null and empty texts hold nothing and are held by nothing.
    Repeated rows are found once; text_key tells rows of one doc_id apart. A null item_id is left out; rows that repeat an
    item_id count as further texts of the item. Empty tables give an empty result. Other columns are ignored.
    """
    bench = benchmark_windows(benchmark.where("item_id is not null"))
    kinds = sorted((r["kind"], r["width"]) for r in bench.select("kind", "width").distinct().collect())  # WINDOW + 1 at most
    small = bench.count() <= BROADCAST_ROWS
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    of_docs = _windows(_templates(src, "text"), ["doc_id", "text_key"], kinds or [(TEMPLATE, WINDOW)]).select("doc_id", "text_key", "at", "h", "slots")
    met = of_docs.join(F.broadcast(bench) if small else bench, "h").distinct()
    met = stored(met.withColumn("shift", F.col("at") - F.col("item_at")), "bench-met")
    line = ["doc_id", "text_key", "item_id", "shift"]
    pairs = met.where("item_slots != ''").select(*line, F.explode(F.arrays_zip(F.split("item_slots", _SEP).alias("was"), F.split("slots", _SEP).alias("now"))).alias("p")).select(*line, "p.was", "p.now").distinct()
    per = pairs.groupBy(*line, "was").agg(F.count("*").alias("c"))
    lines = per.groupBy(*line).agg(F.max("c").alias("c")).select(*[F.col(c).alias(f"l_{c}") for c in line], "c")
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in line]
    good = met.join(lines, same, "left").where("slots = item_slots or c is null or c = 1")
    hits = good.groupBy("doc_id", "text_key", "item_id").agg(
        F.countDistinct("kind", "width", "item_at").alias("n_hits"), F.max("item_windows").alias("item_windows"), F.max(F.col("slots") != F.col("item_slots")).alias("changed")
    )
    return hits.where((F.col("n_hits") >= ENOUGH) | (F.col("n_hits") >= SHARE * F.col("item_windows")))


def contaminated_removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    found = stored(leaks(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "bench-found")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_k"]), "left_anti")


_TEMPLATE_SQL = """
  SELECT {keys}, words, list_transform(words, lambda w, i: CASE WHEN w[1] BETWEEN '0' AND '9' THEN '0' WHEN lower(w[1]) != w[1] THEN 'N'
      WHEN list_contains([{units}], w) AND i > 1 AND words[i - 1][1] BETWEEN '0' AND '9' THEN 'U' ELSE lower(w) END) AS tokens
  FROM (SELECT {keys}, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '') AS words FROM {table})
  WHERE len(words) > 0"""


_SLOTS_SQL = "list_filter(list_transform(tokens[i + 1 : i + width], lambda t, j: CASE WHEN t IN ('0', 'U', 'N') THEN words[i + j] END), lambda x: x IS NOT NULL)"
_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
_LOW_SQL = "array_to_string(list_transform(words[i + 1 : i + width], lambda w: lower(w)), ' ')"
SQL = f"""
WITH bt AS ({_TEMPLATE_SQL.format(keys="item_id", table="benchmark", units=_UNITS_SQL)}),
dt AS ({_TEMPLATE_SQL.format(keys="doc_id", table="documents", units=_UNITS_SQL)}),
t8 AS (SELECT *, 't' AS kind, 8 AS width, unnest(range(0, len(tokens) - 7)) AS i FROM bt),
br AS (SELECT item_id, kind, width, i, array_to_string(tokens[i + 1 : i + width], ' ') AS h, {_SLOTS_SQL} AS slots FROM t8),
rich AS (SELECT * FROM br WHERE 8 - len(slots) >= 5),
w8 AS (SELECT *, 'w' AS kind, 8 AS width, unnest(range(0, len(tokens) - 7)) AS i FROM bt WHERE item_id NOT IN (SELECT item_id FROM rich)),
sh AS (SELECT *, CASE WHEN len(tokens) >= 4 THEN 'w' ELSE 'x' END AS kind, len(tokens)::INT AS width, 0::BIGINT AS i FROM bt WHERE len(tokens) < 8),
bs AS (SELECT * FROM rich UNION ALL SELECT item_id, kind, width, i, {_LOW_SQL} AS h, [] AS slots FROM (SELECT * FROM w8 UNION ALL SELECT * FROM sh)),
b AS (SELECT bs.*, item_windows FROM bs JOIN (SELECT item_id, count(DISTINCT (kind, width, i)) AS item_windows FROM bs GROUP BY item_id) USING (item_id)),
dk AS (SELECT dt.*, k.kind, k.width, unnest(range(0, len(tokens) - k.width + 1)) AS i FROM dt, (SELECT DISTINCT kind, width FROM b) k WHERE k.kind != 'x' OR len(tokens) = k.width),
dw AS (SELECT doc_id, kind, width, i, CASE WHEN kind = 't' THEN array_to_string(tokens[i + 1 : i + width], ' ') ELSE {_LOW_SQL} END AS h,
       CASE WHEN kind = 't' THEN {_SLOTS_SQL} ELSE [] END AS slots FROM dk),
m AS (SELECT dw.doc_id, b.item_id, (b.kind, b.width, b.i) AS item_at, dw.i - b.i AS shift, b.slots AS was, dw.slots AS now, b.item_windows
      FROM dw JOIN b ON dw.h = b.h AND dw.kind = b.kind AND dw.width = b.width),
p AS (SELECT DISTINCT doc_id, item_id, shift, unnest(was) AS was, unnest(now) AS now FROM m),
q AS (SELECT doc_id, item_id, shift, max(c) AS c FROM (SELECT doc_id, item_id, shift, was, count(*) AS c FROM p GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, count(DISTINCT item_at) AS n_hits, max(item_windows) AS item_windows, coalesce(bool_or(was != now), false) AS changed
FROM m LEFT JOIN q USING (doc_id, item_id, shift) WHERE was = now OR c IS NULL OR c = 1
GROUP BY doc_id, item_id HAVING count(DISTINCT item_at) >= 6 OR count(DISTINCT item_at) >= 0.5 * max(item_windows)
"""
