"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that failed;
policies are versioned sets of rules that are applied to the bits later, and ablations are counts over the bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT = 5

#: Rules by bit: name and the condition of failing, over the measurements. Counts only, so that no division can fail.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "2 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
]
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(name for name, _ in RULES)}


def mask_of(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _code_points_less(text: Column, gone: str) -> Column:
    return F.length(F.translate(text, gone, ""))


def ledger(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed (bits).

    A null text has no words. Rows that repeat a doc_id are rows of their own. Other columns are ignored, and an empty
    table gives an empty result. No shuffle: a document's windows of five words are hashed, and sorted only if some
    repeat, so a text of n words costs n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        _code_points_less(F.col("text"), " \t\n\x0b\f\r").alias("word_chars"),
        (F.length("text") - _code_points_less(F.col("text"), SYMBOLS)).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    at = lambda i: [F.get("words", i + j) for j in range(REPEAT)]
    places = F.sequence(F.lit(0), F.size("words") - REPEAT)
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= REPEAT, F.transform(places, lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<long>")).alias("windows"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*kept, F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("order"))
    like = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    near = F.transform("order", lambda x, j: F.when(like(x, F.get("order", j - 1)) | like(x, F.get("order", j + 1)), x["i"]))
    rows = rows.select(*kept, F.array_sort(F.array_compact(near)).alias("found"))
    cover = F.transform("found", lambda p, j: F.least(F.lit(REPEAT), F.coalesce(F.get("found", j + 1) - p, F.lit(REPEAT))))
    rows = rows.select(*kept, F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    return rows.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether none of a policy's rules failed."""
    bits = F.col("failed") if failed is None else failed
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rejected (documents that fail it), alone (that only it rejects), kept_without (kept if it is dropped).

    The ledger comes down to one row for each combination of bits; the rest is arithmetic on these.
    """
    mask = mask_of(policy)
    combos = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]])
    rows = combos.select("bits", "n", F.inline(rules))
    where = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    left = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return rows.groupBy("rule").agg(where(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("rejected"), where(F.col("bits") == F.col("bit")).alias("alone"), where(left == 0).alias("kept_without"))


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """Per document: the measurements, base_failed, kept, and the bits."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failed"
    )


SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM a),
h AS (SELECT *, CASE WHEN len(words) >= 5 THEN [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)] ELSE [] END AS windows FROM w),
o AS (SELECT row_number() OVER () AS r, * FROM h),
u AS (SELECT r, unnest(windows) AS win, unnest(range(0, len(windows))) AS i FROM o),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM u),
e AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM d WHERE c > 1),
s AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM e GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM o LEFT JOIN s USING (r)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
        + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 != 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
