"""The queries of this package, by name: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from poseframe.llm import byte_bpe, chat, decontamination, html_text, jaccard_join, mixing, pii, prefix_trie, quality, sort_means, suffix_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(_table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_hits", "item_windows", "changed")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.long_repeats_removed(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.clustered(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_ngram_jaccard_join, op2_mixing, op3_chat_formatting, op4_quality_rules, op5_benchmark_decontamination,
    op6_pii, op7_toxicity, op8_suffix_array_dedup, op9_url_filters, op10_html_extraction, op11_prefix_trie, op12_byte_bpe,
    op13_sort_means,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: Where SQL can express a query; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_chat_formatting": chat.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_benchmark_decontamination": decontamination.SQL,
    "op9_url_filters": url_filter.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_sort_means": sort_means.SQL,
}
