"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from closurelens.llm import (conversation_repair, decontaminate, hidden_markov, html_extract, lexical_search, mixing,
                              ngram_join, pii, secrets_ledger, substring_dedup, toxicity, va_search, warc)
from closurelens.llm.common import table


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_ledger.scan(table(spark, sf_dir, "documents"), secrets_ledger.new_ledger(spark))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.language_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_pii": op3_pii,
    "op6_mixing": op6_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op7_warc": op7_warc,
    "op9_exact_top_k": op9_exact_top_k,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op3_pii": pii.oracle(),
    "op4_secret_scan": secrets_ledger.oracle(),
    "op7_warc": warc.oracle(),
    "op9_exact_top_k": va_search.oracle(),
    "op12_conversation_repair": conversation_repair.oracle(),
    "op13_ranked_search": lexical_search.oracle(),
}
