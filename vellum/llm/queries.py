"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import arrow_tokens, chat, decontaminate, embeddings, lines, packing, quality, resample, simhash, substring, suffix, toxicity, variants
from vellum.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_query(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4_query(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op5_query(table(spark, sf_dir, "documents"))


def op6_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.op6_query(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.op7_query(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op8_query(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op9_query(table(spark, sf_dir, "documents"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op10_query(table(spark, sf_dir, "conversations"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.op11_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op12_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.op13_query(table(spark, sf_dir, "documents"))


OPERATORS = (op1_decontaminate, op2_simhash, op3_toxicity, op4_packing, op5_substring_dedup, op6_arrow_tokens, op7_embedding_dedup, op8_suffix_dedup, op9_line_dedup, op10_chat_windows, op11_importance_resampling, op12_quality, op13_spelling_variants)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """None of them can be stated in SQL at these sizes; tests hold them against brute force."""
    return {}
