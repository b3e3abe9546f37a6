"""Queries of the text operators: each applies one operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import byte_bpe, collocations, compression_rules, decontamination, jaccard_join, language_id, licenses, piece_bpe, quality_model, ranked_search, run_length_dedup, secrets, surrogates
from fieldbook.llm.common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_dedup.report(read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(read_table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key for the tables of tests; set one's own in the session for other texts
    key = spark.conf.get("fieldbook.surrogates.key", "no secret: tables of tests")
    return surrogates.report(read_table(spark, sf_dir, "documents"), key.encode())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.judge(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(read_table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_bpe.digests(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_model": op2_quality_model,
    "op3_run_length_dedup": op3_run_length_dedup,
    "op4_licenses": op4_licenses,
    "op5_language_id": op5_language_id,
    "op6_surrogates": op6_surrogates,
    "op7_secrets": op7_secrets,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_compression_rules": op9_compression_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_collocations": op12_collocations,
    "op13_piece_bpe": op13_piece_bpe,
}
