"""Registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perigon.llm import chat, decontamination, fingerprints, lexical_search, mixing, near_dedup, quality_rules, sharding, substrings, tokens, toxicity, warc, whitening
from perigon.llm.common import spread, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spread(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(spark, table(spark, sf_dir, "documents"), percent=85)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.report(spark, spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(spark, spread(table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_chat_windows": op5_chat_windows,
    "op6_decontamination": op6_decontamination,
    "op7_source_mix": op7_source_mix,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_lexical_search": op11_lexical_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op8_histogram_shards": sharding.ORACLE,
    "op9_near_duplicates": near_dedup.ORACLE,
    "op10_repeated_substrings": substrings.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE,
}
