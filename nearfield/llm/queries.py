"""The operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import (
    bpe_codec,
    chat_windows,
    decontaminate,
    fingerprints,
    language_id,
    line_templates,
    secret_scan,
    simhash,
    suffix_dedup,
    token_counts,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op3_longest_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.longest_extensions(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows.bpe_chat_windows(table(spark, sf_dir, "conversations"))


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.dedup_lines(table(spark, sf_dir, "documents"), keep_emptied=True)
    return kept.selectExpr("doc_id", "text", "nf_lines AS n_lines", "nf_dropped AS n_dropped")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op3_longest_extensions": op3_longest_extensions,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_bpe_encoding": op8_bpe_encoding,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op3_document_fingerprints": fingerprints.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
}
