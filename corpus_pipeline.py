"""Corpus preparation: five stages over documents, each written and read again by whoever runs them one by one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Encoding BPE is the last, so no SQL expresses the result; tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import bpe_codec, decontaminate, language_id, line_templates, simhash
from nearfield.llm.textscan import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no known language explains, and empty ones. The model is fitted on a bounded
    labelled sample of the documents themselves (language_id.TRAIN_DOCS a language)."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of templates that a smaller document has, and documents of which nothing is left."""
    return line_templates.dedup_lines(docs).drop("nf_lines", "nf_dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near copies."""
    return simhash.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip)."""
    return bpe_codec.encode_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_recurring_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("BPE encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each result but the last is written to the shared folder, so that no stage is
    computed again where the next one reads its documents twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
