"""A corpus from documents: filtered, deduplicated, decontaminated, mixed to weights and written as token ids.

Every stage is one operator of ``millrace.llm``, works on all that its predecessor kept, and hands on the columns of
``documents``; the last returns a digest of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard, mixing, quality, tokens
from millrace.llm.common import materialize, release_shuffles


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of n-gram Jaccard links stays."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    return tokens.write_and_read(docs)


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark_decontamination),
    ("mix", source_mix),
    ("tokens", token_files),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        release_shuffles(spark)
    return docs
