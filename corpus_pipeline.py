"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Every stage works on all documents that the stages before it kept.  All but the last
return the columns of `documents`; the last adds what encoding found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.bpe import bpe_digests, vocabulary
from airloom.llm.decontaminate import decontaminated
from airloom.llm.ngram_join import representatives
from airloom.llm.span_dedup import span_dedup
from airloom.llm.toxicity import nontoxic
from airloom.sources.scratch import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return nontoxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans of 20 words or more go; the first copy stays."""
    return span_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each text, and the digests of its ids and of what they decode to."""
    return bpe_digests(docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit("")))), *vocabulary(), keep=("lang", "source", "n_chars"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: The models and the tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
