"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last keep all columns of what they read; the last gives token ids. Null texts pass the filters (they are neither toxic, nor leaks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkstrata.llm import bagminhash, common, decontam, pieces, secrets, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the least id."""
    return bagminhash.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redacted(docs)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encoded(docs)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination), ("secrets", _secrets), ("pieces", _pieces)]

#: Learned weights, alignments and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
