"""From documents to token ids: five stages, each a pass of one operator over what the last kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each one's rows to
the shared folder and reads them again, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.lineage import materialize
from arborinfo.llm import decontamination, jaccard_join, language_mixture, lattice, pii
from arborinfo.llm.pieces import tokenizer


def counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs``; n_chars follows a text that has changed."""
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return docs.select(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be said: those without letters. Mixtures stay."""
    return language_mixture.reject_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts the shorter passages out of the others."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return counted(decontamination.decontaminate(docs, benchmark), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return counted(pii.redact(docs), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best segmentation of each document, the next ones as edits, and whether it decodes again."""
    return lattice.encode(docs, tokenizer(), n=3).drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Models, hashes and lattices have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
