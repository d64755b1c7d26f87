"""Corpus pipeline: toxicity, exact deduplication, near-duplicate join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last
return the columns of ``documents``, whatever other columns there are and however they are called.  Null,
blank and very long texts, repeated rows, null ids and empty tables are defined for each stage below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramspark.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from engramspark.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic.  Null and blank texts stay, repeated rows stay or go together; without labels of both classes all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the smallest id; one row of repeats; all rows of a group without ids."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id (all rows that share it); rows without words stay."""
    return ngram_join.thin(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by their kind, null stays null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: null and blank texts have the end alone; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("secret_scans", redact_secrets), ("packing", pack)]

#: SQL can express neither the trained toxicity scores nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
