"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that its predecessor kept, and its rows are the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.exact_dedup import exact_dedup_rows
from codeloom.llm.mixing import mix_rows
from codeloom.llm.near_dedup import near_dedup_rows
from codeloom.llm.packing import pack
from codeloom.llm.queries import VOCABULARY
from codeloom.llm.shared import written
from codeloom.llm.toxicity import toxicity_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic."""
    return toxicity_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id."""
    return near_dedup_rows(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, VOCABULARY)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
#: The toxicity model is trained, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage over all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
