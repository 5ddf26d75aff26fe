"""A corpus from raw documents to packed sequences, stage by stage.

Each stage reads all that its predecessor kept and calls one operator; every
stage but the last returns the columns of ``documents``.  A stage's input must have been written (as :func:`run` does)
or cached before the next stage is called, which deletes what the stage wrote on its way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from oakmill.llm import common, exactdedup, mixing, packing, quality, simhash


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """``f``, which first deletes what earlier stages have written on their way, unless its input still reads from it."""

    @wraps(f)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, [docs], "pipeline")
        with common.owned("pipeline"):
            return f(spark, docs, sf_dir)

    return run_one


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return exactdedup.keep_one(docs)


@stage
def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return simhash.keep_one(docs, size=5, similarity=0.8)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("exact dedup", distinct),
    ("near dedup", unlike),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier's fit and the packing can't be put into SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        old, docs = docs, common.cut_lineage(f(spark, docs, sf_dir), name.replace(" ", "-"))
        common.drop(spark, old)  # a stage's output, once the next one is written
    common.release(spark, [docs], "pipeline")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
