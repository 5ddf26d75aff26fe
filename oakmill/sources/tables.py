"""Columnar tables: parquet folders, clustered and with Bloom filters where asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import UnknownColumn

#: Rows of a micro-partition.
PARTITION_ROWS = 100
#: Files that a task writes, about, where files are rolled over.
FILES_A_TASK = 500


def rows(spark: SparkSession, values: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """Rows with a schema; a row of the wrong length or type raises."""
    return spark.createDataFrame([tuple(v) for v in values], schema)


def write(
    df: DataFrame, path: str, mode: str = "overwrite", cluster_by: str | None = None, partitions: int | None = None,
    bloom: Sequence[str] = (), rows_per_file: int | None = None,
) -> None:
    """Write a table.  ``cluster_by`` gives files disjoint ranges of the column, so that footer statistics prune.

    ``rows_per_file``: files are rolled over at that many rows; ranges are as many as their files need tasks, however few bytes they have, and tasks
    move their files into place themselves, as the driver would do it one by one.
    """
    need(df, [*([cluster_by] if cluster_by else []), *bloom])
    if cluster_by:
        if rows_per_file and not partitions:
            partitions = max(1, math.ceil(df.count() / (rows_per_file * FILES_A_TASK)))
        df = clustered(df, cluster_by, partitions)
    writer = df.write.mode(mode)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.parquet(path)


def clustered(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ``column`` and sorted in each."""
    dealt = df.repartitionByRange(partitions, column) if partitions else df.repartitionByRange(column)
    return dealt.sortWithinPartitions(column)


def need(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise for columns that ``df`` lacks."""
    have = {c.lower() for c in df.columns}
    if lost := [c for c in columns if c.lower() not in have]:
        raise UnknownColumn(f"no column {', '.join(lost)}")
