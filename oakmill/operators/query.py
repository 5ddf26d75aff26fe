"""Scans, filters, aggregates and grouped aggregates over one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import files
from ..sources.tables import need


def select(df: DataFrame, filter_col: str | None = None, value: object = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose ``filter_col`` equals ``value`` (no filter if either is None), with ``columns`` (all if None)."""
    need(df, [*([filter_col] if filter_col else []), *(columns or [])])
    if filter_col is not None and value is not None:
        df = df.where(F.col(filter_col) == F.lit(value))
    return df.select(*columns) if columns else df


def column_scan(df: DataFrame, column: str) -> DataFrame:
    need(df, [column])
    return df.select(column)


#: Rows up to which a range is taken as a top-k, in one task.
TOP_ROWS = 1_000_000


def row_range(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows ``start`` (included) to ``end`` (excluded) by ``order``, counted from 0; an ``end`` past the last row is the last row's.

    Up to ``TOP_ROWS`` rows the first ``end`` ones are a top-k.  Beyond, rows are sorted by ranges and written; a
    partition's first number is the sum of the counts before it, and only the partitions that meet the range are read.
    """
    start, end = max(0, start), max(0, end)
    if end <= TOP_ROWS:
        first = df.orderBy(order).limit(end)
        return first.orderBy(order).offset(start) if start else first
    spark, path = df.sparkSession, files.new_folder(df.sparkSession, "sorted")
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).select("*", at.alias("__at"))
    dealt.withColumn("__part", F.shiftright("__at", 33)).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # two numbers a partition
    firsts = dict(zip([r["__part"] for r in counts], accumulate([r.n for r in counts], initial=0), strict=False))
    met = [r["__part"] for r in counts if firsts[r["__part"]] < end and firsts[r["__part"]] + r.n > start]
    if not met:
        return df.where(F.lit(False))
    first = F.create_map(*[F.lit(x) for p in met for x in (p, firsts[p])])[F.col("__part")]
    number = first + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.where(F.col("__part").isin(met)).where((number >= start) & (number < end)).orderBy(order).drop("__at", "__part")


def range_scan(df: DataFrame, key: str, low: object, high: object) -> DataFrame:
    """Rows with ``low <= key <= high``, ascending."""
    need(df, [key])
    return df.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key."""
    need(df, [key])
    return df.where(F.col(key) == F.lit(value)).limit(1)


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """The number of rows for which ``predicate`` is true."""
    return df.agg(F.count_if(predicate).alias(name))


def aggregate(df: DataFrame, **named: Column) -> DataFrame:
    """One row of aggregates."""
    return df.agg(*[c.alias(n) for n, c in named.items()])


def group_by(df: DataFrame, key: str, **named: Column) -> DataFrame:
    """Aggregates by key; null is a group."""
    need(df, [key])
    return df.groupBy(key).agg(*[c.alias(n) for n, c in named.items()])


#: Types of values and results with which groups are taken from sorted batches: Arrow and Spark make the same pandas values of them.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType)


def group_apply(df: DataFrame, key: str, value: str, f: Callable[[pd.Series], object], name: str, kind: str) -> DataFrame:
    """``f`` of each group's whole list of values, nulls included.

    A group has to fit a task's memory: use :func:`group_by` wherever a built-in aggregate says the same.  Groups of plain values come in
    batches of sorted rows, as many small ones would cost a call of pandas and a batch each.
    """
    need(df, [key, value])
    key_type, value_type = df.schema[key].dataType, df.schema[value].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(name, T._parse_datatype_string(kind))])
    if not isinstance(value_type, PLAIN) or not isinstance(schema[name].dataType, PLAIN) or not isinstance(key_type, PLAIN):

        def one(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({key: g[key].iloc[:1].to_numpy(), name: [f(g[value])]})

        return df.select(key, value).groupBy(key).applyInPandas(one, schema)
    out = pa.schema([(key, to_arrow_type(key_type)), (name, to_arrow_type(schema[name].dataType))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # of the group that the next batch may go on with

        def results(batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
            values = batch.column(1)
            got = [f(values.slice(a, b - a).to_pandas().rename(value)) for a, b in pairwise(at)]
            keys = batch.column(0).take(pa.array(at[:-1], pa.int64()))
            return pa.RecordBatch.from_arrays([keys.cast(out.field(0).type), pa.Array.from_pandas(pd.Series(got, dtype=object), type=out.field(1).type)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            at = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            if parts and len(pa.concat_arrays([parts[-1].column(0).slice(0, 1), batch.column(0).slice(0, 1)]).dictionary_encode(null_encoding="encode").dictionary) > 1:
                own = pa.concat_batches(parts)
                parts = []
                yield results(own, [0, own.num_rows])
            if len(at) > 2:  # the first group ends here, the last one may go on
                if parts:
                    own = pa.concat_batches([*parts, batch.slice(0, at[1])])
                    yield results(own, [0, own.num_rows])
                    at = at[1:]
                if len(at) > 2:
                    yield results(batch, at[:-1])
                parts = []
            parts.append(batch.slice(at[-2]))
        if parts:
            own = pa.concat_batches(parts)
            yield results(own, [0, own.num_rows])

    own = F.col(f"`{key}`")
    if isinstance(key_type, (T.FloatType, T.DoubleType)):
        own = F.when(own == 0, F.lit(0.0).cast(key_type)).otherwise(own)  # -0.0 is 0.0's group
    dealt = df.select(own.alias("k"), F.col(f"`{value}`").alias("v")).repartition("k").sortWithinPartitions("k")
    return dealt.mapInArrow(rows, schema)
