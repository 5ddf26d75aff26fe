"""Tables whose partitions' ranges and Bloom filters are stored with the data, so that a lookup opens few files.

A table is a folder: ``data`` (parquet, range-clustered), ``zones`` (a row for each file and
micro-partition: rows, least and largest values) and, where asked for, ``blooms`` (a row for each zone and
word of 32,768 bits).  A lookup reads the zones, then the Bloom words of the zones that are
left, and then opens those files alone, with literal partition ids as filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pruning
from . import files, tables

#: Partition ids that are put into a filter as literals.
MOST_LITERALS = 1000


class ZonedTable:
    """A table at ``path`` with what is known of its files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.data = spark.read.parquet(f"{path}/data")
        self.zones = spark.read.parquet(f"{path}/zones")

    @classmethod
    def write(
        cls, df: DataFrame, path: str, cluster_by: str, zones: Sequence[str] = (), bloom: Sequence[str] = (),
        partition: Column | None = None, rows_per_file: int | None = None, rate: float = 0.01,
    ) -> ZonedTable:
        """Write ``df`` and its zones (of ``cluster_by`` and ``zones``) and Bloom filters.

        ``partition``: a micro-partition's number, else each file is one; it should follow ``cluster_by``.
        ``rows_per_file``: a file is rolled over at that many rows.
        """
        spark = df.sparkSession
        tables.need(df, [cluster_by, *zones, *bloom])
        df = df.withColumn("__partition", (partition if partition is not None else F.lit(0)).cast("long"))
        by = cluster_by if partition is None else "__partition"  # a micro-partition lies in one file
        tables.write(df, f"{path}/data", cluster_by=by, rows_per_file=rows_per_file)
        data = spark.read.parquet(f"{path}/data")
        own = data.withColumn("__file", F.col("_metadata.file_name"))
        facts = [f(c).alias(f"{n}_{c}") for c in dict.fromkeys([cluster_by, *zones]) for n, f in (("min", F.min), ("max", F.max))]
        own.groupBy("__file", "__partition").agg(F.count("*").alias("n_rows"), *facts).write.parquet(f"{path}/zones")
        if bloom:
            most = spark.read.parquet(f"{path}/zones").agg(F.max("n_rows")).first()[0] or 1
            bits, hashes = pruning.bloom_params(int(most), rate)
            words = [
                pruning.bloom_words(own, c, bits, hashes, by=["__file", "__partition"]).withColumns({"column": F.lit(c), "bits": F.lit(bits), "hashes": F.lit(hashes)})
                for c in bloom
            ]
            whole = words[0]
            for w in words[1:]:
                whole = whole.unionByName(w)
            whole.write.partitionBy("column").parquet(f"{path}/blooms")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.data.drop("__partition")

    def _value(self, column: str, value: object) -> Column:
        return F.lit(value).try_cast(self.data.schema[column].dataType)

    def in_range(self, column: str, value: object) -> DataFrame:
        """Zones whose range holds ``value``; all, for a column without ranges; one of nulls alone is kept."""
        if f"min_{column}" not in self.zones.columns:
            return self.zones
        return pruning.may_hold(self.zones, column, self._value(column, value))

    def has_bloom(self, column: str) -> bool:
        return files.exists(self.spark, f"{self.path}/blooms/column={column}")

    def candidates(self, column: str, value: object) -> DataFrame:
        """Zones that may hold ``value`` by range and Bloom filter."""
        kept = self.in_range(column, value)
        if not self.has_bloom(column):
            return kept
        words = self.spark.read.parquet(f"{self.path}/blooms").where(F.col("column") == column)
        params = words.select("bits", "hashes").first()
        if params is None:  # no file holds anything but nulls
            return kept.where(F.lit(False))
        by = ["__file", "__partition"]
        return kept.join(pruning.holding(words, self._value(column, value), params.bits, params.hashes, by), by, "left_semi")

    def select(self, column: str, value: object, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows equal to ``value``, read from the files that may hold it."""
        tables.need(self.data, [column, *(columns or [])])
        kept = self.in_range(column, value).select("__file", "__partition").limit(2).collect()
        if len(kept) > 1:  # the ranges leave more than a zone to open: ask the filters
            kept = self.candidates(column, value).select("__file", "__partition").collect()  # a zone that may hold the value each
        names = sorted({r["__file"] for r in kept})
        out = [c for c in (columns or self.data.columns) if c != "__partition"]
        if not names:
            return self.data.where(F.lit(False)).select(*out)
        some = self.spark.read.schema(self.data.schema).parquet(*[f"{self.path}/data/{n}" for n in names])
        ids = sorted({r["__partition"] for r in kept})
        if len(ids) <= MOST_LITERALS:
            some = some.where(F.col("__partition").isin(ids))
        return some.where(F.col(column) == self._value(column, value)).select(*out)

    def report(self, column: str, value: object) -> DataFrame:
        """``partitions`` in all, ``after_ranges``, and ``after_bloom``, from what is stored; no data is read."""
        levels = {"partitions": self.zones, "after_ranges": self.in_range(column, value), "after_bloom": self.candidates(column, value)}
        numbers = tuple(z.count() for z in levels.values())
        return self.spark.createDataFrame([numbers], ", ".join(f"{n} long" for n in levels))
