"""One object for a session: catalog, SQL, and table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from .catalog import Catalog
from .operators import joins, query
from .plans import sql


class Engine:
    """Queries over registered tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.catalog = spark, Catalog(spark)

    def register(self, name: str, data: DataFrame, schema: str = "public") -> None:
        self.catalog.register(schema, name, data)

    def table(self, name: str, schema: str = "public") -> DataFrame:
        return self.catalog.require(schema, name).data

    def sql(self, text: str) -> DataFrame:
        """Rows of a statement in the small dialect (``spark.sql`` has all of Spark's)."""
        return sql.build(sql.parse(text), self.catalog)

    def explain(self, text: str) -> sql.Plan:
        return sql.explain(sql.parse(text), self.catalog)

    def select(self, name: str, filter_col: str | None = None, value: object = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows whose column equals a value; a stored table opens only the files that may hold it."""
        entry = self.catalog.require("public", name)
        if entry.stored and filter_col is not None and value is not None:
            return entry.stored.select(entry.column(filter_col).name, value, columns)
        return query.select(entry.data, filter_col, value, columns)

    def aggregate(self, name: str, **named: Column) -> DataFrame:
        return query.aggregate(self.table(name), **named)

    def group_by(self, name: str, key: str, **named: Column) -> DataFrame:
        return query.group_by(self.table(name), key, **named)

    def join(self, left: str, left_key: str, right: str, right_key: str, columns: Sequence[str] | None = None, strategy: str = "auto") -> DataFrame:
        return joins.join(self.table(left), left_key, self.table(right), right_key, columns, strategy)
