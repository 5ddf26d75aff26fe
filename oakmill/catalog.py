"""The catalog: ``schema.table`` to a DataFrame, its clustering key and its indexes.  Names don't distinguish case."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import DuplicateIndex, MissingIndex, UnknownColumn, UnknownIndexType, UnknownTable
from .operators import indexes
from .sources import files
from .sources.tables import need
from .sources.zones import ZonedTable

#: Index types, and the layout of each (:mod:`oakmill.operators.indexes`).
LAYOUTS = {
    "hashindex": "folders by the key's hash",
    "btree": "files of key ranges with Bloom filters",
    "bplustree": "files of key ranges with Bloom filters",
    "lsmtree": "a run sorted by key with a Bloom filter",
    "gin": "postings of tokens",
    "bitmap": "bitmaps of values",
}
#: Those of text columns.
OF_TEXT = ("gin", "bitmap")


@dataclass(frozen=True)
class Index:
    """A stored index."""

    kind: str
    path: str
    columns: tuple[str, ...]


@dataclass
class Entry:
    """A registered table."""

    schema: str
    name: str
    data: DataFrame
    clustered_by: str | None = None
    indexes: dict[str, Index] = field(default_factory=dict)
    stored: ZonedTable | None = None

    def column(self, name: str) -> T.StructField:
        need(self.data, [name])
        return next(f for f in self.data.schema if f.name.lower() == name.lower())

    def usable(self, column: str) -> dict[str, Index]:
        """The indexes that serve an equality of ``column``."""
        return {k: i for k, i in self.indexes.items() if column.lower() in (c.lower() for c in i.columns)}


class Catalog:
    """Tables in the order of their registration."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._entries: dict[tuple[str, str], Entry] = {}

    def register(self, schema: str, name: str, data: DataFrame) -> Entry:
        """Register a table, or replace one of that name."""
        key = (schema.lower(), name.lower())
        self._entries[key] = Entry(*key, data)
        return self._entries[key]

    def get(self, schema: str, name: str) -> Entry | None:
        return self._entries.get((schema.lower(), name.lower()))

    def require(self, schema: str, name: str) -> Entry:
        if (entry := self.get(schema, name)) is None:
            raise UnknownTable(f"no table {schema}.{name}")
        return entry

    def find(self, name: str) -> Entry:
        """A table by its name alone, of any schema."""
        for (_, own), entry in self._entries.items():
            if own == name.lower():
                return entry
        raise UnknownTable(f"no table {name}")

    def names(self, schema: str) -> list[str]:
        return [n for s, n in self._entries if s == schema.lower()]

    def __len__(self) -> int:
        return len(self._entries)

    def tables(self) -> DataFrame:
        """All tables: schema, name, position."""
        rows = [(s, n, i) for i, (s, n) in enumerate(self._entries)]
        return self.spark.createDataFrame(rows, "schema_name string, table_name string, position int")

    def columns(self, schema: str, name: str) -> DataFrame:
        """A table's columns and types."""
        fields = self.require(schema, name).data.schema
        rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(fields)]
        return self.spark.createDataFrame(rows, "column_name string, type string, position int")

    def set_clustered_key(self, schema: str, name: str, column: str) -> None:
        """The column by which :meth:`store` writes the table."""
        entry = self.require(schema, name)
        entry.clustered_by = entry.column(column).name

    def store(self, schema: str, name: str, path: str | None = None, **options: object) -> Entry:
        """Write a table clustered by its key, with zones and Bloom filters; from now on it is read from there."""
        entry = self.require(schema, name)
        key = entry.clustered_by or entry.data.columns[0]
        options = {"bloom": [key]} | options
        entry.stored = ZonedTable.write(entry.data, path or files.new_folder(self.spark, f"table-{entry.name}"), key, **options)
        entry.data = entry.stored.rows()
        return entry

    def create_index(self, schema: str, name: str, kind: str, column: str | None = None) -> str:
        """Write an index; gives its layout.

        ``column``: else ``id``, the clustering key or the first column; of text indexes, else all text columns.
        """
        entry, kind = self.require(schema, name), kind.lower()
        if kind not in LAYOUTS:
            raise UnknownIndexType(f"no index type {kind}")
        if kind in entry.indexes:
            raise DuplicateIndex(f"{kind} is there already")
        own = {c.lower(): c for c in entry.data.columns}
        if column:
            columns = (entry.column(column).name,)
        elif kind in OF_TEXT:
            columns = tuple(f.name for f in entry.data.schema if isinstance(f.dataType, T.StringType))
        else:
            columns = (own.get("id") or entry.clustered_by or entry.data.columns[0],)
        if not columns or kind in OF_TEXT and not all(isinstance(entry.column(c).dataType, T.StringType) for c in columns):
            raise UnknownColumn(f"{kind} needs a text column")
        path = files.new_folder(self.spark, f"index-{entry.name}-{kind}")
        indexes.build(kind, entry.data, path, columns)
        entry.indexes[kind] = Index(kind, path, columns)
        return LAYOUTS[kind]

    def drop_index(self, schema: str, name: str, kind: str) -> None:
        entry, kind = self.require(schema, name), kind.lower()
        if kind not in LAYOUTS:
            raise UnknownIndexType(f"no index type {kind}")
        if kind not in entry.indexes:
            raise MissingIndex(f"{kind} isn't there")
        files.delete(self.spark, entry.indexes.pop(kind).path)

    def drop_all(self) -> None:
        """Forget all tables and delete their indexes."""
        for entry in self._entries.values():
            for index in entry.indexes.values():
                files.delete(self.spark, index.path)
        self._entries.clear()
