"""Stored indexes: layouts that a lookup reads instead of its table.

``hashindex``  the rows in folders by the key's hash: a lookup lists one folder.
``btree``, ``bplustree``  the rows in files of disjoint key ranges, with zones and Bloom filters: a lookup opens the files that may hold the key, a range those that it meets.
``lsmtree``  a run of the log-structured table's layout: sorted by key, with a Bloom filter.
``gin``  postings (token, id, times) of the text columns, clustered by token, and the table by row number.
``bitmap``  a bitmap for each value of the text columns and 32,768 row numbers, clustered by value, and the table by row number.

An index holds the table as it was when it was built; postings take later documents and tombstones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_tokens
from ..sources import files, tables
from ..sources.zones import ZonedTable
from . import search
from .joins import bucket

#: Rows of a folder of a hash index, about.
FOLDER_ROWS = 1 << 20
#: Lines of saved postings that are read at once.
READ_LINES = 1000


class HashIndex:
    """Rows by the hash of a key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        name = next(n for n in files.names(spark, path) if n.startswith("by-"))
        _, folders, self.key = name.split("-", 2)
        self.folders, self.data = int(folders), spark.read.parquet(f"{path}/{name}")

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, folders: int | None = None) -> HashIndex:
        """Write ``df``.  Folders are dealt to tasks by size, so a common key's folder is written by several."""
        tables.need(df, [key])
        folders = folders or max(8, math.ceil(df.count() / FOLDER_ROWS))
        dealt = df.withColumn("__bucket", bucket(F.col(key), folders).cast("int")).hint("rebalance", "__bucket")
        dealt.sortWithinPartitions("__bucket", key).write.partitionBy("__bucket").parquet(f"{path}/by-{folders}-{key}")
        return cls(df.sparkSession, path)

    def lookup(self, value: object) -> DataFrame:
        """Rows of a key; the folder is chosen when the statement is planned."""
        v = F.lit(value).try_cast(self.data.schema[self.key].dataType)
        return self.data.where((F.col("__bucket") == bucket(v, self.folders).cast("int")) & (F.col(self.key) == v)).drop("__bucket")

    def rows(self) -> DataFrame:
        return self.data.drop("__bucket")


class TokenIndex:
    """Postings of documents: ``token``, ``id``, ``times``, the batch that they came with, and tombstones of ids.

    A batch's postings are lists (:func:`oakmill.operators.search.packed`) clustered by token, so that a search reads the row groups of its tokens.
    """

    ROWS = "token string, id long, times long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, docs: DataFrame, path: str, id_col: str, text_col: str) -> TokenIndex:
        index = cls(docs.sparkSession, path)
        index.insert(docs, id_col, text_col)
        return index

    def _batches(self, kind: str) -> list[tuple[int, str]]:
        found = files.written(self.spark, self.path, f"{kind}-")
        return [(int(n.split("-")[1]), f"{self.path}/{n}") for n in found]

    def _next(self) -> int:
        return max((k for kind in ("postings", "gone") for k, _ in self._batches(kind)), default=-1) + 1

    def insert(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Add documents."""
        at, ids = self._next(), docs.select(F.col(id_col).alias("id"))
        ids.distinct().write.parquet(f"{self.path}/ids-{at:012d}")
        if search.ids_repeat(ids, "id"):
            self._write(at, search.pack(search.by_token(search.counted(docs, id_col, text_col))))
        else:
            self._write(at, _dealt(search.packed(docs, id_col, text_col)))

    def _write(self, at: int, lists: DataFrame) -> None:
        lists.write.parquet(f"{self.path}/postings-{at:012d}")
        written = self.spark.read.parquet(f"{self.path}/postings-{at:012d}")
        totals = written.groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("total").alias("times"))
        totals.write.parquet(f"{self.path}/totals-{at:012d}")

    def remove(self, ids: DataFrame) -> None:
        """Hide the documents of ``ids`` (one column) that are there now; later ones of the same id are seen."""
        ids.toDF("id").distinct().write.parquet(f"{self.path}/gone-{self._next():012d}")

    def postings(self) -> DataFrame:
        """What is posted and not removed."""
        gone = self._batches("gone")
        out = None
        for at, path in self._batches("postings"):
            lists = self.spark.read.parquet(path)
            own = lists.select("token", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("times").alias("times")))).toDF("token", "id", "times")
            if later := [p for k, p in gone if k > at]:
                own = own.join(self.spark.read.parquet(*later).distinct(), "id", "left_anti").select("token", "id", "times")
            out = own if out is None else out.union(own)
        return out if out is not None else self.spark.createDataFrame([], self.ROWS)

    def save(self, path: str) -> None:
        """Write what is there as lines ``token|id,id,...`` (an id for each time); a token of many documents has several lines."""
        batches = self._batches("postings")
        whole = len(batches) == 1 and not self._batches("gone")
        lists = self.spark.read.parquet(batches[0][1]) if whole else search.pack(search.by_token(self.postings()))
        lists.select("token", "ids", "times").mapInArrow(_lines, "value string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, saved: str, path: str) -> TokenIndex:
        """The index that :meth:`save` wrote, at ``path``; an empty one if nothing is there."""
        index = cls(spark, path)
        if files.exists(spark, saved):
            index._write(0, _dealt(spark.read.text(saved).mapInArrow(_read_lines, search.PACKED.format(kind="long"))))
        return index

    def find(self, token: str, occurrences: bool = False) -> DataFrame:
        """Documents that hold a token, once each or once for each time."""
        hits = self.postings().where(F.col("token") == token.lower())
        return hits.select("id", F.explode(F.sequence(F.lit(1), "times")).alias("k")).select("id") if occurrences else hits.select("id").distinct()

    def _of(self, tokens: Sequence[str]) -> tuple[DataFrame, int]:
        wanted = list(dict.fromkeys(t.lower() for t in tokens))
        return self.postings().where(F.col("token").isin(wanted) if wanted else F.lit(False)), len(wanted)

    def find_all(self, tokens: Sequence[str]) -> DataFrame:
        """Documents that hold all tokens; none for an empty list."""
        hits, n = self._of(tokens)
        return hits.groupBy("id").agg(F.countDistinct("token").alias("n") if len(self._batches("postings")) > 1 else F.count("*").alias("n")).where(F.col("n") == n).select("id")

    def find_any(self, tokens: Sequence[str]) -> DataFrame:
        """Documents that hold one of the tokens at least."""
        return self._of(tokens)[0].select("id").distinct()

    def documents(self) -> DataFrame:
        """``token`` and ``n``, the number of documents that hold it: ids are told apart only if one is there in several batches."""
        gone, ids, batches = self._batches("gone"), dict(self._batches("ids")), self._batches("postings")
        repeat = len(batches) > 1 and not all(k in ids for k, _ in batches)
        if len(batches) > 1 and not repeat:
            seen = None
            for at, _ in batches:
                own = self.spark.read.parquet(ids[at])
                if later := [p for k, p in gone if k > at]:
                    own = own.join(self.spark.read.parquet(*later).distinct(), "id", "left_anti")
                seen = own if seen is None else seen.union(own)
            repeat = search.ids_repeat(seen, "id")
        return self.postings().groupBy("token").agg((F.countDistinct("id") if repeat else F.count("id")).alias("n"))

    def token_count(self) -> DataFrame:
        """The number of distinct tokens: from totals, unless documents have been removed."""
        if self._batches("gone") or not self._batches("totals"):
            return self.postings().agg(F.countDistinct("token").alias("n"))
        return self.spark.read.parquet(*[p for _, p in self._batches("totals")]).agg(F.countDistinct("token").alias("n"))


def _dealt(lists: DataFrame) -> DataFrame:
    """Lists in ranges of token and first id: a token of all documents is many tasks' work."""
    return lists.repartitionByRange("token", "first").sortWithinPartitions("token", "first")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line for each list."""
    for batch in batches:
        for i in range(0, batch.num_rows, READ_LINES):
            some = batch.slice(i, READ_LINES)
            times = some.column("times").flatten().to_numpy()
            ids = pc.fill_null(some.column("ids").flatten().cast(pa.string()), "").take(pa.array(np.repeat(np.arange(len(times)), times)))
            begins = np.append(0, np.cumsum(pc.list_value_length(some.column("ids")).to_numpy()))
            ends = np.append(0, np.cumsum(times))[begins]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), ",")
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(some.column("token"), joined, "|")], ["value"])


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of lines; an id that is repeated stands once with its times."""
    for batch in batches:
        for i in range(0, batch.num_rows, READ_LINES):
            cut = pc.split_pattern(batch.column("value").slice(i, READ_LINES), "|", max_splits=1, reverse=True)  # a token may hold the separator, ids don't
            ids = pc.split_pattern(pc.list_element(cut, 1), ",")
            line, texts = pc.list_parent_indices(ids), pc.list_flatten(ids)
            at = search._starts(line, texts)
            texts, line = texts.take(pa.array(at)), line.to_numpy()[at]
            number = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts).cast(pa.int64())
            begins = np.searchsorted(line, np.arange(len(cut) + 1))
            yield from search._in_lists(pc.list_element(cut, 0), begins, number, np.diff(at, append=len(pc.list_flatten(ids))))


class BitmapIndex:
    """Bitmaps of values, stored by value."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.bitmaps = path, spark.read.parquet(path)

    @classmethod
    def write(cls, pairs: DataFrame, path: str, id_col: str = "doc_id", value_col: str = "value") -> BitmapIndex:
        search.bitmaps(pairs, id_col, value_col).repartitionByRange("value", "bucket").sortWithinPartitions("value", "bucket").write.parquet(path)
        return cls(pairs.sparkSession, path)

    def save(self, path: str) -> None:
        """Write lines ``value|bucket|base64``."""
        self.bitmaps.select(F.concat_ws("|", "value", F.col("bucket").cast("string"), F.regexp_replace(F.base64("bitmap"), r"[\r\n]", "")).alias("value")).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, saved: str, path: str) -> BitmapIndex:
        line = F.col("value")
        tail = F.substring_index(line, "|", -2)  # a value may hold the separator
        rows = spark.read.option("lineSep", "\n").text(saved).select(
            line.substr(F.lit(1), F.length(line) - F.length(tail) - 1).alias("value"),
            F.substring_index(tail, "|", 1).cast("long").alias("bucket"), F.unbase64(F.substring_index(tail, "|", -1)).alias("bitmap"),
        )
        rows.repartitionByRange("value", "bucket").sortWithinPartitions("value", "bucket").write.parquet(path)
        return cls(spark, path)

    def find(self, values: Sequence[str], every: bool = False) -> DataFrame:
        """Ids that have any of the values, or all of them, ascending in a bucket; none for an empty list."""
        return search.expand(search.bitmap_all(self.bitmaps, values) if every else search.bitmap_any(self.bitmaps, values))

    def cardinality(self) -> DataFrame:
        return self.bitmaps.groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


#: Rows of a block, by which a lookup through postings or bitmaps limits what it reads, and blocks that are put into a filter.
BLOCK_ROWS, MOST_BLOCKS = 4096, 1000


class RowIndex:
    """Postings (``gin``) or bitmaps (``bitmap``) of the text columns of a table, and the table by row number."""

    def __init__(self, spark: SparkSession, path: str, kind: str) -> None:
        self.spark, self.path, self.kind = spark, path, kind
        self.data = spark.read.parquet(f"{path}/rows")

    @classmethod
    def write(cls, df: DataFrame, path: str, kind: str, columns: Sequence[str]) -> RowIndex:
        at = F.monotonically_increasing_id()
        df.withColumn("__row", at).withColumn("__block", F.floor(F.col("__row") / BLOCK_ROWS)).write.parquet(f"{path}/rows")
        index = cls(df.sparkSession, path, kind)
        if kind == "gin":
            texts = index.data.select("__row", F.concat_ws(" ", *columns).alias("text"))
            TokenIndex.write(texts, f"{path}/postings", "__row", "text")
        else:
            pairs = index.data.select(F.col("__row").alias("doc_id"), F.explode(F.array(*columns)).alias("value"))
            BitmapIndex.write(pairs, f"{path}/bitmaps")
        return index

    def lookup(self, value: str) -> DataFrame:
        """Rows that may have ``value`` in one of the columns."""
        if self.kind == "gin":
            tokens = [t for r in self.spark.range(1).select(document_tokens(F.lit(value)).alias("t")).collect() for t in r.t]
            if not tokens:
                return self.rows()
            ids = TokenIndex(self.spark, f"{self.path}/postings").find_all(tokens).toDF("__id")
        else:
            ids = BitmapIndex(self.spark, f"{self.path}/bitmaps").find([value]).toDF("__id")
        blocks = ids.select(F.floor(F.col("__id") / BLOCK_ROWS).alias("b")).distinct().limit(MOST_BLOCKS + 1).collect()
        some = self.data.where(F.col("__block").isin([r.b for r in blocks])) if len(blocks) <= MOST_BLOCKS else self.data
        return some.join(ids, F.col("__row") == F.col("__id"), "left_semi").drop("__row", "__block")

    def rows(self) -> DataFrame:
        return self.data.drop("__row", "__block")


def build(kind: str, df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write an index: of one key column, or of text columns."""
    if kind == "hashindex":
        HashIndex.write(df, path, columns[0])
    elif kind in ("gin", "bitmap"):
        RowIndex.write(df, path, kind, columns)
    else:
        ZonedTable.write(df, path, columns[0], bloom=columns)


def lookup(kind: str, spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """Rows of an index's table that may have ``value`` in ``column``; the statement's own filter stays in force."""
    if kind == "hashindex":
        return HashIndex(spark, path).lookup(value)
    if kind in ("gin", "bitmap"):
        return RowIndex(spark, path, kind).lookup(value)
    return ZonedTable(spark, path).select(column, value)
