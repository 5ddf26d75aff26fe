"""Line files: ``id,json`` documents and ``key:value`` snapshots; and a versioned store of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import MalformedRequest, MissingDocument
from . import files


#: Folders of successive writes, in the order of their numbers.
BATCH = r"batch-(\d{12})"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``place``, a struct that orders them as they were written.

    Writes of :func:`write_documents` follow each other by number, other files by modification time, both after the
    files that lie there by themselves; then come the file's name, the block in it, and the line in the block.
    """
    batch = F.regexp_extract(F.col("_metadata.file_path"), BATCH, 1)
    since = F.when(batch == "", F.col("_metadata.file_modification_time"))
    place = F.struct(
        batch.alias("batch"), since.alias("since"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", place.alias("place"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``json`` of a document file or folder: the last line of an id holds; empty lines are passed over."""
    lines = _numbered(spark, path).where(F.col("value") != "")
    parts = F.split("value", ",", 2)
    return newest(lines.select(parts[0].cast("int").alias("doc_id"), parts[1].alias("json"), "place"), "doc_id", ["place"]).select("doc_id", "json")


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a partial aggregate, so no key's rows meet in one task."""
    rest = [c for c in rows.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(picked.alias("__row")).select(key, "__row.*")


def write_documents(docs: DataFrame, path: str) -> None:
    """Append ``doc_id``, ``json`` as lines, in a new folder in ``path``; line breaks inside a document are dropped.  One writer at a time."""
    spark = docs.sparkSession
    numbers = [int(m[1]) for n in files.names(spark, path) if (m := re.fullmatch(BATCH, n))]
    line = F.concat(F.col("doc_id").cast("string"), F.lit(","), F.regexp_replace("json", r"[\r\n]", ""))
    docs.select(line.alias("value")).write.text(f"{path}/batch-{max(numbers, default=-1) + 1:012d}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``value`` of a ``key:value`` file."""
    parts = F.split("value", ":", 2)
    lines = spark.read.text(path).where(F.col("value") != "")
    return lines.select(parts[0].alias("key"), parts[1].cast("long").alias("value"))


def write_snapshot(pairs: DataFrame, path: str) -> None:
    """Write ``key``, ``value`` as ``key:value`` lines."""
    pairs.select(F.concat_ws(":", F.col("key").cast("string"), F.col("value").cast("string")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def line_exists(spark: SparkSession, path: str, line: str) -> bool:
    """Whether a file holds the line, blanks at its ends aside."""
    return not spark.read.text(path).where(F.trim("value") == line.strip()).limit(1).isEmpty()


def delete_matching(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Delete the files of a folder whose whole names match; gives the names."""
    return [n for n in files.names(spark, folder) if re.fullmatch(pattern, n) and files.delete(spark, f"{folder}/{n}")]


def next_id(docs: DataFrame, key: str = "doc_id") -> int:
    """The id after the largest one, 0 in an empty store."""
    return int(docs.agg(F.coalesce(F.max(key), F.lit(-1)) + 1).first()[0])


def append(docs: DataFrame, payloads: DataFrame, key: str = "doc_id", first: int | None = None) -> DataFrame:
    """``docs`` with the rows of ``payloads`` (json), which get the next ids (from ``first``, if known) in their order.

    Spark numbers rows consecutively within a partition; only the partitions' counts are summed up.
    """
    first = next_id(docs, key) if first is None else first
    at = payloads.select("json", F.monotonically_increasing_id().alias("at"))
    at = at.select("json", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    counts = at.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = at.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    number = F.col("before") + F.col("row") + F.lit(first)
    return docs.union(new.select(number.cast(docs.schema[key].dataType).alias(key), "json"))


def without(docs: DataFrame, gone: Column) -> DataFrame:
    """Rows for which ``gone`` is not true."""
    return docs.where(~F.coalesce(gone, F.lit(False)))


class DocumentStore:
    """Documents in numbered folders: a write adds one with its rows and tombstones alone, readers keep the folders they saw.

    A folder's name holds its number and the next free id, so a write reads no document;
    :meth:`compact` puts all that is left into one folder.
    """

    SCHEMA = "doc_id long, json string, deleted boolean"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[str]:
        """Folders from the last compaction on."""
        found = files.written(self.spark, self.folder, "v")
        last = max((i for i, n in enumerate(found) if n.endswith("-all")), default=0)
        return found[last:]

    def _rows(self) -> DataFrame:
        rows = self.spark.createDataFrame([], f"{self.SCHEMA}, version int")
        for k, name in enumerate(self._versions()):
            rows = rows.union(self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{name}").withColumn("version", F.lit(k)))
        return rows

    def documents(self) -> DataFrame:
        """What is there now."""
        return newest(self._rows(), "doc_id", ["version"]).where(~F.col("deleted")).select("doc_id", "json")

    def _next(self) -> tuple[int, int]:
        """The number of the next folder, and the next id."""
        versions = self._versions()
        return (int(versions[-1][1:13]) + 1, int(versions[-1].split("-")[1])) if versions else (0, 0)

    def _write(self, rows: DataFrame, number: int, next_id: int, kind: str = "some") -> None:
        rows.write.parquet(f"{self.folder}/v{number:012d}-{next_id:018d}-{kind}")

    def append(self, payloads: list[str]) -> list[int]:
        """Store JSON texts; gives their ids."""
        if any(not isinstance(p, str) or not p.strip() for p in payloads):
            raise MalformedRequest("a document is a JSON text")
        number, first = self._next()
        rows = [(first + i, re.sub(r"[\r\n]", "", p), False) for i, p in enumerate(payloads)]
        self._write(self.spark.createDataFrame(rows, self.SCHEMA), number, first + len(rows))
        return [r[0] for r in rows]

    def find(self, doc_id: object) -> str | None:
        """A document's JSON, or None."""
        if not isinstance(doc_id, int) or isinstance(doc_id, bool):
            return None
        row = self.documents().where(F.col("doc_id") == doc_id).first()
        return row.json if row else None

    def delete(self, doc_id: int) -> str:
        """Remove a document; gives its line."""
        found = self.find(doc_id)
        if found is None:
            raise MissingDocument(f"document {doc_id} isn't there")
        number, first = self._next()
        self._write(self.spark.createDataFrame([(doc_id, None, True)], self.SCHEMA), number, first)
        return f"{doc_id},{found}"

    def compact(self) -> None:
        """Write what is there as one folder; the older ones stay for their readers until :meth:`drop`."""
        number, first = self._next()
        self._write(self.documents().withColumn("deleted", F.lit(False)), number, first, "all")

    def drop(self) -> None:
        """Remove everything."""
        files.delete(self.spark, self.folder)
