"""Exact dedup by content sort.

1. Sampled splitters range-partition the normalised bytes.  The sort key is
   (first ``HEAD`` bytes, xxHash64, whole bytes, id): a total order in which
   equal texts are adjacent.  Splitters are drawn from (head, hash, id), so a
   sample stays small however long texts are, and a group of equal texts with a
   third of all rows is spread over many partitions instead of one.
2. Spark's external sort orders each partition.  One pass compares each whole
   text with its neighbour, numbers the runs of equal texts, and gives every row its
   run's size and its smallest and largest id there.  Only the ids of the current run are held, packed.
3. A run that touches an end of its partition may go on in the next one.  The
   first and the last run of each partition (two rows a partition, with whole
   text) are grouped by their text, a full comparison again, and their totals go
   back to the rows of those runs by (partition, run): a broadcast of five numbers for two rows a
   partition at most, and no texts.

Defined results: null text equals empty text; rows that repeat an id are counted
each; rows with a null id belong to a group but are kept only if no row of it
has an id; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, documents, map_batches, small_batches, tidy

#: Leading bytes that splitters see.
HEAD = 32

_ROWS = (
    "doc_id long, part int, run long, local_low long, local_high long, local_size long, "
    "edge boolean, norm string, text_sha256 string"
)


def normalised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``norm``: the text with A-Z lower-cased, null as empty."""

    def lower(batch: pa.RecordBatch) -> pa.RecordBatch:
        norm = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
        return pa.RecordBatch.from_arrays([batch.column(0), norm], names=["doc_id", "norm"])

    return map_batches(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), lower, "doc_id long, norm string"
    )


#: Rows of a batch that a task hands on.
OUT_ROWS = 5000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the facts of their run; the first and the last run carry their text."""
    part, run = TaskContext.get().partitionId(), 0
    text: str | None = None
    ids, unknown = array("q"), 0  # of the current run, and how many of its rows have none
    ready: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), _TYPES, strict=True)], names=_NAMES)
        ready.clear()
        return out

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        """The current run's rows, in batches as they fill up."""
        known = np.array(ids, np.int64)
        low, high = (int(known.min()), int(known.max())) if len(known) else (None, None)
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        edge, n = last or run == 0, len(ids) + unknown
        for k in range(n):
            ready.append((ids[k] if k < len(ids) else None, part, run, low, high, n, edge, text if edge and not k else None, sha))
            if len(ready) >= OUT_ROWS:
                yield batch()

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t != text:
                if text is not None:
                    yield from close(False)
                    run += 1
                text, ids, unknown = t, array("q"), 0
            if i is None:
                unknown += 1
            else:
                ids.append(i)
    if text is not None:
        yield from close(True)
    if ready:
        yield batch()
    tidy()


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]


def dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: whether the smallest or the largest id of equal texts stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    small_batches(docs.sparkSession)
    keyed = normalised(docs, id_col, text_col).withColumns(
        {"head": F.substring(F.encode("norm", "utf-8"), 1, HEAD), "h": F.xxhash64("norm")}
    )
    rows = cut_lineage(
        keyed.repartitionByRange("head", "h", "doc_id")
        .sortWithinPartitions("head", "h", "norm", "doc_id")
        .select("doc_id", "norm")
        .mapInArrow(_runs, _ROWS),
        "runs",
    )
    low, high = F.min("local_low").alias("low"), F.max("local_high").alias("high")
    edges = rows.where(F.col("norm").isNotNull()).select("part", "run", "norm", "local_low", "local_high", "local_size")
    whole = edges.groupBy("norm").agg(low, high, F.sum("local_size").alias("n"))
    totals = edges.join(whole, "norm").select("part", "run", "low", "high", "n")
    pick = "low" if keep == "smallest" else "high"
    return (
        rows.drop("norm")
        .join(F.broadcast(totals), ["part", "run"], "left")
        .select(
            "doc_id",
            F.coalesce(pick, f"local_{pick}").alias("keep_id"),
            F.coalesce("n", "local_size").alias("group_size"),
            (F.col("doc_id").eqNullSafe(F.coalesce(pick, f"local_{pick}"))).alias("kept"),
            "text_sha256",
        )
    )


def keep_one(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of equal texts, with all its columns.

    The same sort carries whole rows, so that no join brings them back.  Each
    partition keeps its runs' first rows; of a run that goes on over several
    partitions, the first partition's row stays.  Of rows that repeat an id and a text any one stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    small_batches(docs.sparkSession)
    n = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    at = {c: i for i, c in enumerate(docs.columns)}
    key = F.col(f"c{at[id_col]}").cast("long")
    key = key.asc_nulls_last() if keep == "smallest" else key.desc_nulls_last()
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def lower(batch: pa.RecordBatch) -> pa.RecordBatch:
        norm = pc.ascii_lower(pc.fill_null(batch.column(at[text_col]), ""))
        return pa.RecordBatch.from_arrays([*batch.columns, norm], names=[*batch.schema.names, "norm"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run = TaskContext.get().partitionId(), None, 0
        held: pa.RecordBatch | None = None  # the last run's row, which may go on in the next partition

        def out(rows: pa.RecordBatch, edge: list[int | None]) -> pa.RecordBatch:
            """``edge``: the number of each row's run if it is at an end of the partition."""
            texts = [None if e is None else t for t, e in zip(rows.column(n).to_pylist(), edge, strict=True)]
            return pa.RecordBatch.from_arrays(
                [*rows.columns[:n], pa.array([part] * len(edge), pa.int32()), pa.array(edge, pa.int64()), pa.array(texts, pa.string())],
                names=[*rows.schema.names[:n], "part", "edge", "edge_text"],
            )

        for b in batches:
            texts = b.column(n).to_pylist()
            new = [i for i, t in enumerate(texts) if t != (texts[i - 1] if i else last)]
            last = texts[-1] if texts else last
            if not new:
                continue
            if held is not None:
                yield out(held, [0 if run == 1 else None])
            rows = b.take(pa.array(new[:-1], pa.int64()))
            if rows.num_rows:
                yield out(rows, [None if run else 0, *[None] * (len(new) - 2)])
            run += len(new)
            held = b.take(pa.array(new[-1:], pa.int64()))
        if held is not None:
            yield out(held, [run - 1])
        tidy()

    rows = cut_lineage(
        map_batches(plain, lower, f"{fields}, norm string")
        .withColumns({"head": F.substring(F.encode("norm", "utf-8"), 1, HEAD), "h": F.xxhash64("norm")})
        .repartitionByRange("head", "h", key)
        .sortWithinPartitions("head", "h", "norm", key)
        .drop("head", "h")
        .mapInArrow(firsts, f"{fields}, part int, edge long, edge_text string"),
        "firsts",
    )
    ends = rows.where(F.col("edge").isNotNull()).select("edge_text", F.col("part").alias("p"), F.col("edge").alias("e"))
    owner = ends.groupBy("edge_text").agg(F.min("p").alias("first"))
    late = ends.join(owner, "edge_text").where("p > first").select("p", "e")  # two rows of two numbers a partition at most
    stay = rows.join(F.broadcast(late), (rows["part"] == late["p"]) & rows["edge"].eqNullSafe(late["e"]), "left_anti")
    return stay.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), keep="largest")


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
