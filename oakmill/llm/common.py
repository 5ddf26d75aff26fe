"""What the operators share: shared-folder tables, Arrow batches, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete, estimated_bytes, new_folder

#: Rows in an Arrow batch: bounds a Python worker's memory on long texts.
ARROW_ROWS = 1000


class _Table(NamedTuple):
    """A table that :func:`cut_lineage` wrote."""

    path: str
    owner: str | None


_written: dict[str, list[_Table]] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def cut_lineage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages, and stages recomputed after an executor is lost, read the
    written table; files are removed by :func:`release` or at exit.
    """
    spark = df.sparkSession
    path = new_folder(spark, f"oakmill-{what}")
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(_Table(path, _owner.get()))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes meanwhile belong to ``name``."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def release(spark: SparkSession, keep: Iterable[DataFrame] = (), owner: str | None = None) -> None:
    """Delete the tables written by :func:`cut_lineage` (those of ``owner``, if given), but those that ``keep`` reads."""
    read = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
    left = []
    for t in _written.pop(spark.sparkContext.applicationId, []):
        if (owner and t.owner != owner) or t.path.rsplit("/", 1)[1] in read:
            left.append(t)
        else:
            delete(spark, t.path)
    _written[spark.sparkContext.applicationId] = left


def drop(spark: SparkSession, written: DataFrame) -> None:
    """Delete the tables of :func:`cut_lineage` that ``written`` reads, and nothing else any more."""
    read = {f.rsplit("/", 2)[-2] for f in written.inputFiles()}
    tables = _written.get(spark.sparkContext.applicationId, [])
    for t in [t for t in tables if t.path.rsplit("/", 1)[1] in read]:
        delete(spark, t.path)
        tables.remove(t)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        if spark is not None:
            release(spark)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Let Arrow batches of this session hold ``rows`` rows at most, so that batches of long texts fit a worker.

    The setting is read when a plan runs, so it stays; it never changes a result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of ``rows`` rows or a batch more; no empty ones."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Give memory that a Python worker has freed back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy() -> None:
    """:func:`trim` at the end of a task, with what Arrow and cycles hold: workers live on and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def split_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_batches(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty results are skipped."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None and out.num_rows:
                yield out
        tidy()

    return df.mapInArrow(over, schema)


#: Bytes by the optimiser's estimate up to which a side of a join is broadcast.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if its estimated size is within ``BROADCAST_BYTES``; else Spark chooses the join."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_BYTES else df


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and what each was called by: no name can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def named(df: DataFrame, names: dict[str, str]) -> list[Column]:
    """The columns of :func:`numbered` under their names."""
    return [df[c].alias(n) for n, c in names.items()]


def components(edges: DataFrame, what: str = "links") -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has long columns ``a`` and ``b``.  Returns ``node``, ``root``
    (the smallest node reachable), one row per node that has a link to another.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    step points the neighbours of every node at their smallest member.  The
    smallest neighbour comes from a partial aggregate, so a hub costs one row
    per map task there; the join back is an ordinary equi-join, whose skewed
    partitions AQE splits.  Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = cut_lineage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        what,
    )

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy("u").agg(F.min("v").alias("m"))

    def mark(of: DataFrame) -> tuple:
        row = of.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        return tuple(row)

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(least(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small_min = least(large)
        small = (
            large.join(small_min, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_min.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, now = now, cut_lineage(small, what)
        drop(spark, old)
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each holds ``per_part`` rows or fewer on average."""
    return max(least, math.ceil(rows / per_part))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
