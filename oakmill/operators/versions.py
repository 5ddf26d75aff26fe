"""Versioned data: ordered indexes, log-structured tables, snapshot visibility, log replay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InactiveTransaction
from ..sources import files
from ..sources.docfile import newest
from . import pruning

LEVELS = ("READ_UNCOMMITTED", "READ_COMMITTED", "REPEATABLE_READ", "SERIALIZABLE")
#: Distinct keys that a log's memory table holds before it becomes a run.
MEMTABLE_KEYS = 5
#: Log numbers that are ranked in one task.
SPAN = 1 << 20
#: Rows that wait on the driver to be written, in a store that has a folder.
PENDING = 10_000


def upsert(index: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The index after ``changes`` (same columns): of equal keys the last by ``order`` holds."""
    return newest(index.unionByName(changes), key, [order])


def remove(index: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The index without the keys of ``keys``."""
    return index.join(keys.select(F.col(key).alias("__gone")).distinct(), F.col(key) == F.col("__gone"), "left_anti")


def lsm_read(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Live keys of a log of puts and tombstones: the newest record of each, unless it is a tombstone."""
    return newest(log, key, [seq]).where(~F.col(deleted)).drop(deleted)


def lsm_compact(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted", run: str = "run") -> DataFrame:
    """The log after its two oldest runs are merged: newer wins, tombstones go.

    Nothing older is left that these tombstones could hide, so reads stay as they were.
    """
    oldest = [r[0] for r in log.select(run).distinct().orderBy(run).limit(2).collect()]
    if len(oldest) < 2:
        return log
    merged = newest(log.where(F.col(run).isin(oldest)), key, [seq]).where(~F.col(deleted)).withColumn(run, F.lit(oldest[1]).cast(log.schema[run].dataType))
    return log.where(~F.col(run).isin(oldest)).unionByName(merged)


class LsmTree:
    """A log-structured table: a memory table of ``MEMTABLE_KEYS`` keys, and runs, each a folder sorted by key with a Bloom filter.

    ``hits`` and ``misses`` count the runs that a lookup opened, and that a Bloom filter spared it.
    """

    SCHEMA = "key long, value long, deleted boolean, seq long"

    def __init__(self, spark: SparkSession, folder: str, rate: float = 0.01) -> None:
        self.spark, self.folder, self.rate = spark, folder.rstrip("/"), rate
        self.hits = self.misses = 0
        self._memory: dict[int, tuple[int | None, bool]] = {}

    def runs(self) -> list[str]:
        """Names of the runs, oldest first: ``run-(first)-(last)-(bits)-(hashes)``, by the numbers of the flushes in it.  A merged run hides those it was made of."""
        found = files.written(self.spark, self.folder, "run-")
        span = {n: tuple(map(int, n.split("-")[1:3])) for n in found}
        return [n for n in found if not any(o != n and span[o][0] <= span[n][0] and span[n][1] <= span[o][1] for o in found)]

    def _set(self, key: int, value: int | None, deleted: bool) -> None:
        self._memory[key] = (value, deleted)
        if len(self._memory) >= MEMTABLE_KEYS:
            self.flush()

    def put(self, key: int, value: int) -> None:
        self._set(key, value, False)

    def remove(self, key: int) -> None:
        """Put a tombstone."""
        self._set(key, None, True)

    def flush(self) -> None:
        """Make the memory table a run."""
        if self._memory:
            rows = [(k, v, d, 0) for k, (v, d) in sorted(self._memory.items())]
            self.ingest(self.spark.createDataFrame(rows, self.SCHEMA))
            self._memory.clear()

    flush_all = flush

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        bits, hashes = pruning.bloom_params(max(1, rows.count()), self.rate)
        name = f"run-{first:012d}-{last:012d}-{bits}-{hashes}"
        pruning.bloom_words(rows, "key", bits, hashes).write.mode("overwrite").parquet(f"{self.folder}/bloom-{name}")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.folder}/{name}")

    def ingest(self, log: DataFrame) -> None:
        """Write a whole log (key, value, deleted, seq) as one run: the newest record of each key."""
        at = max((int(n.split("-")[2]) for n in self.runs()), default=-1) + 1
        self._write(newest(log.select("key", "value", "deleted", "seq"), "key", ["seq"]).select("key", "value", "deleted", "seq"), at, at)

    def read_run(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def may_hold(self, name: str, key: int) -> bool:
        """Whether a run's Bloom filter may hold a key."""
        bits, hashes = map(int, name.split("-")[3:])
        words = self.spark.read.parquet(f"{self.folder}/bloom-{name}").withColumn("run", F.lit(name))
        return not pruning.holding(words, F.lit(key).cast("long"), bits, hashes, ["run"]).isEmpty()

    def get(self, key: int) -> int | None:
        """A key's value: the memory table's, or that of the newest run that has it."""
        if key in self._memory:
            return self._memory[key][0]
        for name in reversed(self.runs()):
            if not self.may_hold(name, key):
                self.misses += 1
                continue
            self.hits += 1
            if (row := self.read_run(name).where(F.col("key") == key).first()) is not None:
                return row.value
        return None

    def read(self) -> DataFrame:
        """All live keys and values."""
        memory = [(k, v, d, 0) for k, (v, d) in self._memory.items()]
        log = self.spark.createDataFrame(memory, self.SCHEMA).withColumn("run", F.lit(1 << 40))
        for k, name in enumerate(self.runs()):
            log = log.union(self.read_run(name).withColumn("run", F.lit(k).cast("long")))
        return newest(log, "key", ["run"]).where(~F.col("deleted")).select("key", "value", "seq")

    def merge(self) -> None:
        """Make one run of the two oldest: newer wins, tombstones go, as nothing older is left for them to hide."""
        two = self.runs()[:2]
        if len(two) == 2:
            both = self.read_run(two[0]).withColumn("run", F.lit(0)).union(self.read_run(two[1]).withColumn("run", F.lit(1)))
            live = newest(both, "key", ["run"]).where(~F.col("deleted")).select("key", "value", "deleted", "seq")
            self._write(live, int(two[0].split("-")[1]), int(two[1].split("-")[2]))

    def drop(self) -> None:
        files.delete(self.spark, self.folder)


# Snapshots.


def can_see(level: str, snapshot: int, writer: Column, status: Column) -> Column:
    """Whether a transaction sees a version, by its writer and the writer's status.

    Its own uncommitted writes are like those of others.
    """
    if level not in LEVELS:
        raise ValueError(f"no isolation level {level}")
    if level == "READ_UNCOMMITTED":
        return status != "ROLLED_BACK"
    seen = status == "COMMITTED"
    return seen & (writer <= F.lit(snapshot)) if level in ("REPEATABLE_READ", "SERIALIZABLE") else seen


def mvcc_read(
    versions: DataFrame, level: str, snapshot: int = 0, doc: str = "doc_id", seq: str = "version_seq", writer: str = "writer_tx",
    status: str = "status", deleted: str = "deleted",
) -> DataFrame:
    """The documents that a transaction sees: visible versions first, the newest of these, and then no deleted ones."""
    visible = versions.where(can_see(level, snapshot, F.col(writer), F.col(status)))
    return newest(visible, doc, [seq]).where(~F.col(deleted))


def mvcc_range(versions: DataFrame, level: str, low: int, high: int, snapshot: int = 0, doc: str = "doc_id", **names: str) -> DataFrame:
    """Visible documents with ``low <= id <= high``, ascending; the range reaches the scan."""
    return mvcc_read(versions.where(F.col(doc).between(low, high)), level, snapshot, doc, **names).orderBy(doc)


@dataclass
class Transaction:
    id: int
    level: str
    snapshot: int
    status: str = "ACTIVE"


@dataclass
class VersionStore:
    """Transactions over versioned documents.  Writes gather on the driver until :meth:`flush` adds them to the table,
    which it does by itself every ``PENDING`` writes if ``folder`` is given."""

    spark: SparkSession
    base: DataFrame | None = None
    folder: str | None = None
    transactions: list[Transaction] = field(default_factory=list)
    _pending: list[tuple] = field(default_factory=list)
    _seq: int = 0

    SCHEMA = "doc_id long, value long, writer_tx long, deleted boolean, version_seq long"

    def begin(self, level: str) -> Transaction:
        if level not in LEVELS:
            raise ValueError(f"no isolation level {level}")
        done = [t.id for t in self.transactions if t.status == "COMMITTED"]
        tx = Transaction(len(self.transactions) + 1, level, max(done, default=0))
        self.transactions.append(tx)
        return tx

    def _end(self, tx: Transaction, status: str) -> None:
        if tx.status != "ACTIVE":
            raise InactiveTransaction(f"transaction {tx.id} is {tx.status}")
        tx.status = status

    def commit(self, tx: Transaction) -> None:
        self._end(tx, "COMMITTED")

    def rollback(self, tx: Transaction) -> None:
        self._end(tx, "ROLLED_BACK")

    def _write(self, tx: Transaction, doc: int, value: int | None, deleted: bool) -> None:
        if tx.status != "ACTIVE":
            raise InactiveTransaction(f"transaction {tx.id} is {tx.status}")
        self._seq += 1
        self._pending.append((doc, value, tx.id, deleted, self._seq))
        if self.folder and len(self._pending) >= PENDING:
            self.flush(self.folder)

    def insert(self, tx: Transaction, doc: int, value: int) -> None:
        self._write(tx, doc, value, False)

    def delete(self, tx: Transaction, doc: int) -> None:
        self._write(tx, doc, None, True)

    def versions(self) -> DataFrame:
        """All versions, with their writers' status."""
        new = self.spark.createDataFrame(self._pending, self.SCHEMA)
        rows = self.base.unionByName(new) if self.base is not None else new
        states = self.spark.createDataFrame([(t.id, t.status) for t in self.transactions], "writer_tx long, status string")
        return rows.join(states, "writer_tx")

    def flush(self, path: str) -> None:
        """Append what was written to the table at ``path``."""
        self.spark.createDataFrame(self._pending, self.SCHEMA).write.mode("append").parquet(path)
        self._pending.clear()
        self.base = self.spark.read.parquet(path)

    def read(self, tx: Transaction) -> DataFrame:
        return mvcc_read(self.versions(), tx.level, tx.snapshot)

    def value(self, tx: Transaction, doc: int) -> int | None:
        row = self.read(tx).where(F.col("doc_id") == doc).first()
        return row.value if row else None

    def range_scan(self, tx: Transaction, low: int, high: int) -> DataFrame:
        return mvcc_range(self.versions(), tx.level, low, high, tx.snapshot)

    def visible_count(self, tx: Transaction) -> int:
        return self.read(tx).count()


# Write-ahead log: lsn, tx_id, kind (insert, delete, commit, rollback), doc_id, payload.


def wal_replay(log: DataFrame, lsn: str = "lsn", tx: str = "tx_id", kind: str = "kind") -> DataFrame:
    """Inserts and deletes of committed transactions, with ``replay_rank``.

    A commit counts even if there is a rollback as well.  Transactions follow
    each other by their first operation, their operations by lsn.  The rank is
    the sum of the operations of earlier spans of ``SPAN`` numbers, of earlier
    transactions in the span, and of the place in the transaction: as numbers are unique, no
    window sees more than a span, a transaction, or one row a span.
    """
    ops = log.where(F.col(kind).isin("insert", "delete"))
    done = log.where(F.col(kind) == "commit").select(F.col(tx).alias("__tx")).distinct()
    kept = ops.join(done, F.col(tx) == F.col("__tx"), "left_semi")
    firsts = kept.groupBy(tx).agg(F.min(lsn).alias("__first"), F.count("*").alias("__n"))
    firsts = firsts.withColumn("__span", F.floor(F.col("__first") / F.lit(SPAN)))
    spans = firsts.groupBy("__span").agg(F.sum("__n").alias("__of_span"))
    earlier = F.coalesce(F.sum("__of_span").over(W.orderBy("__span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_span = F.sum("__n").over(W.partitionBy("__span").orderBy("__first").rowsBetween(W.unboundedPreceding, -1))
    starts = firsts.join(spans.select("__span", earlier.alias("__earlier")), "__span").select(
        F.col(tx).alias("__t"), (F.col("__earlier") + F.coalesce(in_span, F.lit(0))).alias("__before")
    )
    within = F.row_number().over(W.partitionBy(tx).orderBy(lsn))
    return (
        kept.join(starts, F.col(tx) == F.col("__t"))
        .withColumn("replay_rank", F.col("__before") + within)
        .drop("__t", "__before")
    )


def max_lsn(log: DataFrame, lsn: str = "lsn") -> DataFrame:
    return log.agg(F.coalesce(F.max(lsn), F.lit(0)).alias("max_lsn"))


class WriteAheadLog:
    """A log in a parquet folder; numbers go on after a truncation."""

    SCHEMA = "lsn long, tx_id long, kind string, doc_id long, payload string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._pending = spark, path, []
        self._last = int(max_lsn(self.records()).first()[0])

    def _append(self, tx: int, kind: str, doc: int | None = None, payload: str | None = None) -> int:
        self._last += 1
        self._pending.append((self._last, tx, kind, doc, payload))
        if len(self._pending) >= PENDING:
            self.flush()
        return self._last

    def insert(self, tx: int, doc: int, payload: str) -> int:
        return self._append(tx, "insert", doc, payload)

    def delete(self, tx: int, doc: int, line: str) -> int:
        return self._append(tx, "delete", doc, line)

    def commit(self, tx: int) -> int:
        return self._append(tx, "commit")

    def rollback(self, tx: int) -> int:
        return self._append(tx, "rollback")

    def flush(self) -> None:
        self.spark.createDataFrame(self._pending, self.SCHEMA).write.mode("append").parquet(self.path)
        self._pending.clear()

    def records(self) -> DataFrame:
        new = self.spark.createDataFrame(self._pending, self.SCHEMA)
        if not files.exists(self.spark, self.path):
            return new
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).union(new)

    def replay(self) -> DataFrame:
        return wal_replay(self.records()).orderBy("replay_rank")

    def truncate(self) -> None:
        self._pending.clear()
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)
