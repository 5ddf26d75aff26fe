"""Indexes, logs, snapshots."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oakmill.errors import InactiveTransaction
from oakmill.operators import versions as v


def test_upsert_and_remove(spark):
    a = spark.createDataFrame([(5, 50, 0)], "k int, val int, at int")
    b = spark.createDataFrame([(5, 99, 1), (6, 60, 1)], "k int, val int, at int")
    now = v.upsert(a, b, "k", "at")
    assert {r.k: r.val for r in now.collect()} == {5: 99, 6: 60}
    assert [r.k for r in v.remove(now, "k", spark.createDataFrame([(5,), (9,)], "k int")).collect()] == [6]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.one_of(st.none(), st.integers(0, 99))), min_size=1, max_size=25))
def test_lsm_model(spark, ops):
    rows = [(k, i, x, x is None, i // v.MEMTABLE_KEYS) for i, (k, x) in enumerate(ops)]
    log = spark.createDataFrame(rows, "key int, seq int, value int, deleted boolean, run int")
    model = {}
    for k, x in ops:
        model.pop(k, None) if x is None else model.update({k: x})
    assert {r.key: r.value for r in v.lsm_read(log).collect()} == model
    packed = v.lsm_compact(log)
    assert {r.key: r.value for r in v.lsm_read(packed).collect()} == model
    assert packed.count() <= log.count()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.one_of(st.none(), st.integers(0, 99))), min_size=1, max_size=24), st.integers(0, 3))
def test_lsm_tree_model(spark, tmp_path_factory, ops, merges):
    tree, model = v.LsmTree(spark, str(tmp_path_factory.mktemp("lsm"))), {}
    for k, x in ops:
        tree.remove(k) if x is None else tree.put(k, x)
        model[k] = x
    keys = {}
    flushed = 0
    for k, x in ops:  # a run for each five distinct keys
        keys[k] = x
        if len(keys) == v.MEMTABLE_KEYS:
            flushed, keys = flushed + 1, {}
    assert len(tree.runs()) == flushed
    live = {k: x for k, x in model.items() if x is not None}
    for step in range(merges + 2):
        assert {r.key: r.value for r in tree.read().collect()} == live
        assert all(tree.get(k) == model.get(k) for k in range(1, 4))
        if step == merges:
            tree.flush_all()
            assert len(tree.runs()) == max(1, flushed - merges) + bool(keys) if flushed else bool(keys)
        else:
            tree.merge()
    again = v.LsmTree(spark, tree.folder)
    assert {r.key: r.value for r in again.read().collect()} == live
    tree.drop()


def test_lsm_filters_spare_runs(spark, tmp_path):
    tree = v.LsmTree(spark, str(tmp_path / "lsm"))
    for run in range(3):
        rows = spark.range(1000).select((F.col("id") * 3 + run).alias("key"), F.col("id").alias("value"), F.lit(False).alias("deleted"), F.col("id").alias("seq"))
        tree.ingest(rows)
    assert [tree.get(k) for k in (0, 1, 2, 2999)] == [0, 0, 0, 999]
    assert tree.hits >= 4 and tree.misses >= 2
    before = tree.misses
    assert tree.get(10**9) is None and tree.misses + 3 - before >= 3
    held = [tree.may_hold(name, k) for run, name in enumerate(tree.runs()) for k in range(run, 60, 3)]
    assert all(held)


def test_dirty_and_unrepeatable_reads(spark):
    s = v.VersionStore(spark)
    t0 = s.begin("READ_COMMITTED")
    s.insert(t0, 42, 1)
    assert s.value(s.begin("READ_UNCOMMITTED"), 42) == 1
    assert s.value(s.begin("READ_COMMITTED"), 42) is None
    assert s.value(t0, 42) is None  # not even its own
    s.commit(t0)
    rc, rr = s.begin("READ_COMMITTED"), s.begin("REPEATABLE_READ")
    t1 = s.begin("READ_COMMITTED")
    s.delete(t1, 42)
    s.insert(t1, 42, 2)
    s.commit(t1)
    assert s.value(rc, 42) == 2 and s.value(rr, 42) == 1
    assert s.value(s.begin("SERIALIZABLE"), 42) == 2


def test_phantoms_and_rollback(spark, tmp_path):
    s = v.VersionStore(spark)
    t = s.begin("READ_COMMITTED")
    s.insert(t, 10, 1)
    s.insert(t, 15, 1)
    s.commit(t)
    s.flush(str(tmp_path / "versions"))
    rc, ser = s.begin("READ_COMMITTED"), s.begin("SERIALIZABLE")
    t = s.begin("READ_COMMITTED")
    s.insert(t, 17, 1)
    s.commit(t)
    bad = s.begin("READ_COMMITTED")
    s.insert(bad, 99, 1)
    s.rollback(bad)
    assert [r.doc_id for r in s.range_scan(rc, 10, 20).collect()] == [10, 15, 17]
    assert [r.doc_id for r in s.range_scan(ser, 10, 20).collect()] == [10, 15]
    assert s.value(s.begin("READ_UNCOMMITTED"), 99) is None
    assert s.visible_count(rc) == 3 and s.visible_count(ser) == 2
    with pytest.raises(InactiveTransaction):
        s.insert(bad, 1, 1)
    with pytest.raises(InactiveTransaction):
        s.commit(t)


def test_lower_writer_that_commits_late_is_seen(spark):
    s = v.VersionStore(spark)
    low, high = s.begin("READ_COMMITTED"), s.begin("READ_COMMITTED")
    s.insert(high, 1, 1)
    s.commit(high)
    reader = s.begin("REPEATABLE_READ")
    s.insert(low, 2, 2)
    s.commit(low)
    assert s.value(reader, 2) == 2


def test_wal(spark, tmp_path):
    w = v.WriteAheadLog(spark, str(tmp_path / "wal"))
    w.insert(1, 10, "a")
    w.insert(2, 20, "b")
    w.delete(1, 5, "5,x")
    w.commit(1)
    w.insert(3, 7, "c")
    w.rollback(3)
    assert [(r.kind, r.doc_id) for r in w.replay().collect()] == [("insert", 10), ("delete", 5)]
    w.commit(3)  # a commit wins over a rollback
    w.flush()
    again = v.WriteAheadLog(spark, str(tmp_path / "wal"))
    assert [r.doc_id for r in again.replay().collect()] == [10, 5, 7]
    last = again.commit(9)
    again.truncate()
    assert again.replay().count() == 0
    assert again.insert(10, 1, "z") == last + 1


def test_replay_ranks_span_by_span(spark, monkeypatch):
    rows = [(i, i % 7, "commit" if i > 90 else "insert", i) for i in range(98)]
    log = spark.createDataFrame(rows, "lsn long, tx_id long, kind string, doc_id long")
    want = [r.lsn for r in v.wal_replay(log).orderBy("replay_rank").collect()]
    assert want == sorted(range(91), key=lambda i: (i % 7, i))
    monkeypatch.setattr(v, "SPAN", 3)
    got = v.wal_replay(log).orderBy("replay_rank").collect()
    assert [r.lsn for r in got] == want and [r.replay_rank for r in got] == list(range(1, 92))
