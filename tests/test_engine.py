"""Catalog, scans, aggregates, storage."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oakmill.catalog import Catalog
from oakmill.engine import Engine
from oakmill.errors import (
    DuplicateIndex, MalformedRequest, MissingDocument, MissingIndex, UnknownColumn, UnknownIndexType, UnknownTable,
)
from oakmill.operators import pruning, query
from oakmill.sources import docfile, files, tables
from oakmill.sources.zones import ZonedTable

#: trip, rider, fare, zone, day
TRIPS = [(i, (i * 7) % 6, 10 + (i * 37) % 90, ("north", "south", "harbour")[i * i % 3 if i % 4 else 2], 730 + (i * 11) % 28) for i in range(40)]
RIDERS = [(r, f"rider {r}", ("north", "south")[r % 2]) for r in range(5)]  # rider 5 has trips and no row


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("trips", tables.rows(spark, TRIPS, "trip int, rider int, fare int, zone string, day int"))
    e.register("Riders", tables.rows(spark, RIDERS, "rider int, name string, zone string"))
    return e


def test_catalog(engine):
    c = engine.catalog
    assert len(c) == 2 and c.names("PUBLIC") == ["trips", "riders"]
    assert c.get("public", "none") is None
    with pytest.raises(UnknownTable):
        c.require("public", "none")
    assert c.require("public", "TRIPS").column("Fare").dataType.simpleString() == "int"
    with pytest.raises(UnknownColumn):
        c.require("public", "trips").column("nothing")


def test_catalog_replaces_and_keeps_order(spark):
    c = Catalog(spark)
    a, b = spark.range(1), spark.range(2)
    c.register("s", "x", a)
    c.register("s", "y", a)
    c.register("S", "X", b)
    assert c.names("s") == ["x", "y"] and c.require("s", "x").data is b
    c.set_clustered_key("s", "x", "ID")
    assert c.require("s", "x").clustered_by == "id"
    c.drop_all()
    assert len(c) == 0


def test_indexes(spark):
    c = Catalog(spark)
    c.register("s", "t", spark.range(9).select("id", F.lit("x").alias("v")))
    assert c.create_index("s", "t", "BPlusTree")
    with pytest.raises(DuplicateIndex, match="DB-402"):
        c.create_index("s", "t", "bplustree")
    with pytest.raises(MissingIndex, match="DB-403"):
        c.drop_index("s", "t", "gin")
    with pytest.raises(UnknownIndexType, match="DB-404"):
        c.create_index("s", "t", "rtree")
    path = c.require("s", "t").indexes["bplustree"].path
    c.drop_index("s", "t", "bplustree")
    assert not files.exists(spark, path) and not c.require("s", "t").indexes
    with pytest.raises(UnknownColumn):
        c.create_index("s", "t", "gin", "id")


def test_select(engine):
    zones = [t[3] for t in TRIPS]
    assert engine.select("trips", "day", 1).count() == 0
    for zone in set(zones):
        assert engine.select("trips", "zone", zone).count() == zones.count(zone)
    assert engine.select("trips").count() == len(TRIPS)
    assert engine.select("trips", "zone", None, ["trip"]).count() == len(TRIPS)
    # the filtered column needn't be in the result
    assert engine.select("trips", "zone", "harbour", ["trip"]).columns == ["trip"]
    with pytest.raises(UnknownColumn):
        engine.select("trips", columns=["nothing"])


def test_aggregates(engine):
    fares = [t[2] for t in TRIPS]
    row = engine.aggregate("trips", total=F.sum("fare"), mean=F.avg("fare")).first()
    assert (row.total, row.mean) == (sum(fares), pytest.approx(sum(fares) / len(fares)))
    want = {}
    for _, _, fare, zone, _ in TRIPS:
        want[zone] = want.get(zone, 0) + fare
    assert {r.zone: r.total for r in engine.group_by("trips", "zone", total=F.sum("fare")).collect()} == want
    assert query.count_where(engine.table("trips"), F.col("fare") > 50).first().n == sum(f > 50 for f in fares)


def test_join_of_registered_tables(engine):
    known = [t for t in TRIPS if t[1] < 5]
    for strategy in ("broadcast", "hash", "merge", "nested_loop", "index", "auto"):
        got = engine.join("trips", "rider", "riders", "rider", ["trip", "name", "zone"], strategy).collect()
        assert sorted(tuple(r) for r in got) == sorted((t[0], f"rider {t[1]}", t[3]) for t in known)  # zone is the left's


def test_group_apply_sees_nulls_and_the_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "k string, v double")
    got = {r.k: r.n for r in query.group_apply(df, "k", "v", len, "n", "long").collect()}
    assert got == {"a": 2, None: 1}


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_group_apply_takes_groups_from_sorted_batches(spark, rows):
    """Groups that go over batches, one of nulls, of not-a-numbers, and of both zeros; no call of pandas through Spark for each."""
    values = [(k, None if i % 4 == 0 else (1 << 60) + i) for k in (None, float("nan"), 0.0, -0.0, 1.5, 2.0, 3.0) for i in range(1, 9 if k == 2.0 else 4)]
    df = spark.createDataFrame(values, "k double, v long").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = query.group_apply(df, "k", "v", lambda v: f"{v.name} {v.dtype} {len(v)} {int(v.isna().sum())} {list(v.index)[-1]} {v.max()}", "n", "string")
        assert "InPandas" not in got._jdf.queryExecution().toString()
        found = sorted((str(r.k), r.n) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    top = (1 << 60) + 3
    assert found == sorted(
        [(k, f"v int64 3 0 2 {top}") for k in ("None", "nan", "1.5", "3.0")] + [("0.0", f"v int64 6 0 5 {top}"), ("2.0", f"v float64 8 2 7 {float(1 << 60)}")]
    )
    whole = {r.k: r.n for r in query.group_apply(df, "k", "v", lambda v: None if v.isna().any() else int(v.sum()), "n", "long").collect()}
    assert whole[1.5] == (3 << 60) + 6 and whole[2.0] is None


@pytest.mark.parametrize("top", [1_000_000, 0])
def test_row_range_is_clamped(spark, monkeypatch, top):
    """As a top-k, and by sorted partitions."""
    monkeypatch.setattr(query, "TOP_ROWS", top)
    df = spark.range(20)
    assert [r.id for r in query.row_range(df.repartition(3), "id", 4, 11).collect()] == list(range(4, 11))
    assert query.row_range(df, "id", 20, 30).count() == 0
    assert [r.id for r in query.row_range(df, "id", 18, 99).collect()] == [18, 19]
    assert query.row_range(df, "id", 5, 5).count() == 0


def test_rows_need_the_right_arity(spark):
    with pytest.raises(Exception):
        tables.rows(spark, [(1, 2, 3)], "a int, b int").collect()


def test_clustered_files_have_disjoint_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")), path, cluster_by="k", partitions=4)
    ranges = sorted(
        (r.low, r.high)
        for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
    )
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    plan = spark.read.parquet(path).where("k = 5").select("k")._jdf.queryExecution().toString()
    assert "EqualTo(k,5)" in plan


def test_zone_maps(spark):
    df = spark.createDataFrame([(0, 5), (0, 25), (1, None)], "partition_id int, d int")
    zones = pruning.zone_map(df, ["d"])
    assert {r.partition_id for r in pruning.may_hold(zones, "d", 31).collect()} == {1}
    for v in (5, 15, 25):  # bounds belong to the range; a zone of nulls is kept
        assert {r.partition_id for r in pruning.may_hold(zones, "d", v).collect()} == {0, 1}


def opened(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_a_zoned_table_opens_few_files(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 4000).alias("other"), F.nullif(F.col("id") % 50, F.lit(0)).alias("odd"))
    t = ZonedTable.write(rows.repartition(7), str(tmp_path / "t"), "k", bloom=["other"], rows_per_file=100)
    files = opened(t.data)
    assert len(files) >= 40 and max(r["count"] for r in t.data.groupBy(F.input_file_name()).count().collect()) <= 100
    one = t.select("k", 1234)
    assert [tuple(r) for r in one.collect()] == [(1234, 1234 * 7919 % 4000, 34)] and len(opened(one)) == 1
    by_bloom = t.select("other", 17, ["k"])
    assert [(r.k * 7919) % 4000 for r in by_bloom.collect()] == [17] and len(opened(by_bloom)) < 8
    assert t.select("k", 9999).count() == 0 and t.select("k", None).count() == 0 and t.select("k", "x").count() == 0
    assert t.select("odd", 7, ["k"]).count() == 80  # neither zone nor filter: all files
    report = t.report("other", 17).first()
    assert report.partitions == report.after_ranges == len(files) and report.after_bloom == len(opened(by_bloom))
    with pytest.raises(UnknownColumn):
        t.select("nothing", 1)


def test_micro_partitions_lie_in_one_file(spark, tmp_path):
    t = ZonedTable.write(spark.range(1000), str(tmp_path / "t"), "id", bloom=["id"], partition=F.floor(F.col("id") / 100))
    assert t.zones.count() == t.zones.select("__partition").distinct().count() == 10
    assert [r.id for r in t.select("id", 777).collect()] == [777] and t.report("id", 777).first().after_ranges == 1
    assert t.rows().columns == ["id"]


def test_an_empty_zoned_table(spark, tmp_path):
    t = ZonedTable.write(spark.range(0), str(tmp_path / "t"), "id", bloom=["id"])
    assert t.select("id", 1).count() == 0 and t.report("id", 1).first().partitions == 0


def test_a_stored_table_is_clustered_by_its_key(spark):
    e = Engine(spark)
    e.register("trips", tables.rows(spark, TRIPS, "trip int, rider int, fare int, zone string, day int"))
    e.catalog.set_clustered_key("public", "trips", "Day")
    e.catalog.store("public", "trips", rows_per_file=5)
    for day in {t[4] for t in TRIPS}:
        got = e.select("trips", "day", day, ["trip"])
        assert sorted(r.trip for r in got.collect()) == sorted(t[0] for t in TRIPS if t[4] == day)
    entry = e.catalog.require("public", "trips")
    assert len(opened(e.select("trips", "day", TRIPS[0][4]))) < len(opened(entry.data))
    assert entry.data.columns == ["trip", "rider", "fare", "zone", "day"]


@pytest.mark.parametrize("most", [1 << 26, 1])
def test_bloom(spark, monkeypatch, most):
    """As one broadcast map, and by a join of words."""
    monkeypatch.setattr(pruning, "BROADCAST_BITS", most)
    assert pruning.bloom_params(100, 0.01) == (959, 7)
    n = 10_000
    params = pruning.bloom_params(n, 0.01)
    words = pruning.bloom_words(spark.range(n), "id", *params)
    rows = spark.range(2 * n).select("id", (F.col("id") < n).alias("inside")).union(spark.createDataFrame([(None, None)], "id long, inside boolean"))
    got = {(r.inside, r.held): r["count"] for r in pruning.bloom_member(rows, "id", words, *params).groupBy("inside", "held").count().collect()}
    assert (True, False) not in got and got[True, True] == n and got[None, False] == 1
    assert got.get((False, True), 0) <= 0.03 * n
    assert abs(pruning.false_positive_rate(*params, n) - 0.01) < 0.002


def test_document_file(spark, tmp_path):
    path = str(tmp_path / "notes.dat")
    with open(path, "w") as f:
        f.write('0,{"k":0}\n1,{"a":"x,y"}\n\n1,{"a":"later"}\n')
    got = {r.doc_id: r.json for r in docfile.read_documents(spark, path).collect()}
    assert got == {0: '{"k":0}', 1: '{"a":"later"}'}
    assert docfile.line_exists(spark, path, ' 0,{"k":0} ') and not docfile.line_exists(spark, path, "0")
    assert docfile.next_id(docfile.read_documents(spark, path)) == 2
    assert docfile.delete_matching(spark, str(tmp_path), r".*\.dat") == ["notes.dat"]


def test_the_last_of_many_appends_holds(spark, tmp_path):
    path = str(tmp_path / "notes")
    for k in range(12):
        rows = [(i, f"write {k}") for i in range(0, 40, k + 1)]
        docfile.write_documents(spark.createDataFrame(rows, "doc_id int, json string").repartition(3), path)
    got = {r.doc_id: r.json for r in docfile.read_documents(spark, path).collect()}
    assert got == {i: f"write {max(k for k in range(12) if i % (k + 1) == 0)}" for i in range(40)}


def test_a_file_in_many_blocks_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "big.dat")
    with open(path, "w") as f:
        f.writelines(f"{i % 7},{i}\n" for i in range(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.doc_id: int(r.json) for r in docfile.read_documents(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i % 7: i for i in range(3000)}


def test_document_store(spark, tmp_path):
    store = docfile.DocumentStore(spark, str(tmp_path / "docs"))
    assert store.find(0) is None
    notes = [f'{{"note":"no. {i}","k":{i * i}}}' for i in range(5)]
    assert store.append(notes) == [0, 1, 2, 3, 4]
    reader = store.documents()
    assert store.delete(1) == f"1,{notes[1]}"
    assert store.find(1) is None and store.find("1") is None
    assert reader.count() == 5 and store.documents().count() == 4  # a reader keeps its version
    assert store.append(['{"a":\n1}']) == [5] and store.find(5) == '{"a":1}'
    with pytest.raises(MissingDocument, match="DB-405"):
        store.delete(99)
    with pytest.raises(MalformedRequest, match="DB-401"):
        store.append([""])
    before = sorted(map(tuple, store.documents().collect()))
    store.compact()
    assert sorted(map(tuple, store.documents().collect())) == before and len(store._versions()) == 1
    assert store.delete(5) and store.append(['{"b":2}']) == [6]  # ids aren't used again
    store.drop()
    assert store.documents().count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99)), max_size=20))
def test_newest_is_last(spark, rows):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], "k int, i int, v int")
    assert {r.k: r.v for r in docfile.newest(df, "k", ["i"]).collect()} == dict(rows)


def test_append_numbers_rows_in_order(spark):
    docs = spark.createDataFrame([(4, "x")], "doc_id long, json string")
    payloads = spark.range(100).repartition(5).sortWithinPartitions("id").select(F.col("id").cast("string").alias("json"))
    got = docfile.append(docs, payloads).collect()
    assert sorted(r.doc_id for r in got) == [4, *range(5, 105)]


def test_files_that_are_rolled_over_are_many_tasks_work(spark, monkeypatch, tmp_path):
    """However few bytes the rows have."""
    from oakmill.sources import tables

    monkeypatch.setattr(tables, "FILES_A_TASK", 50, raising=False)
    tables.write(spark.range(2000), str(tmp_path / "rolled"), cluster_by="id", rows_per_file=10)
    files = spark.read.parquet(str(tmp_path / "rolled")).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).collect()
    assert sum(r.n for r in files) == 2000 and max(r.n for r in files) <= 10 and all(r.b - r.a == r.n - 1 for r in files)
    assert len({r.f[:10] for r in files}) == 4
