"""The dialect: what it reads, what it plans, what it gives."""

import pytest

from oakmill.engine import Engine
from oakmill.errors import SqlError, UnknownTable
from oakmill.plans.sql import Join, parse, plan


@pytest.mark.parametrize(
    ("text", "columns", "where", "limit"),
    [
        ("SELECT * FROM trips", (), None, -1),
        ("SELECT * FROM trips WHERE fare = 12", (), ("fare", "12"), -1),
        ("SELECT * FROM trips WHERE trips.zone = 'north'", (), ("zone", "north"), -1),
        ("SELECT fare FROM trips LIMIT 7", ("fare",), None, 7),
        ("select  Fare , zone from Trips where DAY=5 limit 3 ;", ("fare", "zone"), ("day", "5"), 3),
    ],
)
def test_reads(text, columns, where, limit):
    s = parse(text)
    assert (s.table, s.columns, s.where, s.limit) == ("trips", columns, where, limit)


def test_reads_joins():
    assert parse("SELECT * FROM trips JOIN riders ON trips.rider = riders.no").join == Join("riders", "rider", "no", "AUTO")
    assert parse("SELECT * FROM a INNER JOIN b ON x = y HASH").join.hint == "HASH"
    s = parse("SELECT * FROM a JOIN b ON x = y nested_loop WHERE z = 1 LIMIT 2")
    assert (s.join.hint, s.where, s.limit) == ("NESTED_LOOP", ("z", "1"), 2)


@pytest.mark.parametrize(
    "text",
    ["", "INSERT INTO trips VALUES (1)", "DELETE FROM trips", "UPDATE trips SET a = 1", "SELECT FROM trips", "SELECT * FROM",
     "SELECT * FROM a WHERE b > 1", "SELECT * FROM a ORDER BY b", "SELECT * FROM a INNER b", "SELECT * FROM a LIMIT x",
     "SELECT * FROM a JOIN b", "SELECT * FROM a JOIN b ON x", "SELECT * FROM a WHERE b ="],
)
def test_rejects(text):
    with pytest.raises(SqlError, match="SQL-001"):
        parse(text)


@pytest.mark.parametrize(
    ("text", "indexes", "scan", "how"),
    [
        ("SELECT * FROM d", set(), "full scan", None),
        ("SELECT * FROM d WHERE id = 1", set(), "full scan on id", None),
        ("SELECT * FROM d WHERE id = 1", {"lsmtree", "bplustree", "hashindex"}, "hash index scan on id", None),
        ("SELECT * FROM d WHERE id = 1", {"lsmtree", "bplustree"}, "B+tree index scan on id", None),
        ("SELECT * FROM d WHERE id = 1", {"lsmtree", "btree"}, "LSM index scan on id", None),
        ("SELECT * FROM d WHERE id = 1", {"btree"}, "full scan on id", None),
        ("SELECT * FROM d WHERE id = 'x'", {"hashindex"}, "full scan on id", None),
        ("SELECT * FROM d WHERE f = 1", {"gin", "bitmap"}, "token index scan on f", None),
        ("SELECT * FROM d WHERE f = 1", {"bitmap"}, "bitmap index scan on f", None),
        ("SELECT * FROM d JOIN e ON a = b", set(), "full scan", "hash join"),
        ("SELECT * FROM d JOIN e ON a = id", {"hashindex"}, "full scan", "index join by hash index"),
        ("SELECT * FROM d JOIN e ON a = id", {"bplustree"}, "full scan", "index join by B+tree index"),
        ("SELECT * FROM d JOIN e ON a = b WHERE id = 3", {"hashindex"}, "hash index scan on id", "nested loop join"),
        ("SELECT * FROM d JOIN e ON a = id HASH", {"hashindex"}, "full scan", "hash join"),
        ("SELECT * FROM d JOIN e ON a = id NESTED_LOOP", {"hashindex"}, "full scan", "nested loop join"),
    ],
)
def test_plans(text, indexes, scan, how):
    got = plan(parse(text), indexes)
    assert (got.scan, got.join) == (scan, how)


#: no (of which 4 is a part of 41), zone, note
STOPS = [(i, ("pier", "mill lane", "Old Mill")[i % 3], f"stop {i}") for i in range(60)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("stops", spark.createDataFrame(STOPS, "id int, zone string, note string"))
    e.register("more", spark.createDataFrame([(4, "x"), (41, "y"), (None, "z"), (77, "w")], "ref int, text string"))
    return e


def test_rows(engine):
    assert engine.sql("SELECT * FROM stops WHERE id = 5").collect()[0].note == "stop 5"
    assert engine.sql("SELECT * FROM stops WHERE id = 999999").count() == 0
    assert engine.sql("SELECT * FROM stops WHERE id = 4").count() == 1
    assert engine.sql("SELECT * FROM stops WHERE id = abc").count() == 0
    assert engine.sql("SELECT * FROM stops LIMIT 3").count() == 3
    assert engine.sql("SELECT * FROM stops LIMIT 0").count() == 0
    assert engine.sql("SELECT * FROM stops LIMIT 1000").count() == 60
    assert engine.sql("SELECT note FROM stops").columns == ["note"]
    with pytest.raises(UnknownTable):
        engine.sql("SELECT * FROM nothing")


@pytest.mark.parametrize("hint", ["", "HASH", "NESTED_LOOP"])
def test_joined_rows(engine, hint):
    got = engine.sql(f"SELECT id, text FROM stops JOIN more ON id = ref {hint}").collect()
    assert sorted(tuple(r) for r in got) == [(4, "x"), (41, "y")]
    assert engine.sql(f"SELECT * FROM stops JOIN stops ON id = id {hint} WHERE id = 5").count() == 1


STATEMENTS = [
    "SELECT * FROM stops WHERE id = 41", "SELECT * FROM stops WHERE id = 4", "SELECT note FROM stops WHERE id = 99999999999",
    "SELECT id FROM stops WHERE zone = 'pier'", "SELECT id FROM stops WHERE zone = 'mill'", "SELECT id FROM stops WHERE zone = 'pier ' LIMIT 5",
    "SELECT * FROM stops WHERE note = stop", "SELECT ref, note FROM more JOIN stops ON ref = id", "SELECT note FROM stops JOIN more ON id = ref WHERE id = 41",
]


@pytest.mark.parametrize(
    ("kind", "scan", "node"),
    [
        ("hashindex", "hash index scan on id", "index-stops-hashindex"), ("bplustree", "B+tree index scan on id", "index-stops-bplustree"),
        ("lsmtree", "LSM index scan on id", "index-stops-lsmtree"), ("gin", "token index scan on zone", "index-stops-gin"),
        ("bitmap", "bitmap index scan on zone", "index-stops-bitmap"), ("btree", "full scan on id", None),
    ],
)
def test_statements_read_the_index_and_give_the_same_rows(spark, kind, scan, node):
    e = Engine(spark)
    e.register("stops", spark.createDataFrame(STOPS, "id int, zone string, note string"))
    e.register("more", spark.createDataFrame([(4, "x"), (41, "y"), (None, "z"), (77, "w")], "ref int, text string"))
    before = [sorted(map(tuple, e.sql(t).collect())) for t in STATEMENTS]
    e.catalog.create_index("public", "stops", kind)
    assert [sorted(map(tuple, e.sql(t).collect())) for t in STATEMENTS] == before
    text = STATEMENTS[3] if kind in ("gin", "bitmap") else STATEMENTS[0]
    assert e.explain(text).scan == scan
    files = e.sql(text).inputFiles()
    assert all(node in f for f in files) and files if node else not files
    if kind == "hashindex":
        assert e.explain(STATEMENTS[-2]).join == "index join by hash index"
        plan = e.sql(text)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(__bucket" in plan.replace("#", "") or "__bucket" in plan.split("PartitionFilters")[1].split("]")[0]
        assert any("index-stops-hashindex" in f for f in e.sql(STATEMENTS[-2]).inputFiles())
    e.catalog.drop_index("public", "stops", kind)
    assert e.explain(text).scan.startswith("full scan")
