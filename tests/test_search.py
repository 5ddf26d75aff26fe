"""Tokens, postings, bitmaps."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oakmill.functions.text import column_tokens, document_tokens, trim_all
from oakmill.operators import indexes, search

WORDS = [("red kite over moor", 7), ("Kite: red, red", 8), ("moor {grey}", 9), ("", 10), (None, 11)]


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def posted(spark):
    return spark.createDataFrame(WORDS, "t string, o long")


def tokens(spark, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(document_tokens(F.col("v"))).collect()]


def test_document_tokens(spark):
    assert tokens(spark, ['{"Note":"no. 7","k":[49]}', None, "", "   ", "A,b  C", "\x01ab\x02 c", "ΑΣ:Β ΑΣ"]) == [
        ["note", "no.", "7", "k", "49"], [], [], [], ["a", "b", "c"], ["ab", "c"], ["ας", "β", "ας"],
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aB{}\":,[] \t\n1\x01\x1f", max_size=12), max_size=8))
def test_document_tokens_model(spark, values):
    import re

    def model(v):
        parts = re.split(r"[ \t\n\x0b\f\r]+|,", re.sub(r'[{}":\[\]]', " ", v))
        edge = "".join(map(chr, range(33)))
        return [p.strip(edge).lower() for p in parts if p.strip(edge)]

    assert tokens(spark, values) == [model(v) for v in values]


def test_column_tokens(spark):
    df = spark.createDataFrame([("Big, red!",), (" -4.50 ",), ("!!!",), (None,)], "v string")
    assert [r[0] for r in df.select(column_tokens("C", F.col("v"))).collect()] == [["c:big", "c:red"], ["c:-4.50"], [], []]


def test_trim_all(spark):
    assert spark.range(1).select(trim_all(F.lit("\tA b \x00"))).first()[0] == "A b"


def test_token_search(posted):
    args = (posted, "o", "t")
    assert ids(search.token_search(*args, "KITE")) == [7, 8]
    assert ids(search.token_search_all(*args, ["red", "moor"])) == [7]
    assert ids(search.token_search_all(*args, ["red", "nothere"])) == []
    assert ids(search.token_search_all(*args, [])) == []
    assert ids(search.token_search_any(*args, ["grey", "over"])) == [7, 9]
    assert ids(search.token_search_any(*args, [])) == []
    assert search.token_count(posted, "t").first().n == 5


def test_occurrences(spark, posted):
    assert ids(search.token_search(posted, "o", "t", "red", occurrences=True)) == [7, 8, 8]
    assert ids(search.token_search(posted, "o", "t", "red")) == [7, 8]


def test_token_index(spark, posted, tmp_path):
    """Stored postings answer as the scan does; they take inserts and tombstones, and lines bring them back."""
    index = indexes.TokenIndex.write(posted, str(tmp_path / "index"), "o", "t")

    def agrees(index, docs):
        args = (docs, "o", "t")
        for t in ("KITE", "red", "grey", "none"):
            assert ids(index.find(t)) == ids(search.token_search(*args, t))
            assert ids(index.find(t, occurrences=True)) == ids(search.token_search(*args, t, occurrences=True))
        for ts in (["red", "MOOR"], ["red", "red"], ["kite", "none"], []):
            assert ids(index.find_all(ts)) == ids(search.token_search_all(*args, ts))
            assert ids(index.find_any(ts)) == ids(search.token_search_any(*args, ts))
        assert index.token_count().first().n == search.token_count(docs, "t").first().n

    agrees(index, posted)
    late = spark.createDataFrame([("grey kite", 40), ("pipe|d,1", 41)], "t string, o long")
    index.insert(late, "o", "t")
    agrees(index, posted.union(late))
    index.remove(spark.createDataFrame([(7,), (9,), (99,)], "o long"))
    left = posted.union(late).where("o not in (7, 9)")
    agrees(index, left)
    index.insert(posted.where("o = 7"), "o", "t")  # seen again
    left = left.union(posted.where("o = 7"))
    agrees(index, left)
    index.save(str(tmp_path / "saved"))
    agrees(indexes.TokenIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "loaded")), left)
    none = indexes.TokenIndex.load(spark, str(tmp_path / "nothing"), str(tmp_path / "empty"))
    assert ids(none.find("red")) == [] and none.token_count().first().n == 0
    index.remove(left.select("o"))
    assert index.token_count().first().n == 0


def test_is_indexed(spark):
    posted = search.column_postings(spark.createDataFrame([("a b", 1, 2)], "C string, p long, r long"), "C", "p", "r")
    assert search.is_indexed(posted, "c") and not search.is_indexed(posted, "p")


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, " Active"), (1, "premium"), (2, "ACTIVE"), (3, "premium"), (32769, "active"), (0, None)]
    return spark.createDataFrame(rows, "doc_id long, value string")


def test_bitmaps(spark, pairs, tmp_path):
    assert ids(search.bitmap_search(pairs, ["active"])) == [1, 2, 32769]
    assert ids(search.bitmap_search(pairs, ["active", "Premium"], every=True)) == [1]
    assert ids(search.bitmap_search(pairs, ["active", "none"], every=True)) == []
    assert ids(search.bitmap_search(pairs, [], every=True)) == ids(search.bitmap_search(pairs, [])) == []
    assert ids(search.bitmap_search(pairs, ["active", "none"])) == [1, 2, 32769]
    assert ids(search.bitmap_search(pairs, [""])) == [0]
    got = {r.value: r.n for r in search.bitmap_cardinality(pairs).collect()}
    assert got == {"active": 3, "premium": 2, "": 1}
    index = indexes.BitmapIndex.write(pairs, str(tmp_path / "bitmaps"))
    index.save(str(tmp_path / "saved"))
    for stored in (index, indexes.BitmapIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "loaded"))):
        assert ids(stored.find(["active", "PREMIUM "], every=True)) == [1]
        assert ids(stored.find(["premium", ""])) == [0, 1, 3]
        assert {r.value: r.n for r in stored.cardinality().collect()} == got


@settings(max_examples=4, deadline=None)
@given(st.sets(st.integers(0, 100_000), max_size=200))
def test_expanded_bits_are_the_ids(spark, numbers):
    pairs = spark.createDataFrame([(n, "v") for n in numbers], "doc_id long, value string")
    assert ids(search.bitmap_search(pairs, ["v"])) == sorted(numbers)


def test_saved_lines_stay_short(spark, tmp_path):
    """A token of all documents is saved on several lines, which are read back whole and merged."""
    docs = spark.range(30_000).selectExpr("id AS o", "'all All a|b' AS t").union(spark.createDataFrame([(7, "all once")], "o long, t string"))
    index = indexes.TokenIndex.write(docs, str(tmp_path / "index"), "o", "t")
    index.save(str(tmp_path / "saved"))
    lines = spark.read.text(str(tmp_path / "saved")).where("value LIKE 'all|%'").selectExpr("size(split(value, ',')) AS n").collect()
    assert sum(r.n for r in lines) == 60_001 and max(r.n for r in lines) <= 20_001
    loaded = indexes.TokenIndex.load(spark, str(tmp_path / "saved"), str(tmp_path / "loaded"))
    assert loaded.postings().exceptAll(index.postings()).isEmpty() and loaded.postings().count() == index.postings().count() == 60_001
    assert loaded.postings().where("times <> IF(token = 'all', IF(id = 7, 3, 2), 1)").isEmpty()


def test_counts_of_rows(spark):
    """Tokens that are counted row by row, and merged where an id repeats, null too."""
    docs = spark.createDataFrame([(1, "\x01Red\x00 red, {red}:\tΑΣ:Β"), (2, None), (3, " , "), (1, "red"), (None, "x"), (None, "X\x1fx x\x1f")], "o long, t string")
    expected = search.postings(docs, "o", "t").groupBy("token", "id").agg(F.count("*").alias("times"))
    for got in (search.token_counts(docs, "o", "t"), search.by_token(search.counted(docs, "o", "t"))):
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    once = search.token_counts(docs.where("o = 2 OR o = 3"), "o", "t")
    assert once.isEmpty() and "Exchange" not in once._jdf.queryExecution().toString()


def test_bitmaps_sort_no_rows(spark):
    """Bitmaps and Bloom words are built through numbers: the aggregate's own bits, no sort of a task's rows, and ids below 0."""
    from oakmill.operators import pruning

    pairs = spark.range(0, 200_000, 7).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS value").union(spark.createDataFrame([(None, "none")], "doc_id long, value string"))
    at = F.col("doc_id") + 1
    expected = pairs.groupBy("value", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    got = search.bitmaps(pairs)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    words = pruning.bloom_words(pairs, "doc_id", 5000, 7, by=["value"])
    for df in (got, words):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    low = spark.createDataFrame([(-1, "v"), (-32768, "v"), (-70_000, "v"), (3, "v")], "doc_id long, value string")
    assert ids(search.bitmap_search(low, ["v"])) == [-70_000, -32768, -1, 3]


def test_postings_are_stored_in_lists(spark, tmp_path):
    """Far fewer rows are sorted and kept than there are postings, and the index answers as before."""
    docs = spark.range(5000).selectExpr("id AS o", "concat('the The of ', id % 10) AS t").repartition(2)
    index = indexes.TokenIndex.write(docs, str(tmp_path / "index"), "o", "t")
    stored = spark.read.parquet(*[p for _, p in index._batches("postings")])
    assert index.postings().count() == 15_000 and stored.count() <= 200
    assert index.find("the", occurrences=True).count() == 10_000 and index.find("THE").count() == 5000
    assert index.find_all(["of", "3"]).count() == 500 and index.token_count().first().n == 12
    totals = {r.token: (r.documents, r.times) for r in spark.read.parquet(index._batches("totals")[0][1]).groupBy("token").agg(F.sum("documents").alias("documents"), F.sum("times").alias("times")).collect()}
    assert totals["the"] == (5000, 10_000) and totals["3"] == (500, 500)


def test_documents_of_tokens(spark, tmp_path):
    """Ids are told apart only where one is there in several batches."""
    docs = spark.createDataFrame([(1, "red red kite"), (2, "red"), (3, "kite"), (None, "moor")], "o long, t string")
    index = indexes.TokenIndex.write(docs, str(tmp_path / "index"), "o", "t")
    index.remove(docs.where("o = 2").select("o"))
    index.insert(docs.where("o = 2"), "o", "t")
    distinct = lambda: "distinct" in index.documents()._jdf.queryExecution().toString().lower().replace("leftanti", "")
    counts = lambda: {r.token: r.n for r in index.documents().collect()}
    assert counts() == {"red": 2, "kite": 2, "moor": 0} and "count(distinct" not in index.documents()._jdf.queryExecution().logical().toString().lower()
    index.insert(docs.where("o = 1"), "o", "t")  # there twice
    assert counts() == {"red": 2, "kite": 2, "moor": 0} and distinct()
