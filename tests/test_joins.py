"""All strategies give the same rows."""

from collections import Counter

import pytest

from oakmill.errors import UnknownColumn
from oakmill.operators import joins
from oakmill.operators.joins import HINTS, bucket, hash_join, join
from oakmill.sources.files import estimated_bytes

L = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (7, "f")]
R = [(1, "x"), (1, "y"), (3, "z"), (None, "n"), (7, "w")]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(L, "k int, v string"), spark.createDataFrame(R, "k2 int, v string")


def expected(null_safe):
    return Counter((a, b, v) for a, v in L for b, _ in R if a == b and (null_safe or a is not None))


@pytest.mark.parametrize("strategy", sorted(HINTS))
@pytest.mark.parametrize("null_safe", [True, False])
def test_strategies_agree(sides, strategy, null_safe):
    left, right = sides
    got = join(left, "k", right, "k2", ["k", "k2", "v"], strategy, null_safe=null_safe).collect()
    assert Counter(tuple(r) for r in got) == expected(null_safe)  # v is the left's


@pytest.mark.parametrize("buckets", [1, 3, 4])
def test_buckets(sides, buckets):
    left, right = sides
    assert join(left, "k", right, "k2", ["k"], "hash", buckets).count() == sum(expected(True).values())


def test_probe_side_wins(sides):
    left, right = sides
    got = {r.v for r in hash_join(left, "k", right, "k2", ["v"]).collect()}
    assert got == {"x", "y", "n", "w"}


def test_all_columns_once(sides):
    left, right = sides
    assert join(left, "k", right, "k2").columns == ["k", "v", "k2"]


def test_self_join(sides):
    left, _ = sides
    assert join(left, "k", left, "k", ["k"], null_safe=False).count() == 6


def test_unknown_names(sides):
    left, right = sides
    with pytest.raises(UnknownColumn):
        join(left, "k", right, "k2", ["nothing"])
    with pytest.raises(UnknownColumn):
        join(left, "nothing", right, "k2")
    with pytest.raises(ValueError):
        join(left, "k", right, "k2", strategy="magic")


def test_empty_inner(sides):
    left, right = sides
    assert join(left, "k", right.limit(0), "k2").count() == 0


@pytest.mark.parametrize(
    ("strategy", "node"),
    [("broadcast", "BroadcastHashJoin"), ("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("nested_loop", "CartesianProduct")],
)
def test_hints_reach_the_plan(spark, strategy, node):
    left, right = spark.range(9).toDF("k"), spark.range(3).toDF("k2")  # of known size
    assert node in join(left, "k", right, "k2", strategy=strategy)._jdf.queryExecution().executedPlan().toString()


def test_bucket_is_never_negative(spark):
    assert {r[0] for r in spark.range(1000).select(bucket("id", 4)).distinct().collect()} == {0, 1, 2, 3}


def test_a_side_of_many_small_rows_is_not_broadcast(spark):
    """Rows count as they lie in a hash table, not as files have them."""
    many, few = spark.range(3_000_000).toDF("k"), spark.range(1000).selectExpr("id AS ck", "id * 2 AS v")
    asked = lambda df: "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    assert estimated_bytes(many) <= joins.BROADCAST_BYTES
    for one in (joins.join(many, "k", few, "ck", ["k", "v"], "index"), joins.join(few, "ck", many, "k", ["k", "v"], "broadcast")):
        assert not asked(one) and one.count() == 1000
    for one in (joins.join(few, "ck", many, "k", ["k", "v"], "index"), joins.join(many, "k", few, "ck", ["k", "v"], "broadcast")):
        assert asked(one) and one.count() == 1000
