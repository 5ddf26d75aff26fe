"""The engine's queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import Catalog
from .engine import Engine
from .functions import text as tx
from .operators import indexes, joins, pruning, query, search, versions
from .sources import docfile, files, tables
from .sources.zones import ZonedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def shows(sql: str | None, *names: str) -> Callable[[Query], Query]:
    """Register a query under its own name, or ``names``, with its SQL."""

    def note(f: Query) -> Query:
        for name in names or (f.__name__,):
            QUERIES[name] = f
            if sql:
                SQL[name] = sql
        return f

    return note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_built: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> str:
    """The path of an index or a layout that ``build`` writes once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = files.new_folder(spark, f"suite-{name}")
        build(path)
        _built[key] = path
    return _built[key]


@atexit.register
def _forget() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        for (app, _, _), path in _built.items():
            with contextlib.suppress(Exception):  # the session may be another one, or gone
                if app == spark.sparkContext.applicationId:
                    files.delete(spark, path)


# Scans, filters, aggregates.

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
KEYS = ORDERS.split(", ")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@shows("SELECT r.c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer r ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def segment_revenue(s: SparkSession, d: str) -> DataFrame:
    done = query.select(orders(s, d), "o_orderstatus", "F", ["o_custkey", "o_totalprice"])
    both = joins.join(done, "o_custkey", table(s, d, "customer"), "c_custkey", ["c_mktsegment", "o_totalprice"], "broadcast")
    return query.group_by(both, "c_mktsegment", n_orders=F.count("*"), revenue=F.round(F.sum("o_totalprice"), 2))


@shows(f"SELECT {ORDERS} FROM orders")
def scan_full(s: SparkSession, d: str) -> DataFrame:
    return query.select(orders(s, d), columns=KEYS)


@shows("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(s: SparkSession, d: str) -> DataFrame:
    return query.select(orders(s, d), columns=["o_orderkey", "o_totalprice"])


@shows("SELECT o_totalprice FROM orders")
def column_scan(s: SparkSession, d: str) -> DataFrame:
    return query.column_scan(orders(s, d), "o_totalprice")


@shows("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5")
def scan_eq_filter(s: SparkSession, d: str) -> DataFrame:
    return query.select(orders(s, d), "o_custkey", 5, ["o_orderkey", "o_totalprice"])


@shows("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def scan_eq_filter_string(s: SparkSession, d: str) -> DataFrame:
    return query.select(orders(s, d), "o_orderstatus", "F", ["o_orderkey"])


@shows("SELECT o_orderkey FROM orders")
def scan_null_value(s: SparkSession, d: str) -> DataFrame:
    return query.select(orders(s, d), "o_orderstatus", None, ["o_orderkey"])


@shows("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 100 AND rn < 200")
def scan_row_range(s: SparkSession, d: str) -> DataFrame:
    return query.row_range(orders(s, d), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@shows("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return query.point(orders(s, d), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_totalprice")


@shows("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def range_scan(s: SparkSession, d: str) -> DataFrame:
    return query.range_scan(orders(s, d), "o_orderkey", 100, 199).select("o_orderkey", "o_totalprice")


@shows("SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
def count_where_gt(s: SparkSession, d: str) -> DataFrame:
    return query.count_where(orders(s, d), F.col("o_totalprice") > 200000)


@shows("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def agg_sum(s: SparkSession, d: str) -> DataFrame:
    return query.aggregate(orders(s, d), total=F.round(F.sum("o_totalprice"), 2))


@shows("SELECT round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_avg(s: SparkSession, d: str) -> DataFrame:
    return query.aggregate(orders(s, d), mean=F.round(F.avg("o_totalprice"), 4))


@shows("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def agg_min_max(s: SparkSession, d: str) -> DataFrame:
    return query.aggregate(orders(s, d), low=F.min("o_totalprice"), high=F.max("o_totalprice"))


@shows("SELECT coalesce(max(o_orderkey), -1) + 1 AS next_id FROM orders")
def sequence_next(s: SparkSession, d: str) -> DataFrame:
    return query.aggregate(orders(s, d), next_id=F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1)


@shows("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def groupby_sum(s: SparkSession, d: str) -> DataFrame:
    return query.group_by(orders(s, d), "o_orderpriority", n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2))


@shows("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1")
def groupby_null_key(s: SparkSession, d: str) -> DataFrame:
    return query.group_by(orders(s, d).withColumn("status", F.nullif("o_orderstatus", F.lit("F"))), "status", n=F.count("*"))


@shows("SELECT o_orderstatus, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY 1")
def groupby_median(s: SparkSession, d: str) -> DataFrame:
    return query.group_by(orders(s, d), "o_orderstatus", middle=F.round(F.median("o_totalprice"), 4))


@shows("SELECT o_custkey, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY 1")
def groupby_udaf_median(s: SparkSession, d: str) -> DataFrame:
    return query.group_apply(orders(s, d), "o_custkey", "o_totalprice", lambda v: round(float(v.median()), 4), "middle", "double")


@shows("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey // 100) AS n_partitions FROM orders")
def table_stats(s: SparkSession, d: str) -> DataFrame:
    parts = pruning.with_partitions(orders(s, d), "o_orderkey")
    return query.aggregate(parts, n_rows=F.count("*"), n_partitions=F.countDistinct("partition_id"))


# Joins.

_JOIN = "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey"


def _orders_customers(strategy: str, buckets: int | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return joins.join(
            orders(s, d), "o_custkey", table(s, d, "customer"), "c_custkey", ["o_orderkey", "o_totalprice", "c_name"], strategy, buckets
        )

    return run


for _strategy, _name in (("broadcast", "join_broadcast"), ("hash", "join_shuffle_hash"), ("merge", "join_sort_merge"), ("auto", "join_auto")):
    shows(_JOIN, _name)(_orders_customers(_strategy))


@shows(_JOIN)
def join_oltp_hash(s: SparkSession, d: str) -> DataFrame:
    return joins.hash_join(table(s, d, "customer"), "c_custkey", orders(s, d), "o_custkey", ["o_orderkey", "o_totalprice", "c_name"])


@shows("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey")
def join_nested_loop(s: SparkSession, d: str) -> DataFrame:
    return joins.join(table(s, d, "nation"), "n_regionkey", table(s, d, "region"), "r_regionkey", ["n_name", "r_name"], "nested_loop")


@shows("SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey IS NOT DISTINCT FROM c_nationkey")
def join_index_nl(s: SparkSession, d: str) -> DataFrame:
    return joins.join(table(s, d, "nation"), "n_nationkey", table(s, d, "customer"), "c_nationkey", ["n_name", "c_custkey"], "index")


#: Null on both sides, in few rows of each: the customers 1 to 3 and their orders.
_NULL_JOIN = (
    "SELECT o_orderkey, c_name FROM (SELECT o_orderkey, CASE WHEN o_custkey > 3 THEN o_custkey END AS k FROM orders) o "
    "JOIN (SELECT c_name, CASE WHEN c_custkey > 3 THEN c_custkey END AS ck FROM customer) c ON k {} ck"
)


def _null_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = lambda c: F.when(F.col(c) > 3, F.col(c))
    o = orders(s, d).select("o_orderkey", known("o_custkey").alias("k"))
    return o, table(s, d, "customer").select("c_name", known("c_custkey").alias("ck"))


def _null_keys(strategy: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        o, c = _null_sides(s, d)
        return joins.join(o, "k", c, "ck", ["o_orderkey", "c_name"], strategy)

    return run


for _strategy in ("broadcast", "hash", "merge", "index"):
    shows(_NULL_JOIN.format("IS NOT DISTINCT FROM"), f"join_null_keys_{_strategy}")(_null_keys(_strategy))


@shows("SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(r_regionkey, 0)")
def join_null_keys_nested_loop(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").withColumn("k", F.nullif("n_regionkey", F.lit(0)))
    r = table(s, d, "region").withColumn("rk", F.nullif("r_regionkey", F.lit(0)))
    return joins.join(n, "k", r, "rk", ["n_name", "r_name"], "nested_loop")


@shows(_NULL_JOIN.format("="))
def join_null_keys_plain(s: SparkSession, d: str) -> DataFrame:
    o, c = _null_sides(s, d)
    return joins.join(o, "k", c, "ck", ["o_orderkey", "c_name"], null_safe=False)


@shows("SELECT s_suppkey, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_column_collision(s: SparkSession, d: str) -> DataFrame:
    left = table(s, d, "supplier").withColumnRenamed("s_name", "name")
    right = table(s, d, "nation").withColumnRenamed("n_name", "name")
    return joins.join(left, "s_nationkey", right, "n_nationkey", ["s_suppkey", "name"])


@shows("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE false")
def join_empty_inner(s: SparkSession, d: str) -> DataFrame:
    return joins.join(table(s, d, "nation"), "n_regionkey", table(s, d, "region").where("false"), "r_regionkey", ["n_name", "r_name"])


@shows("SELECT l_returnflag, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def join_then_group(s: SparkSession, d: str) -> DataFrame:
    both = joins.join(
        table(s, d, "lineitem"), "l_orderkey", orders(s, d), "o_orderkey",
        ["l_returnflag", "o_orderpriority", "l_extendedprice", "l_discount"], null_safe=False,
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return both.groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), revenue.alias("revenue"))


# The SQL dialect.


def engine(s: SparkSession, d: str) -> Engine:
    e = Engine(s)
    for name in ("orders", "customer", "nation", "region"):
        e.register(name, table(s, d, name))
    return e


def _text(sql: str) -> Query:
    return lambda s, d: engine(s, d).sql(sql)


for _name, _text_of, _sql in (
    ("sql_select_all", "SELECT * FROM nation", "SELECT * FROM nation"),
    ("sql_select_columns", "select o_orderkey, o_custkey from orders;", "SELECT o_orderkey, o_custkey FROM orders"),
    ("sql_where_int", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7"),
    ("sql_where_string", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    ("sql_limit", "SELECT * FROM nation LIMIT 100", "SELECT * FROM nation LIMIT 100"),
    ("sql_join_auto", "SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("sql_join_hash", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey HASH", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("sql_join_nl", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey NESTED_LOOP", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    ("sql_join_where", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
):
    shows(_sql, _name)(_text(_text_of))


def indexed(s: SparkSession, d: str) -> Engine:
    """Orders and customers with ``id`` as key, and indexes of every kind on them, stored once."""

    def build(_: str) -> None:
        e = Engine(s)
        e.register("buyer", table(s, d, "customer").withColumnRenamed("c_custkey", "id"))
        e.register("sale", orders(s, d).withColumnRenamed("o_orderkey", "id"))
        for name, kind in (("buyer", "hashIndex"), ("sale", "BPlusTree"), ("sale", "bitmap"), ("buyer", "GIN")):
            e.catalog.create_index("public", name, kind)
        _engines[s.sparkContext.applicationId, d] = e

    stored(s, d, "engine", build)
    return _engines[s.sparkContext.applicationId, d]


_engines: dict[tuple[str, str], Engine] = {}


def _indexed(sql: str) -> Query:
    return lambda s, d: indexed(s, d).sql(sql)


for _name, _text_of, _sql in (
    ("sql_index_hash", "SELECT id, c_name FROM buyer WHERE id = 77", "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey = 77"),
    ("sql_index_bplustree", "SELECT id, o_custkey, o_totalprice FROM sale WHERE id = 4242", "SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242"),
    ("sql_index_bitmap", "SELECT id, o_custkey FROM sale WHERE o_orderpriority = '1-URGENT'", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    ("sql_index_token", "SELECT id, c_nationkey FROM buyer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey AS id, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    ("sql_index_join", "SELECT o_orderkey, c_name FROM orders JOIN buyer ON o_custkey = id WHERE o_orderstatus = 'P'", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"),
    ("sql_index_join_plain", "SELECT o_orderkey, c_name FROM orders JOIN buyer ON o_custkey = id", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
):

    def _joined(s: SparkSession, d: str, text: str = _text_of) -> DataFrame:
        e = indexed(s, d)
        e.register("orders", orders(s, d))
        return e.sql(text)

    shows(_sql, _name)(_joined)


@shows(
    "SELECT * FROM (VALUES ('hash index scan on id', NULL), ('B+tree index scan on id', NULL), ('bitmap index scan on o_orderpriority', NULL), "
    "('token index scan on c_mktsegment', NULL), ('full scan', 'index join by hash index'), ('full scan', 'hash join'), ('B+tree index scan on id', 'nested loop join')) t(scan, join_by)"
)
def sql_explain(s: SparkSession, d: str) -> DataFrame:
    e = indexed(s, d)
    e.register("orders", orders(s, d))
    texts = [
        "buyer WHERE id = 77", "sale WHERE id = 4242", "sale WHERE o_orderpriority = '1-URGENT'", "buyer WHERE c_mktsegment = 'BUILDING'",
        "orders JOIN buyer ON o_custkey = id", "orders JOIN sale ON o_custkey = o_custkey", "sale JOIN orders ON o_custkey = o_custkey WHERE id = 3",
    ]
    plans = [e.explain(f"SELECT * FROM {t}") for t in texts]
    return s.createDataFrame([(p.scan, p.join) for p in plans], "scan string, join_by string")


@shows("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 42")
def hash_index_get(s: SparkSession, d: str) -> DataFrame:
    path = stored(s, d, "by-customer", lambda p: indexes.HashIndex.write(orders(s, d), p, "o_custkey"))
    return indexes.HashIndex(s, path).lookup(42).select("o_orderkey", "o_custkey", "o_totalprice")


# Documents: events as (doc_id, json).


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def event_documents(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))


@shows("SELECT event_id AS doc_id, props AS json FROM events")
def doc_scan(s: SparkSession, d: str) -> DataFrame:
    path = stored(s, d, "documents", lambda p: docfile.write_documents(event_documents(s, d), p))
    return docfile.read_documents(s, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@shows("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'third' WHEN event_id % 2 = 0 THEN 'second' ELSE props END AS json FROM events")
def doc_append_twice(s: SparkSession, d: str) -> DataFrame:
    """A document file that is appended to twice: the last line of an id holds."""

    def build(path: str) -> None:
        docs = event_documents(s, d)
        docfile.write_documents(docs, path)
        for step, text in ((2, "second"), (3, "third")):
            docfile.write_documents(docs.where(F.col("doc_id") % step == 0).withColumn("json", F.lit(text)), path)

    path = stored(s, d, "appended", build)
    return docfile.read_documents(s, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@shows("SELECT event_id AS doc_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def doc_filter(s: SparkSession, d: str) -> DataFrame:
    return event_documents(s, d).where(tx.json_field(F.col("json"), "k") == "7").select("doc_id")


@shows("SELECT event_id AS doc_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    return event_documents(s, d).select("doc_id", tx.json_field(F.col("json"), "k").alias("k"))


@shows("SELECT event_id AS doc_id, props AS json FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + 1, '{\"k\": -1}'")
def doc_append(s: SparkSession, d: str) -> DataFrame:
    def build(path: str) -> None:
        docs = event_documents(s, d)
        docfile.write_documents(docs, path)
        new = docfile.append(docs.where(F.lit(False)), s.createDataFrame([('{"k": -1}',)], "json string"), first=docfile.next_id(docs))
        docfile.write_documents(new, path)

    path = stored(s, d, "one-more", build)
    return docfile.read_documents(s, path).withColumn("doc_id", F.col("doc_id").cast("long"))


@shows("SELECT event_id AS doc_id, props AS json FROM events WHERE event_id <> 3")
def doc_delete(s: SparkSession, d: str) -> DataFrame:
    return docfile.without(event_documents(s, d), F.col("doc_id") == 3)


@shows("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS value FROM orders")
def snapshot_roundtrip(s: SparkSession, d: str) -> DataFrame:
    pairs = orders(s, d).select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))
    return docfile.read_snapshot(s, stored(s, d, "snapshot", lambda p: docfile.write_snapshot(pairs, p)))


# Search.

_TOKENS = """
tokens AS (
  SELECT doc_id, lower(t) AS token FROM (
    SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '[{}":\\[\\]]', ' ', 'g'), '\\s+|,')) AS t FROM documents
  ) WHERE trim(t) <> ''
)"""


def token_index(s: SparkSession, d: str) -> indexes.TokenIndex:
    docs = table(s, d, "documents")
    return indexes.TokenIndex(s, stored(s, d, "tokens", lambda p: indexes.TokenIndex.write(docs, p, "doc_id", "text")))


@shows(f"WITH {_TOKENS} SELECT doc_id AS id, token, count(*) AS n FROM tokens GROUP BY 1, 2")
def token_list(s: SparkSession, d: str) -> DataFrame:
    return search.token_counts(table(s, d, "documents"), "doc_id", "text").select("id", "token", F.col("times").alias("n"))


@shows(f"WITH {_TOKENS} SELECT doc_id AS id, token, count(*) AS n FROM tokens GROUP BY 1, 2")
def token_save_load(s: SparkSession, d: str) -> DataFrame:
    """Postings written as lines and read back into an index."""
    index = token_index(s, d)
    saved = stored(s, d, "saved-tokens", index.save)
    path = stored(s, d, "loaded-tokens", lambda p: indexes.TokenIndex.load(s, saved, p))
    return indexes.TokenIndex(s, path).postings().withColumnRenamed("times", "n")


_THE = f"WITH {_TOKENS} SELECT DISTINCT doc_id AS id FROM tokens WHERE token = 'the'"


@shows(_THE)
def token_search(s: SparkSession, d: str) -> DataFrame:
    return token_index(s, d).find("The")


@shows(_THE)
def token_search_scan(s: SparkSession, d: str) -> DataFrame:
    """The same without an index."""
    return search.token_search(table(s, d, "documents"), "doc_id", "text", "The")


@shows(f"WITH {_TOKENS} SELECT doc_id AS id FROM tokens WHERE token = 'the'")
def token_occurrences(s: SparkSession, d: str) -> DataFrame:
    return token_index(s, d).find("the", occurrences=True)


@shows(f"WITH {_TOKENS} SELECT doc_id AS id FROM tokens WHERE token IN ('the', 'of') GROUP BY 1 HAVING count(DISTINCT token) = 2")
def token_search_all(s: SparkSession, d: str) -> DataFrame:
    return token_index(s, d).find_all(["the", "OF"])


@shows(f"WITH {_TOKENS} SELECT DISTINCT doc_id AS id FROM tokens WHERE token IN ('the', 'und')")
def token_search_any(s: SparkSession, d: str) -> DataFrame:
    return token_index(s, d).find_any(["the", "und"])


@shows(f"WITH {_TOKENS} SELECT count(DISTINCT token) AS n FROM tokens")
def token_count(s: SparkSession, d: str) -> DataFrame:
    return token_index(s, d).token_count()


@shows(f"WITH {_TOKENS} SELECT token, count(DISTINCT doc_id) AS n FROM tokens WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0 GROUP BY 1")
def token_delete(s: SparkSession, d: str) -> DataFrame:
    """An index from which a third of the documents has been removed, and some of these inserted again."""
    docs = table(s, d, "documents")

    def build(path: str) -> None:
        index = indexes.TokenIndex.write(docs, path, "doc_id", "text")
        index.remove(docs.where("doc_id % 3 = 1").select("doc_id"))
        index.insert(docs.where("doc_id % 3 = 1 AND doc_id % 2 = 0"), "doc_id", "text")

    return indexes.TokenIndex(s, stored(s, d, "shrunken", build)).documents()


_PARTS = """
words AS (
  SELECT p_partkey // 100 AS partition_id, p_partkey AS row_index, 'p_name:' || t AS token FROM (
    SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[\\s,;!?.]+')) AS t FROM part) WHERE t <> ''
)"""


def part_postings(s: SparkSession, d: str) -> DataFrame:
    def build(path: str) -> None:
        parts = pruning.with_partitions(table(s, d, "part"), "p_partkey")
        tables.write(search.column_postings(parts, "p_name", "partition_id", "p_partkey"), path, cluster_by="token")

    return s.read.parquet(stored(s, d, "parts", build))


@shows("SELECT * FROM (VALUES ('p_brand', false), ('p_name', true)) t(column_name, indexed)")
def inverted_is_indexed(s: SparkSession, d: str) -> DataFrame:
    posted = part_postings(s, d)
    return s.createDataFrame([(c, search.is_indexed(posted, c)) for c in ("p_brand", "P_Name")], "column_name string, indexed boolean").withColumn("column_name", F.lower("column_name"))


@shows(f"WITH {_PARTS} SELECT token, count(*) AS n FROM words GROUP BY 1")
def inverted_tokens(s: SparkSession, d: str) -> DataFrame:
    return part_postings(s, d).groupBy("token").agg(F.count("*").alias("n"))


@shows(f"WITH {_PARTS} SELECT token, partition_id, row_index FROM words")
def inverted_postings(s: SparkSession, d: str) -> DataFrame:
    return part_postings(s, d)


_ONE = "(SELECT lower(split_part(p_name, ' ', 1)) AS w FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))"


def _first_word(s: SparkSession, d: str) -> str:
    return table(s, d, "part").orderBy("p_partkey").select(F.split("p_name", " ")[0]).first()[0]


@shows(f"WITH {_PARTS} SELECT DISTINCT partition_id FROM words WHERE token = 'p_name:' || {_ONE}")
def inverted_partitions(s: SparkSession, d: str) -> DataFrame:
    return search.partitions_containing(part_postings(s, d), "p_name", _first_word(s, d))


@shows(f"WITH {_PARTS} SELECT partition_id, row_index FROM words WHERE token = 'p_name:' || {_ONE}")
def inverted_row_locations(s: SparkSession, d: str) -> DataFrame:
    return search.row_locations(part_postings(s, d), "p_name", _first_word(s, d))


_VALUES = "v AS (SELECT o_orderkey AS doc_id, lower(trim(o_orderstatus)) AS value FROM orders UNION ALL SELECT o_orderkey, lower(trim(o_orderpriority)) FROM orders)"


def order_values(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d)
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("value"))


def bitmap_index(s: SparkSession, d: str) -> indexes.BitmapIndex:
    return indexes.BitmapIndex(s, stored(s, d, "bitmaps", lambda p: indexes.BitmapIndex.write(order_values(s, d), p)))


_FINISHED = "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'"


@shows(_FINISHED)
def bitmap_search(s: SparkSession, d: str) -> DataFrame:
    return bitmap_index(s, d).find([" f "])


@shows(_FINISHED)
def bitmap_save_load(s: SparkSession, d: str) -> DataFrame:
    """Bitmaps written as lines of base64 and read back into an index."""
    saved = stored(s, d, "saved-bitmaps", bitmap_index(s, d).save)
    path = stored(s, d, "loaded-bitmaps", lambda p: indexes.BitmapIndex.load(s, saved, p))
    return indexes.BitmapIndex(s, path).find(["F"])


@shows(f"{_FINISHED} AND o_orderpriority = '1-URGENT'")
def bitmap_and(s: SparkSession, d: str) -> DataFrame:
    return bitmap_index(s, d).find(["F", "1-urgent"], every=True)


@shows("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def bitmap_and_count(s: SparkSession, d: str) -> DataFrame:
    both = search.bitmap_all(bitmap_index(s, d).bitmaps, ["F", "1-urgent"])
    return both.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


@shows(f"{_FINISHED} OR o_orderpriority = '1-URGENT'")
def bitmap_or(s: SparkSession, d: str) -> DataFrame:
    return bitmap_index(s, d).find(["F", "1-urgent"])


@shows(f"{_FINISHED} OR o_orderpriority = '1-URGENT'")
def bitmap_or_scan(s: SparkSession, d: str) -> DataFrame:
    """The same without an index."""
    return search.bitmap_search(order_values(s, d), ["F", "1-urgent"])


@shows(f"WITH {_VALUES} SELECT value, count(DISTINCT doc_id) AS n FROM v GROUP BY 1")
def bitmap_cardinality(s: SparkSession, d: str) -> DataFrame:
    return bitmap_index(s, d).cardinality()


@shows(f"WITH {_VALUES} SELECT value, count(DISTINCT doc_id) AS n FROM v WHERE doc_id <> 5 GROUP BY 1")
def bitmap_delete(s: SparkSession, d: str) -> DataFrame:
    return search.bitmap_cardinality(docfile.without(order_values(s, d), F.col("doc_id") == 5))


# Pruning and layout.


def zoned(s: SparkSession, d: str) -> DataFrame:
    return pruning.with_partitions(orders(s, d), "o_orderkey")


@shows("SELECT o_orderkey // 100 AS partition_id, count(*) AS n_rows, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1")
def zone_map(s: SparkSession, d: str) -> DataFrame:
    return pruning.zone_map(zoned(s, d), ["o_totalprice"])


def zone_table(s: SparkSession, d: str) -> ZonedTable:
    """Orders in micro-partitions of 100 keys, with ranges and Bloom filters of order and customer."""

    def build(path: str) -> None:
        part = F.floor(F.col("o_orderkey") / tables.PARTITION_ROWS)
        ZonedTable.write(orders(s, d), path, "o_orderkey", zones=["o_custkey"], bloom=["o_orderkey", "o_custkey"], partition=part)

    path = stored(s, d, "zones", build)
    if path not in _zoned:
        _zoned[path] = ZonedTable(s, path)
    return _zoned[path]


_zoned: dict[str, ZonedTable] = {}


@shows("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 777")
def zone_prune(s: SparkSession, d: str) -> DataFrame:
    return zone_table(s, d).select("o_orderkey", 777, ["o_orderkey", "o_custkey"])


@shows("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77")
def zone_prune_unclustered(s: SparkSession, d: str) -> DataFrame:
    return zone_table(s, d).select("o_custkey", 77, ["o_orderkey", "o_custkey"])


@shows(
    """
WITH z AS (SELECT o_orderkey // 100 AS p, min(o_custkey) AS low, max(o_custkey) AS high, count(*) FILTER (o_custkey = 77) AS n FROM orders GROUP BY 1)
SELECT count(*) AS partitions, count(*) FILTER (77 BETWEEN low AND high) AS after_ranges, count(*) FILTER (n > 0) AS holding, 0 AS missed,
       true AS few_false FROM z"""
)
def prune_report(s: SparkSession, d: str) -> DataFrame:
    """What ranges and Bloom filters leave of the partitions for a customer, against where the customer is."""
    zones = zone_table(s, d)
    holding = zoned(s, d).where("o_custkey = 77").select("partition_id").distinct()
    left = zones.candidates("o_custkey", 77).select(F.col("__partition").alias("p"))
    met = holding.join(left, F.col("partition_id") == F.col("p"), "left")
    facts = met.agg(F.count("*").alias("holding"), F.count_if(F.col("p").isNull()).alias("missed"))
    return zones.report("o_custkey", 77).join(F.broadcast(facts)).select(  # one row each
        "partitions", "after_ranges", "holding", "missed",
        (F.col("after_bloom") <= F.col("holding") + 0.03 * F.col("after_ranges") + 1).alias("few_false"),
    )


@shows("SELECT count(*) AS n_rows, 0 AS overlaps FROM orders")
def cluster_by(s: SparkSession, d: str) -> DataFrame:
    """Files written by customer: their rows, and neighbours in the order of their ranges that overlap by more than an end."""
    path = stored(s, d, "clustered", lambda p: tables.write(orders(s, d), p, cluster_by="o_custkey", partitions=8, bloom=["o_custkey"]))
    ranges = s.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"), F.count("*").alias("n")
    )
    before = W.orderBy("low", "high")  # a row a file
    return ranges.withColumn("last", F.lag("high").over(before)).agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("last") >= F.col("low")).alias("overlaps")
    )


@shows("SELECT count(*) AS n_rows, ceil(count(*) / 100)::BIGINT AS least_files, true AS rolled FROM orders")
def table_rollover(s: SparkSession, d: str) -> DataFrame:
    """A table whose files are rolled over at 100 rows (here of 1,000 keys' layouts, in tasks of their own)."""
    path = stored(s, d, "rolled", lambda p: tables.write(orders(s, d).select("o_orderkey"), p, cluster_by="o_orderkey", rows_per_file=tables.PARTITION_ROWS))
    sizes = s.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_rows"), F.ceil(F.sum("n") / tables.PARTITION_ROWS).alias("least_files"),
        ((F.max("n") <= tables.PARTITION_ROWS) & (F.count("*") >= F.sum("n") / tables.PARTITION_ROWS)).alias("rolled"),
    )


@shows("SELECT count(*) AS members, 0 AS missed, true AS few_false FROM orders")
def bloom_no_false_negative(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d).select("o_orderkey")
    n = o.count()
    params = pruning.bloom_params(n, 0.01)
    words = s.read.parquet(stored(s, d, "bloom", lambda p: pruning.bloom_words(o, "o_orderkey", *params).write.parquet(p)))
    rows = o.select("o_orderkey", F.lit(True).alias("inside")).union(o.select(F.col("o_orderkey") + n, F.lit(False)))
    found = pruning.bloom_member(rows, "o_orderkey", words, *params)
    inside, held = F.col("inside"), F.col("held")
    return found.agg(
        F.count_if(inside).alias("members"), F.count_if(inside & ~held).alias("missed"),
        (F.count_if(~inside & held) <= F.count_if(~inside) * 0.03).alias("few_false"),
    )


@shows("SELECT 959 AS bits, 7 AS hashes")
def bloom_params(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([pruning.bloom_params(100, 0.01)], "bits int, hashes int")


# Catalog.


def _catalog(s: SparkSession, d: str) -> Catalog:
    c = Catalog(s)
    for name in ("Orders", "CUSTOMER"):
        c.register("Public", name, table(s, d, name.lower()))
    return c


@shows("SELECT * FROM (VALUES ('public', 'orders', 0), ('public', 'customer', 1)) t(schema_name, table_name, position)")
def catalog_tables(s: SparkSession, d: str) -> DataFrame:
    return _catalog(s, d).tables()


@shows("SELECT * FROM (VALUES ('c_custkey', 'bigint', 0), ('c_name', 'string', 1), ('c_nationkey', 'int', 2), ('c_acctbal', 'double', 3), ('c_mktsegment', 'string', 4)) t(column_name, type, position)")
def catalog_columns(s: SparkSession, d: str) -> DataFrame:
    return _catalog(s, d).columns("public", "Customer")


# Versioned data: histories derived from events.


@shows("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def index_upsert(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("user_id", "event_id", "value")
    return versions.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@shows("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def index_delete(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d)
    return versions.remove(o.select("o_orderkey", "o_custkey"), "o_orderkey", query.select(o, "o_orderstatus", "F", ["o_orderkey"]))


def lsm_log(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).selectExpr(
        "user_id AS key", "event_id AS seq", "event_id * 10 AS value", "event_type = 'error' AS deleted", "event_id DIV 1000 AS run"
    )


_LSM = "log AS (SELECT user_id AS key, event_id AS seq, event_id * 10 AS value, event_type = 'error' AS deleted FROM events)"


@shows(f"WITH {_LSM} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(deleted, seq)")
def lsm_read(s: SparkSession, d: str) -> DataFrame:
    return versions.lsm_read(lsm_log(s, d).drop("run"))


@shows(f"WITH {_LSM} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(deleted, seq)")
def lsm_compact(s: SparkSession, d: str) -> DataFrame:
    return versions.lsm_read(versions.lsm_compact(lsm_log(s, d))).drop("run")


def lsm_tree(s: SparkSession, d: str) -> versions.LsmTree:
    """The log as runs of 1,000 numbers each (a bulk flush a run), and a memory table on top."""

    def build(path: str) -> None:
        tree = versions.LsmTree(s, path)
        log = lsm_log(s, d)
        for r in log.select("run").distinct().orderBy("run").limit(LSM_RUNS).collect():
            tree.ingest(log.where(F.col("run") == r.run))
        tree.ingest(log.where(F.col("run") >= LSM_RUNS))

    return versions.LsmTree(s, stored(s, d, "lsm", build))


#: Runs of 1,000 numbers that are flushed one by one; the rest is one run.
LSM_RUNS = 4


@shows(f"WITH {_LSM} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(deleted, seq)")
def lsm_run_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The live keys of a tree that is read from its run files."""
    return lsm_tree(s, d).read()


@shows(
    f"WITH {_LSM}, live AS (SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(deleted, seq)) "
    "SELECT key, CASE WHEN key IN (1, 2, 3) THEN -key ELSE value END AS value FROM (SELECT key, value FROM live WHERE key NOT IN (1, 2, 3, 4, 5) UNION ALL SELECT unnest([1, 2, 3]), 0)"
)
def lsm_flush(s: SparkSession, d: str) -> DataFrame:
    """Five puts and tombstones more, which the memory table flushes by itself, and a merge of the two oldest runs."""

    def build(path: str) -> None:
        tree = versions.LsmTree(s, path)
        tree.ingest(lsm_log(s, d))
        for key in (1, 2, 3):
            tree.put(key, -key)
        tree.remove(4)
        tree.remove(5)
        tree.merge()

    return versions.LsmTree(s, stored(s, d, "flushed", build)).read().select("key", "value")


@shows(f"WITH {_LSM}, r AS (SELECT DISTINCT key, least(seq // 1000, 4) AS run FROM log) SELECT run, count(*) AS keys, 0 AS missed FROM r GROUP BY 1")
def lsm_bloom_counts(s: SparkSession, d: str) -> DataFrame:
    """Each run's keys, and those that its Bloom filter would lose."""
    tree = lsm_tree(s, d)
    out = None
    for k, name in enumerate(tree.runs()):
        bits, hashes = map(int, name.split("-")[3:])
        words = s.read.parquet(f"{tree.folder}/bloom-{name}")
        held = pruning.bloom_member(tree.read_run(name).select("key"), "key", words, bits, hashes)
        own = held.agg(F.lit(k).cast("long").alias("run"), F.count("*").alias("keys"), F.count_if(~F.col("held")).alias("missed"))
        out = own if out is None else out.union(own)
    return out.where("keys > 0")


def history(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).selectExpr(
        "user_id AS doc_id", "event_id AS version_seq", "event_id DIV 10 AS writer_tx",
        "CASE (event_id DIV 10) % 5 WHEN 0 THEN 'ROLLED_BACK' WHEN 1 THEN 'ACTIVE' ELSE 'COMMITTED' END AS status",
        "event_type = 'error' AS deleted",
    )


def _mvcc(sees: str, more: str = "true") -> str:
    return f"""
WITH h AS (
  SELECT user_id AS doc_id, event_id AS version_seq, event_id // 10 AS writer_tx,
    CASE (event_id // 10) % 5 WHEN 0 THEN 'ROLLED_BACK' WHEN 1 THEN 'ACTIVE' ELSE 'COMMITTED' END AS status,
    event_type = 'error' AS deleted FROM events
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version_seq DESC) AS rn FROM h WHERE {sees}
)
SELECT doc_id, version_seq, writer_tx FROM seen WHERE rn = 1 AND NOT deleted AND {more}"""


_READ = ["doc_id", "version_seq", "writer_tx"]
_COMMITTED = "status = 'COMMITTED'"
#: Half of the largest committed writer.
_SNAPSHOT = f"{_COMMITTED} AND writer_tx <= (SELECT max(writer_tx) // 2 FROM h WHERE {_COMMITTED})"


def _snapshot(h: DataFrame) -> int:
    return h.where(_COMMITTED).agg(F.max("writer_tx")).first()[0] // 2


@shows(_mvcc("status <> 'ROLLED_BACK'"))
def mvcc_read_uncommitted(s: SparkSession, d: str) -> DataFrame:
    return versions.mvcc_read(history(s, d), "READ_UNCOMMITTED").select(*_READ)


@shows(_mvcc(_COMMITTED))
def mvcc_read_committed(s: SparkSession, d: str) -> DataFrame:
    return versions.mvcc_read(history(s, d), "READ_COMMITTED").select(*_READ)


@shows(_mvcc(_SNAPSHOT))
def mvcc_repeatable_read(s: SparkSession, d: str) -> DataFrame:
    h = history(s, d)
    return versions.mvcc_read(h, "REPEATABLE_READ", _snapshot(h)).select(*_READ)


@shows(_mvcc(_SNAPSHOT))
def mvcc_serializable(s: SparkSession, d: str) -> DataFrame:
    h = history(s, d)
    return versions.mvcc_read(h, "SERIALIZABLE", _snapshot(h)).select(*_READ)


@shows(_mvcc(_COMMITTED, "doc_id BETWEEN 10 AND 60"))
def mvcc_range_scan(s: SparkSession, d: str) -> DataFrame:
    return versions.mvcc_range(history(s, d), "READ_COMMITTED", 10, 60).select(*_READ)


@shows(f"SELECT count(*) AS n FROM ({_mvcc(_COMMITTED)})")
def mvcc_visible_count(s: SparkSession, d: str) -> DataFrame:
    return versions.mvcc_read(history(s, d), "READ_COMMITTED").agg(F.count("*").alias("n"))


@shows(
    "SELECT doc_id FROM (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS t FROM events WHERE (event_id // 10) % 5 > 1 GROUP BY 1) WHERE t = 'error'"
)
def mvcc_delete_visible(s: SparkSession, d: str) -> DataFrame:
    h = history(s, d)
    seen = h.where(versions.can_see("READ_COMMITTED", 0, F.col("writer_tx"), F.col("status"))).select("doc_id").distinct()
    return versions.remove(seen, "doc_id", versions.mvcc_read(h, "READ_COMMITTED"))


def wal(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).where("event_type <> 'signup'").selectExpr(
        "event_id AS lsn", "(event_id DIV 100) * 20 + event_id % 20 AS tx_id",
        "CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' WHEN 'click' THEN 'insert' ELSE 'delete' END AS kind",
        "user_id AS doc_id",
    )


_WAL = """
WITH w AS (
  SELECT event_id AS lsn, (event_id // 100) * 20 + event_id % 20 AS tx_id,
    CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' WHEN 'click' THEN 'insert' ELSE 'delete' END AS kind,
    user_id AS doc_id FROM events WHERE event_type <> 'signup'
), ops AS (
  SELECT *, min(lsn) OVER (PARTITION BY tx_id) AS first FROM w
  WHERE kind IN ('insert', 'delete') AND tx_id IN (SELECT tx_id FROM w WHERE kind = 'commit')
)
"""


@shows(_WAL + "SELECT lsn, tx_id, kind, doc_id, row_number() OVER (ORDER BY first, lsn) AS replay_rank FROM ops")
def wal_replay(s: SparkSession, d: str) -> DataFrame:
    return versions.wal_replay(wal(s, d))


@shows(_WAL + "SELECT coalesce(max(lsn), 0) AS max_lsn FROM w")
def wal_max_lsn(s: SparkSession, d: str) -> DataFrame:
    return versions.max_lsn(wal(s, d))
