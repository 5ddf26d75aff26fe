"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from oakmill import suite

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(suite.SQL[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    a, b = (sorted(range(len(c)), key=c.__getitem__) for c in (df.columns, columns))
    rows = sorted((tuple(plain(r[i]) for i in a) for r in got), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in b) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
