"""Every query with SQL gives what DuckDB gives, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from textrill import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


# 25 rounds of writes take minutes; test_engine has a shorter run of the same shape
@pytest.mark.parametrize("name", sorted(set(core.oracle_sql()) - {"engine_interleaved"}))
def test_same_as_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    want = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    a = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score"]
