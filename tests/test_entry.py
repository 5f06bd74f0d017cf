"""Registered queries against their SQL in an independent engine, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    result = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert found == sorted(tuple(str(r[i]) for i in at) for r in result.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).take(1)
