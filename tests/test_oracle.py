"""Every query with SQL gives the SQL's rows on the smallest tables; every other one runs and gives rows."""

import math

import duckdb
import pytest

from sparktrace.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.SQL:
        assert mine
        return
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, found.fetchall())
