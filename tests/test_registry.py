"""Each registered market query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import market

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(market.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = market.queries()[name](spark, SF)
    r = duck.sql(market.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    ours = sorted(tuple(str(cell(x[c])) for c in sorted(df.columns)) for x in df.collect())
    cols = [r.columns.index(c) for c in sorted(r.columns)]
    assert ours == sorted(tuple(str(cell(x[i])) for i in cols) for x in r.fetchall())


def test_every_query_has_sql():
    assert set(market.queries()) == set(market.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
