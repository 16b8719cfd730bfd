"""Every registered query with an SQL twin gives the same rows as DuckDB at the smallest scale."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from pricebook.plans.fixtures import BASE
from tests.conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def norm(v):
    return float(v) if isinstance(v, (decimal.Decimal, float)) else v


def key(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    if name not in ORACLE:
        assert got
        return
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0
