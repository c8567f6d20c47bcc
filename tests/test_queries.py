"""Every query with SQL gives the rows of DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from geostrain.plans import catalog, registry

assert catalog
TABLES = "region nation customer supplier part orders lineitem events".split()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.sql(ORACLE[name])
    assert table(df.collect(), df.columns) == table(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_kernels_give_rows(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns and len(df.collect()) > 0
