"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    result = duck.sql(SQL[name])
    names = list(result.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(plain(tuple(r[i] for i in order))) for r in result.fetchall())
    assert mine == theirs
