"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_entry(spark):
    df = entry.entry(spark)
    assert "tree_genus_10_share" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert mine[1]
        return
    cursor = con.execute(sql)
    assert mine == table([d[0] for d in cursor.description], cursor.fetchall())
