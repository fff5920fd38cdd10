"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def in_order(rows, columns):
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, data, engine, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = engine.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert in_order(rows, df.columns) == in_order(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
