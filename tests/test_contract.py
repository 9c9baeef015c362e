"""Every registered query against its SQL counterpart on the smallest driver tables."""

import math
from datetime import datetime

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
TABLES = (
    "region nation part orders lineitem events documents conversations embeddings pages labels"
).split()


@pytest.fixture(scope="module")
def con(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


def comparable(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(comparable(row[i]) for i in order) for row in rows)


def test_every_own_query_has_a_counterpart():
    assert set(contract.ORACLE) == set(contract.QUERIES)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, data, con, name):
    df = contract.queries()[name](spark, data)
    cursor = con.execute(contract.oracle_sql()[name])
    expected_names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(expected_names)
    expected = rows_of(expected_names, cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark, data):
    assert contract.entry(spark).count() == 200
