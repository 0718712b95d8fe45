"""Every query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomstrand import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in (row[i] for i in order)]) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_sql_has_a_query():
    assert registry.ORACLE_SQL.keys() <= registry.QUERIES.keys()


def test_entry_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert registry.QUERIES.keys() <= __spark_entry__.queries().keys() and registry.ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()
