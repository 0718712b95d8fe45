"""Queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomstrand.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda found, names: sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in found)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)
