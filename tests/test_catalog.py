"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import compare
from newsloom.session import tune

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()
MAY_BE_EMPTY = {"vector_search_filtered", "vector_min_score", "feedback_recent", "missing_days", "feedback_summary"}


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    tune(spark)
    note, ok, _ = compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert ok or (note == "no rows" and name in MAY_BE_EMPTY), note


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
