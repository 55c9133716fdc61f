"""The SQL of the operators' queries in DuckDB, on the smallest tables."""

import duckdb
import pytest

from scriptorium.llm import catalogue
from tests.test_queries import plain

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(catalogue.ORACLES[name])
    assert got and sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())
