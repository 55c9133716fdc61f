"""Every registered query against its DuckDB oracle, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from scriptorium.plans.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        path = f"{SF_DIR}/{name}"
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())
