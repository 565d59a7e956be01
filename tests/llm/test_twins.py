"""Queries of the subpackage that have SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sievework.llm import registry
from tests.test_queries import DATA, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want, got = c.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, DATA)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
