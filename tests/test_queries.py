"""Every query over the smallest tables; those with SQL are held against DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from sievework.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(names, data):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in at]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_near_dup_pairs_against_brute_force(spark):
    docs = [r for r in registry.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    import re
    import unicodedata

    def grams(t):
        k = re.sub(r"[^\w]+", "", unicodedata.normalize("NFKC", t).lower())
        return {k[i : i + 4] for i in range(len(k) - 3)} if len(k) >= 20 else set()

    sets, reps = {r.doc_id: frozenset(grams(r.text)) for r in docs}, {}
    for i in sorted(sets):
        if sets[i]:
            reps.setdefault(sets[i], i)
    want = {}
    for x, a in reps.items():
        for y, b in reps.items():
            if a < b and len(x & y) / len(x | y) >= 0.5:
                want[a, b] = round(len(x & y) / len(x | y), 6)
    got = {(r.a, r.b): r.jaccard for r in registry.near_dup_pairs(spark, DATA).collect()}
    assert got == pytest.approx(want) and set(got) == set(want)


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
