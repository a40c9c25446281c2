"""Registered queries of the training-data operators against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from kotonami.llm import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(repr([plain(row[c]) for c in order]) for row in got.collect())
    theirs = sorted(repr([plain(row[names.index(c)]) for c in order]) for row in want.fetchall())
    assert ours == theirs


def test_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.queries()) == list(range(1, 14))
