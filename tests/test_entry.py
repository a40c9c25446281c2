"""Every registered engine query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from kotonami.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
TABLES += "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(row[k]) for k in order]) for row in rows)


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["request_id", "word", "url"]
    assert got.count() > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_every_engine_query_has_sql():
    assert set(plans.SQL) == set(plans.QUERIES)
    assert set(plans.QUERIES) <= set(entry_module.queries())
