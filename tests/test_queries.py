"""Every SQL-expressible query equals its DuckDB statement on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lurewatch.plans import load_all
from oracles import all_oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES, QUERIES = all_oracles(), load_all()
SLOW = {"models_fast", "models_full", "soft_vote_metrics", "scored_urls", "full_analysis_by_bundle"}  # their parts are in test_models.py


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows(cols, cur.fetchall())
