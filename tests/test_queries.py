"""Every registered query against its oracle SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from rookery.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("ROOKERY_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else round(float(x), 6) + 0.0
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b) > 0  # two empty results show nothing
    assert a == b


def test_all_but_the_iterative_queries_have_an_oracle():
    assert set(QUERIES) - set(ORACLES) == {"strength_adjusted", "elastic_net_grid", "walk_forward"}
    assert set(ORACLES) <= set(QUERIES)
