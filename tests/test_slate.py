"""Slates over tables in which a kickoff's number occurs more than once."""

import duckdb
import pytest

from rookery.plans.catalog import ORACLES, QUERIES
from tests.test_queries import SF, rows


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The tables with two copies of the events: the same numbers, other games."""
    d = str(tmp_path_factory.mktemp("slate"))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"copy (select * from '{SF}/orders.parquet') to '{d}/orders.parquet'")
    con.execute(f"copy (select * from '{SF}/events.parquet' union all select * replace (user_id + 1500 as user_id) from '{SF}/events.parquet') to '{d}/events.parquet'")
    for t in ("orders", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["slate_games", "response_assertions"])
def test_a_kickoff_is_one_row_though_its_number_is_not_its_own(spark, repeated, name):
    d, con = repeated
    got, want = QUERIES[name](spark, d), con.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
