"""Keyed tables: what a change makes of the rows, and which files it touches."""

import random
from pathlib import Path

import pytest

from rookery.operators.keyed import KeyedTable

KIND = "game int, book string, ts int, line double"


def files(path):
    return {(p.parent.name, p.name, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet")}


def rows(t):
    return sorted(map(tuple, t.read().select("game", "book", "ts", "line").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    start = spark.createDataFrame([(g, b, 10, float(g)) for g in range(60) for b in "xy"], KIND)
    return KeyedTable(spark, f"{tmp_path}/quotes", ("game", "book"), ("ts",), buckets=16).create(start)


def test_a_merge_of_one_key_leaves_all_other_files(spark, table):
    before = files(table.path)
    assert len({b for b, *_ in before}) == 16
    change = spark.createDataFrame([(7, "x", 11, 99.0)], KIND)
    (bucket,) = table.merge(change)
    after = files(table.path)
    assert {f for f in before if f[0] != f"_bucket={bucket}"} == {f for f in after if f[0] != f"_bucket={bucket}"}
    want = rows(table)
    assert (7, "x", 11, 99.0) in want and len(want) == 120
    assert table.merge(change) == [bucket] and rows(table) == want  # a batch that is run twice
    again = files(table.path)
    assert {f for f in before if f[0] != f"_bucket={bucket}"} == {f for f in again if f[0] != f"_bucket={bucket}"}


def test_random_changes_match_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    t, held = KeyedTable(spark, f"{tmp_path}/t", ("game", "book"), ("ts",), buckets=5), {}
    for n in range(4):
        change = [(rng.choice([None, *range(12)]), rng.choice("xyz"), rng.randrange(6), float(n)) for _ in range(25)]
        change = list({(g, b, s): (g, b, s, v) for g, b, s, v in change}.values())
        for g, b, s, v in change:
            if (g, b) not in held or held[g, b][0] <= s:
                held[g, b] = (s, v)
        t.merge(spark.createDataFrame(change, KIND))
        assert rows(t) == sorted([(*k, *v) for k, v in held.items()], key=repr)
    gone = [(None, "x"), (3, "y"), (500, "x")]
    for k in gone:
        held.pop(k, None)
    t.delete(spark.createDataFrame(gone, "game int, book string"))
    assert rows(t) == sorted([(*k, *v) for k, v in held.items()], key=repr)
    late = [(3, "y", 1, 5.0), *[(g, b, 99, -1.0) for g, b in list(held)[:5]]]
    t.insert(spark.createDataFrame(late, KIND))
    held.setdefault((3, "y"), (1, 5.0))
    assert rows(t) == sorted([(*k, *v) for k, v in held.items()], key=repr)


def test_inserts_and_deletes_of_nothing_new_write_nothing(spark, table):
    before = files(table.path)
    assert table.insert(spark.createDataFrame([(1, "x", 99, 0.0), (2, "y", 99, 0.0)], KIND)) == []
    assert table.delete(spark.createDataFrame([(1, "none")], "game int, book string")) == []
    assert table.merge(spark.createDataFrame([], KIND)) == []
    assert files(table.path) == before


def test_a_bucket_whose_rows_all_go_is_empty(spark, table):
    table.delete(table.read().select("game", "book"))
    assert rows(table) == [] and files(table.path) == set()
    table.merge(spark.createDataFrame([(1, "x", 1, 1.0)], KIND))
    assert rows(table) == [(1, "x", 1, 1.0)]


def test_an_older_row_loses_and_without_an_order_the_change_wins(spark, table, tmp_path):
    table.merge(spark.createDataFrame([(1, "x", 9, -1.0), (1, "y", 10, -2.0)], KIND))
    got = {(g, b): v for g, b, _, v in rows(table)}
    assert got[1, "x"] == 1.0 and got[1, "y"] == -2.0
    plain = KeyedTable(spark, f"{tmp_path}/p", ("game", "book"), buckets=2)
    plain.merge(spark.createDataFrame([(1, "x", 5, 1.0)], KIND))
    plain.merge(spark.createDataFrame([(1, "x", 2, 2.0)], KIND))
    assert rows(plain) == [(1, "x", 2, 2.0)]


def test_memberships_are_made_anew_group_by_group(spark, tmp_path):
    kind = "season int, team string"
    t = KeyedTable(spark, f"{tmp_path}/m", ("season", "team"), by=("season",), buckets=4)
    t.create(spark.createDataFrame([(s, x) for s in (2022, 2023, 2024) for x in "abc"], kind))
    t.rebuild(spark.createDataFrame([(2023,), (2024,)], "season int"), spark.createDataFrame([(2023, "b"), (2023, "b"), (2023, "z")], kind))
    got = sorted(map(tuple, t.read().select("season", "team").collect()))
    assert got == [(2022, "a"), (2022, "b"), (2022, "c"), (2023, "b"), (2023, "z")]
    with pytest.raises(ValueError):
        t.rebuild(spark.createDataFrame([(2022,)], "season int"), spark.createDataFrame([(2021, "a")], kind))
