"""Incremental ingests: what is read again, set aside, counted and kept."""

import json

import duckdb
from pyspark.sql import functions as F

from rookery.plans import lake
from rookery.plans.catalog import ORACLES
from rookery.sources import files
from rookery.sources.ingest import SEASON_STAT, TEAM_GAME, Lake
from rookery.streaming import quotes as streams
from rookery.operators.keyed import KeyedTable


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")


def test_team_games_come_in_once_and_bad_rows_are_set_aside(spark, tmp_path):
    aliases = spark.createDataFrame([("Alpha", 1), ("Alpha St", 1), ("Beta", 2)], "alias string, team_id int")
    lake, landed = Lake(spark, f"{tmp_path}/lake", 4), tmp_path / "landed"
    game = {"gameId": 9, "team": "Alpha", "season": 2024, "week": 3, "asOf": "2024-09-20T00:00:00Z", "offense": {"epa": 0, "successRate": 0.4, "ppo": 3.5, "havoc": {"total": 0.1, "front7": 0.05}, "rushingPlays": {"epa": -0.2}}, "defense": {"havoc": 0.2, "pointsPerOpportunity": 0}, "new": {"kept": "in bronze"}}
    land(landed, "a.json", [game, {**game, "team": "Beta", "gameId": "x1"}, {**game, "team": "Nobody"}, "[1]", "not json", {"team": "Beta"}])
    lake.run(TEAM_GAME, str(landed), aliases)
    t = lake.table(TEAM_GAME)
    (r,) = t.read().collect()
    assert (r.game_id, r.team_id, r.off_epa, r.off_sr, r.ppo_off, r.ppo_def, r.havoc_off, r.havoc_front7_off, r.havoc_def, r.run_epa, r.week) == (9, 1, None, 0.4, 3.5, 0.0, 0.1, 0.05, 0.2, -0.2, 3)
    bad = sorted((r.reason, r.batch) for r in lake.quarantine(TEAM_GAME).collect())
    assert bad == [("bad game_id", 0), ("no game_id", 0), ("no object", 0), ("no object", 0), ("unmapped team", 0)]
    lake.run(TEAM_GAME, str(landed), aliases)  # nothing new
    assert lake.manifest().count() == 1
    land(landed, "b.json", [{**game, "asOf": "2024-09-19T00:00:00Z", "week": 1}, {**game, "team": "Alpha St", "gameId": 10, "asOf": "2024-09-25T00:00:00Z"}])
    lake.run(TEAM_GAME, str(landed), aliases)
    assert sorted((r.game_id, r.week) for r in t.read().collect()) == [(9, 3), (10, 3)]  # the older row of game 9 lost
    got = {r.batch: r for r in lake.manifest().collect()}
    assert [(got[i].files, got[i].rows_in, got[i].rows_kept, got[i].reasons) for i in (0, 1)] == [(1, 6, 1, {"no object": 2, "bad game_id": 1, "no game_id": 1, "unmapped team": 1}), (1, 2, 2, None)] or got[1].reasons == {}
    (mark,) = lake.marks().collect()
    assert (mark.feed, mark.files, mark.rows_in, mark.high_water) == ("team_game", 2, 8, "2024-09-25 00:00:00")
    for r in got.values():
        assert r.rows_in == r.rows_kept + sum((r.reasons or {}).values())


def test_a_feed_lost_between_table_and_manifest_is_mended_by_its_next_run(spark, tmp_path):
    aliases = spark.createDataFrame([("Alpha", 1)], "alias string, team_id int")
    lake, landed = Lake(spark, f"{tmp_path}/lake", 4), tmp_path / "landed"
    rows = [{"season": 2024, "team": "Alpha", "category": "c", "statName": f"s{i}", "statValue": i, "place": i} for i in range(20)]
    land(landed, "a.json", rows)
    lake.run(SEASON_STAT, str(landed), aliases)
    before = sorted(map(tuple, lake.table(SEASON_STAT).read().collect()))
    for name in ("0", ".0.crc"):  # as if the run broke off after its writes
        (tmp_path / "lake/checkpoints/season_stat/commits" / name).unlink()
    lake.run(SEASON_STAT, str(landed), aliases)
    assert sorted(map(tuple, lake.table(SEASON_STAT).read().collect())) == before and lake.manifest().count() == 1


def test_the_last_number_of_a_repeated_field_counts(spark):
    rows = [(1, "Total Yards", "9", 0), (1, "total yards", "4", 1), (1, "Total Yards", "n/a", 2), (1, "Total Yards", None, 3), (1, "Total Yards", "NaN", 4), (1, "other", "7", 5), (2, "Plays", "3", 0)]
    df = spark.createDataFrame(rows, "team int, stat string, v string, place int")
    got = {r.team: (r.total_yards, r.plays) for r in files.pivoted(df, ["team"], "stat", "v", ["total_yards", "plays"], ["place"]).collect()}
    assert got == {1: (4.0, None), 2: (None, 3.0)}


def test_streams_merge_into_buckets(spark, tmp_path):
    schema = "event_id bigint, t bigint, user_id bigint, event_type string, value double, props string"
    for part in ([(1, 1000, 7, "view", 1.0, ""), (3, 1000, 9, "view", 3.0, "")], [(1, 1001, 7, "view", 5.0, ""), (2, 1002, 8, "view", 2.0, ""), (3, 900, 9, "view", 0.0, "")]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = KeyedTable(spark, f"{tmp_path}/t", ("event_id",), ("ts",), buckets=4)
    for _ in range(2):
        streams.upserted(streams.stream(spark, f"{tmp_path}/in"), table, f"{tmp_path}/c").awaitTermination()
    assert sorted((r.event_id, r.value) for r in table.read().collect()) == [(1, 5.0), (2, 2.0), (3, 3.0)]


def test_of_values_that_tie_the_first_in_the_table_counts_as_in_sql(spark, tmp_path):
    rows = [(k, 7, 9, 1, float(v), flag) for k in range(20) for flag in "AN" for v in ((30, 40, 35), (45, 20, 31))[k % 2]]
    names = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows + [(99, None, 1, 1, 5.0, "A"), (99, 2, 1, 1, 6.0, "A")], names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.pass_yards, r.plays) for r in lake.last_numbers(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet') where l_orderkey < 99")
    assert {k: v for k, v in got.items() if k < 99} == {r[0]: r[1:] for r in con.execute(ORACLES["last_numbers"]).fetchall()} == {k: (30.0, 30.0) if k % 2 == 0 else (45.0, 45.0) for k in range(20)}
    assert got[99] == (6.0, None)  # a line without a number comes before all others
