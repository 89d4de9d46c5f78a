import json

import pytest

from pyspark.sql import functions as F
from rookery.sources import adapters, files
from rookery.streaming import quotes as streams


def test_json_sources(spark, tmp_path):
    game = {"game_id": "g1", "home_team_id": "a", "away_team_id": "b", "season": 2024, "week": 1, "date": "2024-08-31T16:00:00-04:00", "status": "final", "home_score": 21, "away_score": 0, "neutral_site": False}
    (tmp_path / "games.json").write_text(json.dumps({"games": [game, {**game, "game_id": "g2", "home_score": None}]}))
    (tmp_path / "scores.json").write_text(json.dumps([{"game_id": "g1", "home_score": 21, "away_score": 0}]))
    source = adapters.source(spark, "json", str(tmp_path))
    assert source.is_available()
    rows = {r.game_id: r for r in source.games().collect()}
    assert rows["g1"].home_score == 21 and rows["g2"].home_score is None and rows["g1"].venue is None
    assert source.games().select(F.date_format("date", "HH:mm")).first()[0] == "20:00"
    assert source.scores().count() == 1
    assert not adapters.source(spark, "json", f"{tmp_path}/none").is_available()
    with pytest.raises(ValueError):
        adapters.source(spark, "nothing", ".")


def test_nested_odds_are_flattened(spark, tmp_path):
    event = {"id": "e", "commence_time": "2024-09-01T00:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "dk", "last_update": "2024-08-31T00:00:00Z", "markets": [{"key": "spreads", "outcomes": [{"name": "H", "price": -110, "point": -3.5}, {"name": "A", "price": -110, "point": 3.5}]}, {"key": "h2h", "outcomes": [{"name": "H", "price": -150}]}]}]}
    (tmp_path / "odds.json").write_text(json.dumps(event))
    got = sorted((r.line_type, r.line_value, r.team) for r in adapters.source(spark, "odds", str(tmp_path)).lines().collect())
    assert got == [("moneyline", -150.0, "H"), ("spread", -3.5, "H"), ("spread", 3.5, "A")]


def test_csv_upload_and_export(spark, tmp_path):
    (tmp_path / "up.csv").write_text("Game ID , Edge,Team\n g1 ,2.5,\"A, B\"\n,3,C\ng2,x,D\n")
    df = files.uploaded_csv(spark, f"{tmp_path}/up.csv", {}, ["game_id", "edge"], ["edge"])
    assert sorted(map(tuple, df.collect())) == [("g1", 2.5, "A, B"), ("g2", None, "D")]
    with pytest.raises(ValueError):
        files.uploaded_csv(spark, f"{tmp_path}/up.csv", {}, ["stake"], [])
    files.write_csv(df, f"{tmp_path}/out", quote_all=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert sorted(r.team for r in back.collect()) == ["A, B", "D"]


def stream_of(spark, tmp_path, rows):
    schema = "event_id bigint, t bigint, user_id bigint, event_type string, value double, props string"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return streams.stream(spark, f"{tmp_path}/in")


def test_streams_match_their_batch_forms(spark, tmp_path):
    rows = [[(1, 1000, 7, "view", 1.0, ""), (2, 1060, 7, "view", 2.0, "")], [(2, 1060, 7, "view", 2.0, ""), (3, 1120, 8, "click", 3.0, "")]]
    df = stream_of(spark, tmp_path, rows)
    once = streams.drained(streams.deduplicated(df, ["event_id"]), "once", f"{tmp_path}/c1")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3]
    latest = streams.drained(streams.latest(df, ["user_id"]), "latest", f"{tmp_path}/c2", "complete")
    assert sorted((r.user_id, r.value) for r in latest.collect()) == [(7, 2.0), (8, 3.0)]
    kicks = spark.createDataFrame([(7, 1100)], "user_id bigint, k bigint").withColumn("kick", F.timestamp_seconds("k")).drop("k")
    near = streams.drained(streams.before_kickoff(df, kicks, "user_id", before=1), "near", f"{tmp_path}/c3")
    assert {r.event_id for r in near.collect()} == {2}


def test_stream_upserts_into_a_table(spark, tmp_path):
    df = stream_of(spark, tmp_path, [[(1, 1000, 7, "view", 1.0, "")], [(1, 1001, 7, "view", 5.0, ""), (2, 1002, 8, "view", 2.0, "")]])
    streams.merged(df, f"{tmp_path}/table", ["event_id"], f"{tmp_path}/c").awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "table").iterdir() if p.name.isdigit())
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/table/{last}").collect()}
    assert got == {1, 2}


def test_week_files(spark, tmp_path):
    game = {"id": "g1", "homeTeamId": "a", "awayTeamId": "b", "season": 2024, "week": 1, "date": "2024-08-31T19:00:00Z", "neutralSite": True, "homeScore": 24}
    line = {"gameId": "g1", "season": 2024, "week": 1, "lineType": "spread", "closingLine": -2.5, "timestamp": "2024-08-31T18:30:00Z", "bookName": "x"}
    (tmp_path / "schedules-2024-week-1.json").write_text(json.dumps({"games": [game]}))
    (tmp_path / "schedules-2024-week-3.json").write_text(json.dumps([{**game, "id": "g3", "week": 3}, {**game, "id": "g4", "week": 3}]))
    (tmp_path / "market-lines-2024-week-1.json").write_text(json.dumps({"marketLines": [line]}))
    (tmp_path / "teams.json").write_text(json.dumps([{"id": "a", "logoUrl": "u"}]))
    source = adapters.WeekSource(spark, str(tmp_path), 2024, [1, 2, 3])
    assert sorted((r.game_id, r.week, r.home_score, r.neutral_site) for r in source.games().collect()) == [("g1", 1, 24, True), ("g3", 3, 24, True), ("g4", 3, 24, True)]
    assert [(r.game_id, r.line_type, r.closing_line, r.opening_line, r.book_name) for r in source.lines().collect()] == [("g1", "spread", -2.5, None, "x")]
    assert [(r.team_id, r.logo_url) for r in source.teams().collect()] == [("a", "u")]
    none = adapters.WeekSource(spark, str(tmp_path), 2024, [7])
    assert none.games().collect() == [] and none.games().columns == source.games().columns and not none.is_available()
    assert adapters.source(spark, "weeks", str(tmp_path)).games().count() == 3


def test_box_scores_and_odds_history(spark, tmp_path):
    stats = {"game_id": "g", "team_id": "t", "offensive_stats": {"points": 45, "time_of_possession": "32:15"}, "defensive_stats": {"sacks": 4}, "special_teams": {"punt_returns": 3}}
    (tmp_path / "team_game_stats.json").write_text(json.dumps({"team_game_stats": [stats, {"game_id": "h", "team_id": "t"}]}))
    got = {r.game_id: (r.points, r.sacks, r.punt_returns, r.possession_seconds) for r in adapters.source(spark, "json", str(tmp_path)).team_game_stats().collect()}
    assert got == {"g": (45, 4, 3, 1935), "h": (None, None, None, None)}
    event = {"id": "e", "bookmakers": [{"key": "dk", "last_update": "2024-08-31T00:00:00Z", "markets": [{"key": "totals", "outcomes": [{"name": "Over", "price": -110, "point": 51.5}]}]}]}
    shots = [{"timestamp": t, "data": event} for t in ("2024-08-30T00:00:00Z", "2024-08-31T00:00:00Z", "2024-08-31T00:00:00Z")]
    (tmp_path / "odds_history.json").write_text("\n".join(map(json.dumps, shots)))
    lines = adapters.source(spark, "odds", str(tmp_path)).history()
    assert sorted((str(r.snapshot)[:10], r.line_type, r.line_value) for r in lines.collect()) == [("2024-08-30", "total", 51.5), ("2024-08-31", "total", 51.5)]
