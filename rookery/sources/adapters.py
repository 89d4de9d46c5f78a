"""Sources behind one interface, and a registry by name."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.nested import flat_quotes, line_type
from rookery.functions.times import to_utc

GAMES = "game_id string, home_team_id string, away_team_id string, season int, week int, date timestamp, status string, home_score int, away_score int, venue string, city string, neutral_site boolean, conference_game boolean"
LINES = "game_id string, line_type string, line_value double, timestamp timestamp, source string, closing_line double, book_name string"
TEAMS = "team_id string, name string, conference string, division string, logo_url string, primary_color string, secondary_color string, mascot string, city string, state string"
RECRUITING = "team_id string, season int, class_rank int, avg_rating double, commit_count int, five_stars int, four_stars int, three_stars int, top_players array<struct<name:string,position:string,rating:int,stars:int>>"
SCORES = "game_id string, home_score int, away_score int"
STATS = (
    "game_id string, team_id string, offensive_stats struct<points:int,total_yards:int,passing_yards:int,rushing_yards:int,turnovers:int,third_down_conversions:int,third_down_attempts:int,red_zone_attempts:int,red_zone_touchdowns:int,time_of_possession:string>, "
    "defensive_stats struct<points_allowed:int,yards_allowed:int,sacks:int,interceptions:int,fumbles_recovered:int,tackles_for_loss:int,pass_breakups:int>, "
    "special_teams struct<field_goals_made:int,field_goals_attempted:int,punt_returns:int,kick_returns:int,punt_return_yards:int,kick_return_yards:int>"
)
WEEK_GAMES = "id string, homeTeamId string, awayTeamId string, season int, week int, date timestamp, status string, homeScore int, awayScore int, venue string, city string, neutralSite boolean, conferenceGame boolean"
WEEK_LINES = "gameId string, season int, week int, lineType string, openingLine double, closingLine double, timestamp timestamp, bookName string"
WEEK_TEAMS = "id string, name string, conference string, division string, logoUrl string, primaryColor string, secondaryColor string"
ODDS = "id string, commence_time timestamp, home_team string, away_team string, bookmakers array<struct<key:string,last_update:timestamp,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"


class Source(Protocol):
    """What every source offers; a source without a table returns an empty one of the schema."""

    def games(self) -> DataFrame: ...

    def lines(self) -> DataFrame: ...

    def teams(self) -> DataFrame: ...

    def is_available(self) -> bool: ...


def wrapped_json(spark: SparkSession, path: str, schema: str, wrapper: str | None) -> DataFrame:
    """A JSON file that is an array, or an object that holds the array under ``wrapper``."""
    if wrapper is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    whole = spark.read.schema(f"{wrapper} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(schema))}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(wrapper).alias("r")).select("r.*")


def _columns(schema: str) -> list[str]:
    """The columns of a schema string, split at commas outside angle brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


class JsonSource:
    """Fixtures: games.json, market_lines.json and teams.json in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def games(self) -> DataFrame:
        return wrapped_json(self.spark, f"{self.folder}/games.json", GAMES, "games")

    def lines(self) -> DataFrame:
        return wrapped_json(self.spark, f"{self.folder}/market_lines.json", LINES, "market_lines")

    def teams(self) -> DataFrame:
        return wrapped_json(self.spark, f"{self.folder}/teams.json", TEAMS, "teams")

    def recruiting(self) -> DataFrame:
        return wrapped_json(self.spark, f"{self.folder}/recruiting.json", RECRUITING, "recruiting")

    def scores(self) -> DataFrame:
        return wrapped_json(self.spark, f"{self.folder}/scores.json", SCORES, None)

    def team_game_stats(self) -> DataFrame:
        """Box scores, one row to a team and game; possession time in seconds too."""
        rows = wrapped_json(self.spark, f"{self.folder}/team_game_stats.json", STATS, "team_game_stats")
        clock = F.split("time_of_possession", ":")
        flat = rows.select("game_id", "team_id", "offensive_stats.*", "defensive_stats.*", "special_teams.*")
        return flat.withColumn("possession_seconds", clock[0].cast("int") * 60 + clock[1].cast("int"))

    def is_available(self) -> bool:
        try:
            return bool(self.games().take(1))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise


class WeekSource:
    """Files of a season's weeks, schedules-<season>-week-<week>.json and market-lines-<season>-week-<week>.json, and teams.json, each an array or an object that holds it.

    Names come out in snake case. Weeks without a file are left out; without any there is an empty table.
    """

    def __init__(self, spark: SparkSession, folder: str, season: int | str = "*", weeks: list[int] | None = None):
        self.spark, self.folder, self.season = spark, folder, season
        self.weeks = "*" if weeks is None else "{%s}" % ",".join(map(str, weeks))

    def _read(self, name: str, schema: str, wrapper: str) -> DataFrame:
        kind = f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(schema))}>>"
        names = [c.split()[0] for c in _columns(schema)]
        try:
            raw = self.spark.read.schema(f"{schema}, {wrapper} {kind}").option("multiLine", True).json(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raw = self.spark.createDataFrame([], f"{schema}, {wrapper} {kind}")
        rows = raw.select(F.explode(F.coalesce(wrapper, F.array(F.struct(*names)))).alias("r")).select("r.*")
        return rows.toDF(*[re.sub("[A-Z]", lambda m: f"_{m[0].lower()}", n) for n in names])

    def games(self) -> DataFrame:
        return self._read(f"schedules-{self.season}-week-{self.weeks}.json", WEEK_GAMES, "games").withColumnRenamed("id", "game_id")

    def lines(self) -> DataFrame:
        return self._read(f"market-lines-{self.season}-week-{self.weeks}.json", WEEK_LINES, "marketLines")

    def teams(self) -> DataFrame:
        return self._read("teams.json", WEEK_TEAMS, "teams").withColumnRenamed("id", "team_id")

    def is_available(self) -> bool:
        return bool(self.games().take(1))


class ParquetSource(JsonSource):
    """Tables as Parquet in a folder."""

    def games(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/games.parquet")

    def lines(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/market_lines.parquet")

    def teams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/teams.parquet")


class OddsSource(JsonSource):
    """Landed odds events, nested by bookmaker, market and outcome."""

    def lines(self) -> DataFrame:
        return self._flat(self.spark.read.schema(ODDS).json(f"{self.folder}/odds.json"))

    def history(self) -> DataFrame:
        """Landed snapshots (timestamp, and ``data``, an event as it stood then) as lines with ``snapshot``; a repeated line of a snapshot counts once."""
        event = f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(ODDS))}>"
        raw = self.spark.read.schema(f"timestamp timestamp, data {event}").json(f"{self.folder}/odds_history.json")
        return self._flat(raw.select(F.col("timestamp").alias("snapshot"), "data.*"), "snapshot").distinct()

    def _flat(self, events: DataFrame, *kept: str) -> DataFrame:
        raw = events.withColumnRenamed("id", "event_id")
        flat = flat_quotes(raw, *kept).withColumn("line_type", line_type(F.col("market")))
        value = F.when(F.col("line_type") == "moneyline", F.col("price")).otherwise(F.col("point"))
        return flat.where("line_type is not null").select(F.col("event_id").alias("game_id"), "line_type", value.alias("line_value"), F.col("ts").alias("timestamp"), F.lit("odds").alias("source"), F.col("book").alias("book_name"), F.col("name").alias("team"), "price", *kept)


#: Sources by name; register a class to add one.
REGISTRY: dict[str, type] = {"json": JsonSource, "weeks": WeekSource, "parquet": ParquetSource, "odds": OddsSource}


def source(spark: SparkSession, name: str, folder: str) -> Source:
    if name not in REGISTRY:
        raise ValueError(f"no source named {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, folder)


def scheduled(games: DataFrame, venues: DataFrame) -> DataFrame:
    """Games with their venue, and kickoffs from local time to UTC (venues without a zone: America/New_York)."""
    both = games.join(venues.select("venue_id", F.col("name").alias("venue"), "timezone"), "venue_id", "left")
    return both.withColumn("kick", to_utc(F.col("local_start"), F.coalesce("timezone", F.lit("America/New_York")))).drop("local_start")


def nearest_weather(games: DataFrame, hours: DataFrame) -> DataFrame:
    """The hourly observation nearest to each kickoff, the earlier at a tie."""
    gap = F.abs(F.unix_micros("hour") - F.unix_micros("kick"))
    pairs = games.select("game_id", "city", "kick").join(hours, "city")
    return pairs.groupBy("game_id").agg(F.min_by(F.struct("hour", "temperature", "wind", "precipitation"), F.struct(gap, F.col("hour"))).alias("w")).select("game_id", "w.*")


def injuries(raw: DataFrame) -> DataFrame:
    """Provider statuses and positions in the engine's terms."""
    # Statuses and positions.
    status = F.create_map(*[F.lit(x) for x in ("out", "OUT", "ir", "OUT", "doubtful", "DOUBTFUL", "questionable", "QUESTIONABLE", "day-to-day", "QUESTIONABLE", "probable", "PROBABLE")])
    position = F.create_map(*[F.lit(x) for x in ("HB", "RB", "FB", "RB", "TE", "WR", "OT", "OL", "OG", "OL", "C", "OL", "DE", "DL", "DT", "DL", "CB", "DB", "S", "DB")])
    p = F.upper("position")
    return raw.withColumns({"severity": F.coalesce(status[F.lower(F.trim("status"))], F.lit("QUESTIONABLE")), "position": F.coalesce(position[p], p)})
