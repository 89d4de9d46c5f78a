"""Registration of queries with their oracle SQL, and the views both sides are written against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.numbers import stable
from rookery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            names = [n for n in VIEWS if f"{n} " in sql or f"{n}\n" in sql or f"{n})" in sql]
            ORACLES[f.__name__] = _with(names, sql.strip())
        return f

    return add


def _with(names: list[str], sql: str) -> str:
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    if not views:
        return sql
    start = "with recursive " if sql.lower().startswith("with recursive ") else "with "
    return f"{start}{views}, {sql[len(start):]}" if sql.lower().startswith("with ") else f"with {views} {sql}"


def st(x: str, places: int = 4) -> str:
    """The SQL of ``stable``."""
    return f"floor(({x}) * {10**places}.0 + 0.5000001) / {10**places}.0"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: stable(n) for n in names})


# The views: quotes and kickoffs of games from events, games of teams from orders, and bets from order lines.
VIEWS = {
    "quotes": "select event_id as quote_id, user_id as game, event_type as book, ts, value as line from events where event_type <> 'purchase'",
    "kicks": "select event_id as kick_id, user_id as game, ts as kick, value as price from events where event_type = 'purchase'",
    "games": "select * from (select o_orderkey as game, o_custkey % 40 as home, (o_custkey * 7 + 3) % 40 as away, cast(round(o_totalprice * 100) as bigint) % 53 as home_score, (cast(round(o_totalprice * 100) as bigint) // 53) % 47 as away_score, o_orderdate as date, cast(year(o_orderdate) as integer) as season from orders) where home <> away",
    "bets": "select l_orderkey as game, l_linenumber as week, l_partkey as part, l_suppkey as book, case l_returnflag when 'R' then 'win' when 'A' then 'loss' else 'push' end as result, l_linestatus as market, l_extendedprice as stake, case l_returnflag when 'R' then l_extendedprice * 0.909 when 'A' then -l_extendedprice else 0.0 end as pnl, l_quantity - 25 as edge, l_discount * 100 - 5 as clv from lineitem",
}


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'purchase'")
    return e.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("game"), F.col("event_type").alias("book"), "ts", F.col("value").alias("line"))


def kicks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("kick_id"), F.col("user_id").alias("game"), F.col("ts").alias("kick"), F.col("value").alias("price"))


def games(spark: SparkSession, d: str) -> DataFrame:
    cents = "cast(round(o_totalprice * 100) as bigint)"
    g = table(spark, d, "orders").selectExpr(
        "o_orderkey as game", "o_custkey % 40 as home", "(o_custkey * 7 + 3) % 40 as away", f"{cents} % 53 as home_score", f"({cents} div 53) % 47 as away_score", "o_orderdate as date", "year(o_orderdate) as season"
    )
    return g.where("home <> away")


def bets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey as game", "l_linenumber as week", "l_partkey as part", "l_suppkey as book", "case l_returnflag when 'R' then 'win' when 'A' then 'loss' else 'push' end as result",
        "l_linestatus as market", "l_extendedprice as stake", "case l_returnflag when 'R' then l_extendedprice * 0.909D when 'A' then -l_extendedprice else 0D end as pnl", "l_quantity - 25 as edge", "l_discount * 100 - 5 as clv",
    )
