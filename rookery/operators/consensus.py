"""Market consensus and the choice of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.frames import hma_to_fc
from rookery.functions.numbers import kept_quotes, round_to_half, round_up
from rookery.operators.dedup import first_per_key


def spread_consensus(quotes: DataFrame, keys: list[str], ts: str = "ts", tie: str = "quote_id") -> DataFrame:
    """The median of each book's first sane quote, favourite-centric and to the half point, with raw and per-book counts."""
    sane = quotes.where(kept_quotes("line", F.lit("spread")))
    raw = quotes.groupBy(*keys).agg(F.count("*").alias("n_raw"))
    each = first_per_key(sane, [*keys, "book"], F.col(ts), F.col(tie)).withColumn("line_fc", round_to_half(hma_to_fc("line")))
    return raw.join(each.groupBy(*keys).agg(round_to_half(F.median("line_fc")).alias("consensus_fc"), F.count("*").alias("n_books")), keys, "left")


def total_consensus(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """The median of all sane totals; books are not thinned to one quote."""
    return quotes.where(kept_quotes("line", F.lit("total"))).groupBy(*keys).agg(F.median("line").alias("consensus_total"), F.count("*").alias("n_quotes"))


def moneyline_consensus(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of favourites' and underdogs' prices, to the nearest 5."""
    sane = quotes.where(kept_quotes("line", F.lit("moneyline")))
    five = lambda x: round_up(x / 5) * 5
    return sane.groupBy(*keys).agg(five(F.median(F.when(F.col("line") < 0, F.col("line")))).alias("favourite_price"), five(F.median(F.when(F.col("line") > 0, F.col("line")))).alias("underdog_price"))


def two_level_median(quotes: DataFrame, keys: list[str], least_books: int = 2, most: float = 60.0) -> DataFrame:
    """The median over books of each book's median."""
    books = quotes.where(F.abs("line") <= most).groupBy(*keys, "book").agg(F.median("line").alias("line"))
    return books.groupBy(*keys).agg(F.median("line").alias("consensus"), F.count("*").alias("n_books")).where(F.col("n_books") >= least_books)


def tiered_consensus(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """The median of two books or more, else a single book's line, else the latest raw line."""
    books = quotes.groupBy(*keys, "book").agg(F.max_by("line", F.struct("ts", "quote_id")).alias("line"))
    some = books.groupBy(*keys).agg(F.median("line").alias("median"), F.count("*").alias("n_books"), F.min("line").alias("single"))
    raw = quotes.groupBy(*keys).agg(F.max_by("line", F.struct("ts", "quote_id")).alias("latest"))
    tier = F.when(F.col("n_books") >= 2, "consensus").when(F.col("n_books") == 1, "single").otherwise("raw")
    return raw.join(some, keys, "left").select(*keys, F.when(F.col("n_books") >= 2, F.col("median")).otherwise(F.coalesce("single", "latest")).alias("line"), tier.alias("tier"))


def best_line(quotes: DataFrame, keys: list[str], preferred: list[str], kind: str = "spread") -> DataFrame:
    """One quote: rows with a team first, negative spreads first, preferred sources first, then the latest."""
    source = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col("source")), F.lit(0))
    rank = F.when(source == 0, len(preferred) + 1).otherwise(source)
    negative = F.when(F.col("line") < 0, 0).otherwise(1) if kind == "spread" else F.lit(0)
    return first_per_key(quotes, keys, F.col("team_id").isNull(), negative, rank, F.desc("ts"), F.col("quote_id"))


def best_group(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """The source and book of the highest score (spread 100, total 10, moneyline 1); groups with a team first, then the latest."""
    has = lambda kind: F.max((F.col("line_type") == kind).cast("int"))
    groups = quotes.groupBy(*keys, "source", "book").agg(
        (has("spread") * 100 + has("total") * 10 + has("moneyline")).alias("score"), F.max(F.col("team_id").isNotNull().cast("int")).alias("with_team"), F.max("ts").alias("latest"),
        *[F.max_by(F.coalesce("closing_line", "line"), F.when(F.col("line_type") == k, F.col("ts"))).alias(k) for k in ("spread", "total", "moneyline")],
    )
    return first_per_key(groups, keys, F.desc("with_team"), F.desc("score"), F.desc("latest"), F.col("source"), F.col("book"))


def opposite_sides(quotes: DataFrame, keys: list[str], seconds: float = 1.0) -> DataFrame:
    """Home and away quotes of a book within a second of each other, and whose handicap is smaller."""
    home = quotes.where("is_home").select(*keys, "book", F.col("ts").alias("home_ts"), F.col("line").alias("home_line"))
    away = quotes.where("not is_home").select(*keys, "book", F.col("ts").alias("away_ts"), F.col("line").alias("away_line"))
    near = F.abs(F.unix_micros("home_ts") - F.unix_micros("away_ts")) <= seconds * 1e6
    return home.join(away, [*keys, "book"]).where(near).withColumn("favourite", F.when(F.col("home_line") < F.col("away_line"), "home").when(F.col("home_line") > F.col("away_line"), "away"))


def replaced_spread(quotes: DataFrame, keys: list[str], most: float = 50.0) -> DataFrame:
    """The first quote, or where it is beyond ``most``, the first other that is not; null with a warning if there is none."""
    order = Window.partitionBy(*keys).orderBy("ts", "quote_id")
    ranked = quotes.withColumn("_n", F.row_number().over(order))
    sane = F.abs("line") <= most
    chosen = ranked.groupBy(*keys).agg(F.min_by("line", "_n").alias("first"), F.min_by("line", F.when(sane, F.col("_n"))).alias("sane"))
    good = F.abs("first") <= most
    return chosen.select(*keys, F.when(good, F.col("first")).otherwise(F.col("sane")).alias("line"), (~good & F.col("sane").isNull()).alias("warning"))


def coverage(kicks: DataFrame, quotes: DataFrame, key: str, kick: str, group: str) -> DataFrame:
    """Per group: games, share with a quote before kickoff, median of books a game."""
    books = kicks.join(quotes, key, "left").groupBy(group, "kick_id").agg(F.countDistinct("book").alias("books"), F.max((F.col("ts") <= F.col(kick)).cast("int")).alias("before"))
    return books.groupBy(group).agg(F.count("*").alias("games"), F.avg(F.coalesce("before", F.lit(0))).alias("pre_kick"), F.median("books").alias("median_books"))
