"""Records, bands, medians, profiles and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.numbers import Number, col, ratio


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def record(result: str = "result", stake: str = "stake", pnl: str = "pnl", edge: str = "edge", clv: str = "clv") -> list[Column]:
    """Bets, wins, losses, pushes, win rate of decided and hit rate of graded bets, stake, profit, return, mean edge and mean CLV. Rates are fractions; without bets to divide by they are null."""
    r = F.col(result)
    wins, losses = count_if(r == "win"), count_if(r == "loss")
    return [
        F.count("*").alias("bets"),
        wins.alias("wins"),
        losses.alias("losses"),
        count_if(r == "push").alias("pushes"),
        ratio(wins, wins + losses).alias("win_rate"),
        ratio(wins, count_if(r.isNotNull())).alias("hit_rate"),
        F.sum(stake).alias("stake"),
        F.sum(F.coalesce(F.col(pnl), F.lit(0.0))).alias("pnl"),
        ratio(F.sum(F.coalesce(F.col(pnl), F.lit(0.0))), F.sum(stake)).alias("roi"),
        F.avg(edge).alias("avg_edge"),
        F.avg(clv).alias("avg_clv"),
    ]


def breakdowns(bets: DataFrame, *keys: str) -> DataFrame:
    """The record by each key alone and over all, in one pass."""
    sets = [[k] for k in keys] + [[]]
    grouped = bets.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(*record(), F.grouping_id().alias("level"))


def band(x: Number, cuts: list[float], names: list[str]) -> Column:
    """The name of the first cut that x lies under, or the last name; null stays null."""
    x, out = col(x), F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(x < cut, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def histogram(df: DataFrame, x: Number) -> DataFrame:
    return df.groupBy(F.floor(col(x)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def mean_zero_as_null(x: Number) -> Column:
    """The mean with nulls as zeros; a mean of 0 is null."""
    return F.nullif(F.sum(F.coalesce(col(x), F.lit(0.0))) / F.count("*"), F.lit(0.0))


def weighted_mean(x: Number, weight: Number) -> Column:
    """Null values add nothing but their weight counts."""
    return ratio(F.sum(F.coalesce(col(x), F.lit(0.0)) * col(weight)), F.sum(col(weight)))


def nearest_rank(df: DataFrame, keys: list[str], x: str, shares: dict[str, float], bins: int = 256) -> DataFrame:
    """sorted[floor(n * p)] of each group, exactly and without sorting a group.

    Distinct values are counted first and cut into ``bins`` equal widths between the group's ends. The bins' counts tell which
    bin holds a rank, and only that bin's values are put in order. NaN and infinities are sorted like Spark does, in bins of their own.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    v = F.col(x).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    ends = values.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.sum("_n").alias("_all"))
    # halves, as the difference of the ends may overflow
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)).otherwise(0)
    place = F.when(F.isnan(v), bins + 2).when(v == float("inf"), bins + 1).when(v == float("-inf"), -1).otherwise(at)
    binned = _joined(values, ends, keys).withColumn("_bin", place)
    held = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_held"), F.max("_all").alias("_all"))  # at most bins + 4 rows to a group
    held = held.withColumn("_before", F.sum("_held").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_held"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("_all") * p) + 1, F.col("_all")).alias("rank")) for name, p in shares.items()])
    sought = held.select(*keys, "_bin", "_before", "_held", F.explode(ranks).alias("_r")).where("_r.rank > _before and _r.rank <= _before + _held")
    near = _joined(binned.drop("_all"), sought, [*keys, "_bin"])
    passed = near.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin", "_r.name").orderBy(x))).where("_to >= _r.rank")
    return passed.groupBy(*keys).agg(*[F.min(F.when(F.col("_r.name") == name, F.col(x))).alias(name) for name in shares])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join in which null keys meet."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # without keys the right side is one row
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(other, on).drop(*[f"_k{i}" for i in range(len(keys))])


def fill_ratio(df: DataFrame, *columns: str) -> DataFrame:
    """column, rows, filled and ratio, from one aggregate turned on its side."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot("_rows", list(columns), "column_name", "filled")
    return long.select("column_name", F.col("_rows").alias("n_rows"), "filled", ratio("filled", "_rows").alias("ratio"))


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """Count, nulls, zeros, mean, population deviation, minimum and maximum of numeric columns, over the whole table."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "x")
    return long.groupBy("column_name").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count("x")).alias("nulls"), count_if(F.col("x") == 0).alias("zeros"),
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.min("x").alias("least"), F.max("x").alias("most"),
    )


def crosstab(df: DataFrame, a: Column, b: Column, least: int, *values: Column) -> DataFrame:
    """A two-way breakdown without its small cells."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"), *values).where(F.col("n") >= least)


def upper_median(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return nearest_rank(df, keys, x, {"upper_median": 0.5})


def residual_buckets(df: DataFrame, residual: str) -> DataFrame:
    size = F.abs(F.col(residual))
    bucket = F.when(size <= 7, "0-7").when(size <= 14, "7-14").when(size <= 28, "14-28").otherwise("28+")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("deviation"))


def drives(rows: DataFrame) -> DataFrame:
    """Per team and side: drives, quality rate (40 yards), tempo, scoring opportunities, points an opportunity, mean share of available yards."""
    from rookery.functions.numbers import available_yards, scoring_opportunity

    ended = "end_yards" if "end_yards" in rows.columns else None
    kept = ["start_yards", "yards", "points", *([ended] if ended else [])]
    side = lambda who, name: rows.select("game_id", F.col(who).alias("team"), F.lit(name).alias("side"), *kept)
    sides = side("offense", "off").unionByName(side("defense", "def"))
    chance = scoring_opportunity("start_yards", "yards", ended)
    return sides.groupBy("team", "side").agg(
        F.count("*").alias("drives"), (count_if(F.col("yards") >= 40) / F.count("*")).alias("quality_rate"), (F.count("*") / F.countDistinct("game_id")).alias("tempo"),
        count_if(chance).alias("opportunities"), ratio(F.sum(F.when(chance, F.col("points"))), count_if(chance)).alias("points_per_opportunity"),
        F.avg(available_yards("start_yards", "yards", ended)).alias("available_yards"),
    )


def transfers(rows: DataFrame) -> DataFrame:
    """Players in and out of each team."""
    moves = rows.select(F.col("destination").alias("team"), F.lit("in").alias("way")).unionByName(rows.select(F.col("origin").alias("team"), F.lit("out").alias("way"))).where("team is not null")
    counted = moves.groupBy("team").pivot("way", ["in", "out"]).count()
    return counted.select("team", F.coalesce("in", F.lit(0)).alias("n_in"), F.coalesce("out", F.lit(0)).alias("n_out"))


def gates(df: DataFrame, checks: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """Assertion rows (check, value, passed) of aggregates and their bounds, from one pass; a null value fails."""
    row = df.agg(*[v.cast("double").alias(k) for k, (v, _, _) in checks.items()]).unpivot([], list(checks), "check_name", "value")
    passed = F.lit(False)
    for k, (_, lo, hi) in checks.items():
        passed = F.when(F.col("check_name") == k, F.coalesce(F.col("value").between(lo, hi), F.lit(False))).otherwise(passed)
    return row.withColumn("passed", passed)
