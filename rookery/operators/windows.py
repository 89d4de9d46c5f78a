"""Ordered analytics: strictly prior means, EWMA, recency weights, gaps, drawdown, bankroll, standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.numbers import Number, col, ratio, zscore
from rookery.functions.times import whole_days
from rookery.operators import scans

#: Weights of the latest, the one before, and so on.
EWMA_3, EWMA_5 = (0.6, 0.3, 0.1), (0.4, 0.3, 0.15, 0.1, 0.05)


def prior_mean(x: Number, keys: list[str], week: str) -> Column:
    """The mean of strictly earlier weeks."""
    return F.avg(col(x)).over(Window.partitionBy(*keys).orderBy(week).rangeBetween(Window.unboundedPreceding, -1))


def ewma(x: str, keys: list[str], order: list[str], weights: tuple[float, ...], prior: Number | None = None, prior_weight: float = 0.0) -> Column:
    """The weighted mean of the last rows before this one, the latest first; nulls go and the weights left are made to sum to 1. A prior joins with its own weight."""
    w = Window.partitionBy(*keys).orderBy(*order)
    terms = [F.lag(x, i + 1).over(w) for i in range(len(weights))]
    top = sum(F.coalesce(t * k, F.lit(0.0)) for t, k in zip(terms, weights))
    bottom = sum(F.when(t.isNotNull(), k).otherwise(0.0) for t, k in zip(terms, weights))
    if prior is not None:
        top, bottom = top + F.coalesce(col(prior) * prior_weight, F.lit(0.0)), bottom + F.when(col(prior).isNotNull(), prior_weight).otherwise(0.0)
    return ratio(top, bottom)


def recency_mean(df: DataFrame, keys: list[str], order: list[Column], x: str, last: int = 3, heavier: float = 1.5) -> DataFrame:
    ranked = df.where(F.col(x).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    weight = F.when(F.col("_n") <= last, heavier).otherwise(1.0)
    return ranked.groupBy(*keys).agg((F.sum(F.col(x) * weight) / F.sum(weight)).alias("recency_mean"), F.count("*").alias("n"))


def rest(df: DataFrame, keys: list[str], date: str, tie: str, bye: int = 10) -> DataFrame:
    """Whole days since the key's previous row, and whether they are more than ``bye``."""
    before = F.lag(date).over(Window.partitionBy(*keys).orderBy(date, tie))
    return df.withColumn("rest_days", whole_days(F.col(date), before)).withColumn("bye", F.coalesce(F.col("rest_days") > bye, F.lit(False)))


def last_n_mean(df: DataFrame, keys: list[str], order: list[Column], x: str, n: int = 10) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return ranked.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))


def line_history(df: DataFrame, keys: list[str], ts: str, tie: str, x: str) -> DataFrame:
    """Opening, closing, movement, least, most and spread of a series."""
    at = F.struct(ts, tie)
    return df.groupBy(*keys).agg(
        F.min_by(x, at).alias("opening"), F.max_by(x, at).alias("closing"), (F.max_by(x, at) - F.min_by(x, at)).alias("movement"),
        F.min(x).alias("least"), F.max(x).alias("most"), (F.max(x) - F.min(x)).alias("spread"), F.count(x).alias("quotes"),
    )


def drawdown(df: DataFrame, keys: list[str], order: list[str], pnl: str) -> DataFrame:
    """Equity after each row, its peak so far (0 at least) and how far below the peak it is; null profit carries. ``x`` is the row's place. A segmented scan, so one ledger is many tasks' work."""
    run = scans.scan(df, keys, order, {"equity": scans.total(F.coalesce(F.col(pnl), F.lit(0.0))), "x": scans.total(F.lit(1))}, {"peak": "equity"})
    run = run.withColumns({"x": F.col("x").cast("int"), "peak": F.greatest(F.lit(0.0), F.col("peak"))})
    return run.withColumn("drawdown", F.col("peak") - F.col("equity"))


def bankroll(df: DataFrame, keys: list[str], order: list[str], share: str, outcome: str, start: float = 1000.0) -> DataFrame:
    """Compounding: each stake is a share of what is left, so a row multiplies the bankroll by 1 + share * outcome.

    ``outcome`` is profit per unit staked. Products are sums of logarithms with the sign of ruin kept apart: once a factor is
    zero or less the bankroll stays 0. A segmented scan, so one ledger is many tasks' work.
    """
    factor = 1 + F.coalesce(F.col(share) * F.col(outcome), F.lit(0.0))
    run = scans.scan(df, keys, order, {"_log": scans.total(F.when(factor > 0, F.log(factor)).otherwise(0.0)), "_ruined": scans.most((factor <= 0).cast("int"))})
    return run.withColumn("bankroll", F.when(F.col("_ruined") == 1, 0.0).otherwise(F.exp("_log") * start)).drop("_log", "_ruined")


def standardised(df: DataFrame, keys: list[str], *columns: str, null_as_zero: bool = False) -> DataFrame:
    """z_<column> with population moments of the key's rows, joined back from one aggregate so that no key is gathered."""
    moments = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(moments, keys) if keys else df.crossJoin(F.broadcast(moments))
    z = {f"z_{c}": zscore(c, f"_m_{c}", f"_s_{c}", null_as_zero) for c in columns}
    return joined.withColumns(z).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def winsorised(df: DataFrame, keys: list[str], x: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """x clipped to its nearest-rank percentiles, then standardised by the moments before clipping; a deviation of 1e-4 or less gives null."""
    from rookery.operators.aggregates import nearest_rank

    ends = nearest_rank(df, keys, x, {"_lo": lo, "_hi": hi})
    moments = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    joined = df.join(ends.join(moments, keys), keys, "left")
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(x)))
    z = F.when(F.col("_s") > 1e-4, (clipped - F.col("_m")) / F.col("_s"))
    return joined.withColumn("clipped", F.when(F.col(x).isNotNull(), clipped)).withColumn("z", F.when(F.col(x).isNotNull(), z)).drop("_lo", "_hi", "_m", "_s")


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str, blocks: int | None = None) -> DataFrame:
    """``name``: the rank of each row in its key by ``order`` (from 1, nulls first), by a segmented scan, so no key is sorted by one task."""
    return scans.scan(df, keys, order, {name: scans.total(F.lit(1))}, blocks=blocks)


def spearman(df: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    """Correlation of ordinal ranks; ties are broken by ``tie``, not averaged."""
    both = ordinal(ordinal(df.select(*keys, a, b, tie), keys, [a, tie], "_a"), keys, [b, tie], "_b")
    return both.groupBy(*keys).agg(F.corr(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("spearman"), F.corr(a, b).alias("pearson"), F.count("*").alias("n"))


def rank_correlation(df: DataFrame, keys: list[str], order: list[str], ranks: str, name: str) -> DataFrame:
    """``keys`` and ``name``: the correlation of each row's rank in its key by ``order`` (as ``ordinal`` has it) with ``ranks``, which holds the numbers from 1 to the key's rows. Null for a single row.

    The rows are put in order once: a run hands on its sums, and the ranks before a run are added to these. The means and spreads of both follow from the number of rows.
    """
    inside = scans.runs(df.select(*keys, *order, ranks), keys, order).withColumn("_place", F.row_number().over(Window.partitionBy("_run", *keys).orderBy(*order)).cast("double"))
    sums = inside.groupBy("_run", *keys).agg(F.count("*").alias("_n"), F.sum(F.col(ranks).cast("double")).alias("_r"), F.sum(F.col("_place") * F.col(ranks)).alias("_pr"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row to a run
    whole = sums.withColumn("_pr", F.col("_pr") + before * F.col("_r")).groupBy(*keys).agg(F.sum("_n").cast("double").alias("_n"), F.sum("_pr").alias("_pr"))
    n, middle = F.col("_n"), (F.col("_n") + 1) / 2
    return whole.select(*keys, F.when(n > 1, (F.col("_pr") / n - middle * middle) / ((n * n - 1) / 12)).alias(name))


def current_week(weeks: DataFrame, now: Column) -> DataFrame:
    """Of week ranges (week, first, last): the one around ``now``, else the next, else the last."""
    rank = F.when((F.col("first") <= now) & (now <= F.col("last")), 0).when(F.col("first") > now, 1).otherwise(2)
    near = F.when(rank == 2, -F.unix_micros("last")).otherwise(F.unix_micros("first"))
    return weeks.agg(F.min_by(F.struct("week", "first", "last"), F.struct(rank, near)).alias("w")).select("w.*")
