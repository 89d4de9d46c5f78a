"""Bets: generation by edge, grading, overlap, portfolios and backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.numbers import Number, american_payout, col

#: Profit per unit of a win at the usual price of -110.
PAYOUT = 0.909


def spread_result(margin: Number, line: Number, push: float = 0.5, raw: bool = False) -> Column:
    """Result of a side's margin against its handicap; within ``push`` of it is a push. ``raw`` subtracts the stored line instead of adding it."""
    d = col(margin) - col(line) if raw else col(margin) + col(line)
    return F.when(F.abs(d) < push, "push").when(d > 0, "win").when(d < 0, "loss")


def total_result(points: Number, line: Number, over: Column, push: float = 0.5) -> Column:
    d = F.when(over, col(points) - col(line)).otherwise(col(line) - col(points))
    return F.when(F.abs(d) < push, "push").when(d > 0, "win").when(d < 0, "loss")


def moneyline_result(margin: Number) -> Column:
    return F.when(col(margin) > 0, "win").when(col(margin) < 0, "loss").when(col(margin) == 0, "push")


def profit(result: Column, stake: Number, price: Number | None = None, payout: float = PAYOUT) -> Column:
    """Profit of a graded bet; ungraded bets have none."""
    won = col(stake) * (payout if price is None else F.coalesce(american_payout(price), F.lit(payout)))
    return F.when(result == "win", won).when(result == "loss", -col(stake)).when(result == "push", 0.0)


def generated(games: DataFrame, model: str, market: str, strategy: str, floor: float = 0.1, stake: float = 100.0) -> DataFrame:
    """Flat bets on every game whose model and market differ by the floor, with the side of the difference."""
    edge = F.col(model) - F.col(market)
    picked = games.where(F.abs(edge) >= floor)
    return picked.withColumns({"edge": F.abs(edge), "side": F.when(edge > 0, "home").otherwise("away"), "stake": F.lit(stake), "strategy": F.lit(strategy)})


def conflicts(hybrid: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Each hybrid bet's conflict with another strategy: strong if the sides differ, weak if they agree, hybrid_only without one."""
    o = other.groupBy(key).agg(F.min("side").alias("_side"))
    kind = F.when(F.col("_side").isNull(), "hybrid_only").when(F.col("_side") != F.col("side"), "strong").otherwise("weak")
    return hybrid.join(o, key, "left").withColumn("conflict", kind).drop("_side")


def overlap(a: DataFrame, b: DataFrame, key: str, side: str = "side") -> DataFrame:
    """Games by who bets on them: a_only, b_only, same or opposite."""
    left, right = a.select(key, F.col(side).alias("a_side")), b.select(key, F.col(side).alias("b_side"))
    kind = F.when(F.col("b_side").isNull(), "a_only").when(F.col("a_side").isNull(), "b_only").when(F.col("a_side") == F.col("b_side"), "same").otherwise("opposite")
    return left.join(right, key, "full_outer").withColumn("overlap", kind)


def agreeing(bets: DataFrame, others: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each bet with the first agreeing bet of the others, one to a bet."""
    first = others.withColumn("_n", F.row_number().over(Window.partitionBy(key, "side").orderBy(*order))).where("_n = 1").select(key, "side", F.col("bet_id").alias("other_id"))
    return bets.join(first, [key, "side"])


def portfolio(core: DataFrame, extra: DataFrame, key: str, everything: bool = False) -> DataFrame:
    """The core bets and those extra ones whose game the core lacks, or all of both."""
    return core.unionByName(extra if everything else extra.join(core.select(key).distinct(), key, "left_anti"))


def without_weak_underdogs(bets: DataFrame, least: float = 0.6) -> DataFrame:
    """Bets but for underdogs of low continuity; unknown continuity or close stays."""
    weak = (F.col("continuity") < least) & (F.col("close") >= 0)
    return bets.where(~F.coalesce(weak, F.lit(False)))


def ruleset(games: DataFrame, rules: dict) -> DataFrame:
    """Games that pass a ruleset's thresholds, confidence, and team lists, at most ``maxGames`` of the greatest edge; ``key`` breaks ties."""
    passed = F.lit(False)
    for market, least in rules.get("edges", {}).items():
        passed = passed | (F.abs(F.col(market)) >= least)
    if rules.get("confidence"):
        passed = passed & F.col("confidence").isin(*rules["confidence"])
    if rules.get("include"):
        passed = passed & F.col("team").isin(*rules["include"])
    if rules.get("exclude"):
        passed = passed & ~F.col("team").isin(*rules["exclude"])
    top = F.greatest(*[F.abs(F.col(m)) for m in rules["edges"]], F.lit(0.0)).alias("max_edge")
    kept = games.where(passed).select("*", top)
    return kept.orderBy(F.desc("max_edge"), rules.get("key", "game")).limit(rules["maxGames"]) if rules.get("maxGames") else kept


def backtest(bets: DataFrame, keys: list[str], order: list[str], payout: float = PAYOUT) -> DataFrame:
    """Flat-stake equity, drawdown and sequence of graded bets; the payout is a parameter, as runs differ on it."""
    from rookery.operators.windows import drawdown

    return drawdown(bets.withColumn("pnl", profit(F.col("result"), "stake", payout=payout)), keys, order, "pnl")


def funnel(bets: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows are left after each stage, counted in one pass."""
    so_far, counts = F.lit(True), []
    for name, condition in stages.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count(F.when(so_far, 1)).alias(name))
    return bets.agg(*counts).unpivot([], list(stages), "stage", "n")


def grid(rows: DataFrame, weights: list[float], a: str, b: str, target: str) -> DataFrame:
    """Correlation and errors of w * a + (1 - w) * b with a target, for every weight at once.

    One aggregate over the rows as they are: the correlation and the mean squared error of every weight are quadratic forms in the same few means; only the mean
    absolute error is a sum of its own to each weight, and with both the deviation of absolute errors is known.
    """
    x, y, t = (F.col(c).cast("double") for c in (a, b, target))
    known = x.isNotNull() & y.isNotNull() & t.isNotNull()
    mean = lambda e: F.avg(F.when(known, e))
    u, v = x - y, y - t  # the blend is y + w * u, its error v + w * u
    forms = {"u": u, "v": v, "y": y, "t": t, "uu": u * u, "uv": u * v, "vv": v * v}
    centred = {"cuu": F.var_pop(F.when(known, u)), "cyy": F.var_pop(F.when(known, y)), "ctt": F.var_pop(F.when(known, t)), "cuy": F.covar_pop(F.when(known, u), F.when(known, y)), "cut": F.covar_pop(F.when(known, u), F.when(known, t)), "cyt": F.covar_pop(F.when(known, y), F.when(known, t))}
    mae = F.array(*[mean(F.abs(v + w * u)) for w in weights])
    one = rows.agg(F.count("*").alias("n"), mae.alias("maes"), *[mean(e).alias(k) for k, e in forms.items()], *[e.alias(k) for k, e in centred.items()])
    each = one.select("*", F.explode(F.arrays_zip(F.array(*map(F.lit, weights)).alias("w"), F.col("maes").alias("mae"))).alias("_z")).where("n > 0")
    w, m = F.col("_z.w"), F.col("_z.mae")
    square = F.greatest(F.lit(0.0), F.col("vv") + 2 * w * F.col("uv") + w * w * F.col("uu"))
    spread = F.greatest(F.lit(0.0), F.col("cyy") + 2 * w * F.col("cuy") + w * w * F.col("cuu"))
    pearson = F.when((spread > 0) & (F.col("ctt") > 0), (F.col("cyt") + w * F.col("cut")) / F.sqrt(spread * F.col("ctt")))
    return each.select(w.alias("w"), pearson.alias("pearson"), F.sqrt(square).alias("rmse"), m.alias("mae"), F.sqrt(F.greatest(F.lit(0.0), square - m * m)).alias("abs_error_deviation"), "n")
