"""What is shown and graded of a week: bets of every market, cards, slates, checks, pages and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.numbers import american_to_probability, conflict_bucket, home_field, moneyline_gate, moneyline_side, moneyline_value, win_probability
from rookery.operators.bets import moneyline_result, profit, spread_result, total_result
from rookery.operators.windows import ordinal


def graded(bets: DataFrame, games: DataFrame, closes: DataFrame, key: str = "game") -> DataFrame:
    """Bets (market, side, model, stake, and a close of their own or null) with close, result, pnl and clv.

    ``closes`` has game, market and the close that fills a missing one. Bets without a final score or a close stay
    ungraded. Spreads and totals push within half a point; a moneyline is paid at its own price and its clv is a difference of probabilities.
    """
    both = bets.join(games.select(key, "home_score", "away_score"), key, "left").join(closes.select(key, "market", F.col("close").alias("_filled")), [key, "market"], "left")
    both = both.withColumn("close", F.coalesce("close", "_filled"))
    margin, points = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    own = F.when(F.col("side") == "home", margin).otherwise(-margin)
    result = F.when(F.col("market") == "spread", spread_result(own, "close", raw=True)).when(F.col("market") == "total", total_result(points, "close", F.col("side") == "over")).otherwise(moneyline_result(own))
    both = both.withColumn("result", F.when(F.col("close").isNotNull() & margin.isNotNull(), result))
    at_price = F.when(F.col("market") == "moneyline", F.col("model"))
    ahead = F.when(F.col("side").isin("home", "over"), F.col("model") - F.col("close")).otherwise(F.col("close") - F.col("model"))
    clv = F.when(F.col("market") == "moneyline", american_to_probability("model") - american_to_probability("close")).otherwise(ahead)
    known = F.col("result").isNotNull()
    return both.withColumns({"pnl": F.when(known, profit(F.col("result"), "stake", at_price)), "clv": F.when(known, clv)}).drop("_filled", "home_score", "away_score")


def card(bets: DataFrame, lines: DataFrame, key: str = "game") -> DataFrame:
    """Bets with the current best line of their game and market, closing-line value and edge against that line."""
    both = bets.join(lines.select(key, "market", "current", "current_book"), [key, "market"], "left")
    plain = F.when(F.col("market") == "moneyline", american_to_probability("model") - american_to_probability("close")).otherwise(F.col("model") - F.col("close"))
    clv = F.coalesce(F.when(F.col("current").isNotNull(), plain), F.col("clv")) if "clv" in bets.columns else F.when(F.col("current").isNotNull(), plain)
    return both.withColumns({"clv": clv, "edge_now": F.col("model") - F.col("current")})


def card_summary(bets: DataFrame) -> DataFrame:
    """One row: bets, pending, graded, stake, pnl, wins, losses, pushes and hit rate (0 where nothing is graded)."""
    n = lambda c: F.count(F.when(c, 1))
    done = F.col("result").isNotNull()
    return bets.agg(
        F.count("*").alias("total"), n(~done).alias("pending"), n(done).alias("graded"), F.sum("stake").alias("stake"), F.sum(F.when(done, F.coalesce("pnl", F.lit(0.0))).otherwise(0.0)).alias("pnl"),
        n(F.col("result") == "win").alias("wins"), n(F.col("result") == "loss").alias("losses"), n(F.col("result") == "push").alias("pushes"),
        F.coalesce(F.when(n(done) > 0, n(F.col("result") == "win") / n(done)), F.lit(0.0)).alias("hit_rate"),
    )


def blended_difference(home_own: Column, away_own: Column, home_fit: Column, away_fit: Column, weight: float, own_deviation: float, fit_deviation: float) -> Column:
    """Difference of two ratings of both sides: each on its own scale's deviation, weighted, on the first's scale; the first's alone where the other is unknown."""
    own = home_own - away_own
    return F.coalesce((weight * own / own_deviation + (1 - weight) * (home_fit - away_fit) / fit_deviation) * own_deviation, own)


def core_spread(difference: Column, hfa: Column, intercept: float, slope: float, home: float) -> Column:
    return intercept + slope * difference + home * hfa


def seed_lines(games: DataFrame, ratings: DataFrame, markets: DataFrame, hfa: float = 2.0, steps: tuple[float, float] = (4.0, 3.0)) -> DataFrame:
    """Implied spread and total from seed ratings and paces; unknown teams are 0, an unknown market is 0 and 45; confidence by the larger edge."""
    side = lambda s: ratings.select(F.col("team").alias(s), F.col("rating").alias(f"{s}_rating"), F.col("pace").alias(f"{s}_pace"))
    both = games.join(side("home"), "home", "left").join(side("away"), "away", "left").join(markets, "game", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.withColumns({
        "implied_spread": zero("home_rating") - zero("away_rating") + F.when(F.col("neutral"), 0.0).otherwise(hfa),
        "implied_total": 45 + 2 * (zero("home_pace") + zero("away_pace")),
        "market_spread": zero("market_spread"), "market_total": F.coalesce("market_total", F.lit(45.0)),
    })
    edge = F.greatest(F.abs(F.col("implied_spread") - F.col("market_spread")), F.abs(F.col("implied_total") - F.col("market_total")))
    return both.withColumn("confidence", F.when(edge >= steps[0], "A").when(edge >= steps[1], "B").otherwise("C"))


def graded_market(edge: Column, a: float = 4.0, b: float = 3.0, c: float = 0.1) -> Column:
    """The grade of one market's edge, 3 for A, 2 for B, 1 for C, else null."""
    return F.when(edge >= a, 3).when(edge >= b, 2).when(edge >= c, 1)


def built(games: DataFrame, ratings: DataFrame, lines: DataFrame, conflicts: DataFrame | None = None, base_hfa: float = 2.0, base_total: float = 45.0, on: str = "game") -> DataFrame:
    """The slate: a row to a game with ratings, implied lines, edges, picks, moneyline, confidence and the bucket of its conflict.

    ``lines`` has market_spread (home side's handicap turned to home minus away), market_total, home_price and, if there is one, away_price, one row to each value of ``on``; ``conflicts`` the conflict of
    a hybrid bet, one row to a game, or ``games`` has it. A game that is listed more than once is a row each time. A game whose team or line is unknown stays, with nulls. A market's grade is A from 4 points, B from 3 and C from .1; a moneyline's, of the side of more
    than one per cent of value at spreads up to 24, A from 10, B from 5 and C from 1. Confidence is the best of the three, ``max_edge`` the largest edge or value.
    """
    side = lambda s: ratings.select(F.col("team").alias(s), F.col("rating").alias(f"{s}_rating"))
    g = games.join(side("home"), "home", "left").join(side("away"), "away", "left").join(lines, on, "left")
    g = g if conflicts is None else g.join(conflicts.select("game", "conflict"), "game", "left")
    spread = F.col("home_rating") - F.col("away_rating") + home_field(F.coalesce("neutral", F.lit(False)), base_hfa)
    g = g.withColumns({"implied_hma": spread, "implied_total": base_total + 0.5 * F.abs(F.col("home_rating") - F.col("away_rating"))})
    g = g.withColumns({"spread_edge": F.col("implied_hma") - F.col("market_spread"), "total_edge": F.col("implied_total") - F.col("market_total")})
    g = g.withColumns({"spread_pick": F.when(F.col("spread_edge") >= 0.1, "home").when(F.col("spread_edge") <= -0.1, "away"), "total_pick": F.when(F.col("total_edge") >= 2.5, "over").when(F.col("total_edge") <= -2.5, "under")})
    chance = win_probability("implied_hma")
    value = moneyline_value(chance, "home_price")
    other = moneyline_value(1 - chance, "away_price") if "away_price" in lines.columns else F.lit(None).cast("double")
    g = g.withColumns({"home_value": value, "withheld": moneyline_gate("implied_hma", "market_spread", value), "bucket": conflict_bucket(F.col("conflict"), "spread_edge"), "_away": other})
    g = g.withColumn("moneyline_side", F.when(F.abs("implied_hma") <= 24, moneyline_side("home_value", "_away")))
    g = g.withColumn("moneyline_value", F.when(F.col("moneyline_side") == "home", F.col("home_value")).when(F.col("moneyline_side") == "away", F.col("_away"))).drop("_away")
    best = F.greatest(graded_market(F.abs("spread_edge")), graded_market(F.abs("total_edge")), graded_market(F.col("moneyline_value"), 10.0, 5.0, 1.0))
    return g.withColumns({"max_edge": F.greatest(F.abs("spread_edge"), F.abs("total_edge"), "moneyline_value"), "confidence": F.element_at(F.array(*map(F.lit, "CBA")), best)})


def asserted(rows: DataFrame) -> DataFrame:
    """How many games break each rule of a response: signs of both lines, the edge's identity, the model's favourite."""
    fav, dog, edge, line = (F.col(c) for c in ("favourite_line", "dog_line", "edge", "model_line"))
    checks = {
        "line_signs": (fav.isNull() & dog.isNull()) | (fav.isNotNull() & dog.isNotNull() & (fav < 0) & (dog > 0)),
        "edge_identity": edge.isNull() | fav.isNull() | (F.abs(edge - (line - fav)) < 1e-6),
        "model_favourite": F.when(F.col("model_favourite").isNull(), line == 0).otherwise(F.col("model_favourite") == F.col("converted_favourite")),
    }
    counts = [F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in checks.items()]
    return rows.agg(*counts).unpivot([], list(checks), "assertion", "failures")


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of a total order: Spark takes each partition's first rows only."""
    return df.orderBy(*order).offset(offset).limit(size)


def outliers(df: DataFrame, residual: str, tie: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.abs(F.col(residual)).desc(), tie).limit(n)


def search(games: DataFrame, text: str, names: tuple[str, str] = ("away", "home"), key: str = "game", n: int = 8) -> DataFrame:
    """The best matches of a text: 100 for a name that is the text, 50 for one that holds it, 200 for both sides of ``a @ b`` or ``a vs b``."""
    q = text.strip().lower()
    low = [F.lower(F.col(c)) for c in names]
    score = sum(F.when(c == q, 100).otherwise(0) for c in low) + F.when(low[0].contains(q) | low[1].contains(q), 50).otherwise(0)
    for mark in ("@", " vs ", " v "):
        a, found, b = (p.strip() for p in q.partition(mark))
        if found or mark.strip() in q and a and b:
            score = score + F.when((low[0].contains(a) & low[1].contains(b)) | (low[0].contains(b) & low[1].contains(a)), 200).otherwise(0)
            break
    return games.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(n)


def by_date(games: DataFrame, order: str = "edge", zone: str = "UTC") -> DataFrame:
    """Games of each local date in order: ``edge`` (largest first, unknown last), ``confidence`` (A first) or ``time``; a date's first place in that order is its own."""
    rank = F.when(F.col("confidence") == "A", 3).when(F.col("confidence") == "B", 2).when(F.col("confidence") == "C", 1).otherwise(0)
    keys = {"edge": -F.coalesce(F.col("max_edge"), F.lit(float("-inf"))), "confidence": -rank, "time": F.unix_micros("date")}
    local = F.to_date(F.from_utc_timestamp("date", zone))
    rows = games.select(local.alias("day"), F.struct(keys[order].cast("double").alias("k"), "game").alias("g"))
    day = rows.groupBy("day").agg(F.sort_array(F.collect_list("g")).alias("g"))  # the games of one day
    return day.select("day", F.transform("g", lambda x: x["game"]).alias("games"), F.size("g").alias("n"))


def span(quotes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First and last time of the quotes used."""
    return quotes.groupBy(*keys).agg(F.min(ts).alias("window_start"), F.max(ts).alias("window_end"))


def coefficients(names: list[str], values: list[float]) -> Column:
    """A coefficient map as JSON."""
    return F.to_json(F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(float(v))) for n, v in zip(names, values)])))


def contiguous_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """``fold`` of each row: rows in order, cut into k runs of floor(n / k), the last with the rest."""
    total = df.agg(F.count("*").alias("_n"))
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return ordinal(df, [], order, "_r").crossJoin(F.broadcast(total)).withColumn("fold", F.least(F.lit(k - 1), F.floor((F.col("_r") - 1) / size)).cast("int")).drop("_r", "_n")
