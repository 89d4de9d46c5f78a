"""Training rows from team rows and closing quotes, their feature matrix, and the diagnostics that are run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.numbers import clamp, ratio
from rookery.operators.asof import in_window
from rookery.operators.aggregates import nearest_rank
from rookery.operators import graphs
from rookery.operators.ratings import adjusted_nets, team_games
from rookery.operators.windows import EWMA_3, EWMA_5, ewma, ordinal, rank_correlation, rest, standardised
from rookery.sources.shared import stored

#: What a row of each set weighs.
SET_WEIGHTS = {"A": 1.0, "B": 0.6, "other": 0.25}


def targets(kicks: DataFrame, quotes: DataFrame, key: str = "game", before: int = 60, after: int = 5) -> DataFrame:
    """Of each game (key, kick): ``target`` (home minus away, so the median line of the books turned round), ``books``, ``window_start`` and ``window_end``.

    Of each book the latest quote in the window counts, of equal times the greatest quote_id; a null line is no vote but its book counts.
    Games without a quote in the window are left out.
    """
    near = in_window(kicks.select(key, "kick"), quotes.select(key, "book", "ts", "quote_id", "line"), key, "kick", "ts", before, after)
    book = near.groupBy(key, "book").agg(F.max_by("line", F.struct("ts", "quote_id")).alias("line"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return book.groupBy(key).agg((-F.median("line")).alias("target"), F.count("*").alias("books"), F.min("first").alias("window_start"), F.max("last").alias("window_end"))


def training_rows(rows: DataFrame, found: DataFrame, columns: tuple[str, ...], label: str = "A", key: str = "game") -> DataFrame:
    """Training rows of set ``label`` from two team rows to a game (is_home, tier of P5, G5 or other, rest, bye) and ``targets``.

    ``diff_<column>`` is home minus away and null where one is; a missing rest counts 0. Set A needs a target, the others keep games without one.
    Games with one row only go.
    """
    home, away = (lambda x, at=at: F.max(F.when(F.col("is_home") == at, x)) for at in (True, False))
    level = F.when(F.col("tier") == "P5", 2).when(F.col("tier") == "G5", 1).otherwise(0)
    rest = F.coalesce(F.col("rest").cast("double"), F.lit(0.0))
    pairs = rows.groupBy(key).agg(
        F.count_if("is_home").alias("_home"), F.count_if(~F.col("is_home")).alias("_away"), *[(home(F.col(c)) - away(F.col(c))).alias(f"diff_{c}") for c in columns],
        (home(level) - away(level)).alias("tier_gap"), (home(level) + away(level) == 3).alias("p5_vs_g5"), (home(rest) - away(rest)).alias("rest_diff"), home(F.col("bye")).alias("bye_home"), away(F.col("bye")).alias("bye_away"),
    )
    out = pairs.where("_home > 0 and _away > 0").drop("_home", "_away").join(found, key, "left").withColumn("pre_kick", F.col("books").isNotNull())
    out = out.withColumns({"set_label": F.lit(label), "row_weight": F.lit(SET_WEIGHTS.get(label, SET_WEIGHTS["other"]))})
    return out.where(F.col("target").isNotNull()) if label == "A" else out


def engineered(rows: DataFrame, keys: list[str], columns: tuple[str, ...], prior: str = "talent") -> DataFrame:
    """Team rows of games (game, team, opponent, date, and both sides of each net) with adjusted nets, averages of recent games, rest and cleaned ``columns``.

    ``ewma3_off``, ``ewma3_def``, ``ewma5_off`` and ``ewma5_def`` average the adjusted epa of the team's last games before this one in ``keys``;
    the prior (a null is 0) fills what is missing of 3 or 5 games, in ``ewma3_def`` of 5 too. ``low_3`` and ``low_5`` mark rows with fewer games.
    """
    team, order = ["team", *keys], ["date", "game"]
    nets = adjusted_nets(rows).withColumns({"_played": F.row_number().over(Window.partitionBy(*team).orderBy(*order)) - 1, "_prior": F.coalesce(F.col(prior).cast("double"), F.lit(0.0))})
    missing = lambda n: F.greatest(F.lit(0.0), 1 - F.col("_played") / n)
    means = {f"ewma{n}_{s}": ewma(f"{s}_adj_epa", team, order, w, "_prior", missing(of)) for n, s, w, of in ((3, "off", EWMA_3, 3), (3, "def", EWMA_3, 5), (5, "off", EWMA_5, 5), (5, "def", EWMA_5, 5))}
    found = rest(nets.withColumns(means | {"low_3": F.col("_played") < 3, "low_5": F.col("_played") < 5}), team, "date", "game")
    return cleaned(found.drop("_played", "_prior"), keys, columns)


def cleaned(df: DataFrame, keys: list[str], columns: tuple[str, ...], share: float = 0.01) -> DataFrame:
    """Each column clipped to its nearest-rank percentiles in ``keys`` and standardised by the moments before that; ``n_clipped`` counts a row's clipped columns.

    Without spread (a deviation up to 1e-4) a column is null; values that are no finite numbers stay as they are. All columns' statistics come from one long table.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.name", "p.x").where(finite(F.col("x")))
    by = [*keys, "name"]
    stats = nearest_rank(long, by, "x", {"lo": share, "hi": 1 - share}).join(long.groupBy(*by).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")), by)
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.struct("lo", "hi", "m", "s"))).alias(f"_{c}") for c in columns])
    both = df.join(wide, keys, "left") if keys else df.crossJoin(F.broadcast(wide))  # without keys one row
    at = lambda c: (F.col(c).cast("double"), F.col(f"_{c}"))
    clipped, out = F.lit(0), {}
    for c in columns:
        x, t = at(c)
        known = finite(x) & t.isNotNull()
        clipped = clipped + F.when(known & ((x < t["lo"]) | (x > t["hi"])), 1).otherwise(0)
        out[c] = F.when(~known | t.isNull(), x).when(t["s"] > 1e-4, (F.greatest(t["lo"], F.least(t["hi"], x)) - t["m"]) / t["s"])
    return both.withColumn("n_clipped", clipped).withColumns(out).drop(*[f"_{c}" for c in columns])


def null_gates(df: DataFrame, columns: tuple[str, ...], most: float = 0.15) -> DataFrame:
    """``name``, ``null_share``, ``deviation`` and ``passed`` of each column: nulls and NaNs under ``most`` and some spread. One row to a column, from one aggregate."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(1 - ratio(F.count(known(c)), F.count("*")), F.lit(0.0)).alias("null_share"), F.stddev_pop(known(c)).alias("deviation")) for c in columns]).alias("g"))
    rows = one.select(F.explode("g").alias("g")).select("g.*")
    return rows.withColumn("passed", (F.col("null_share") < most) & F.coalesce(F.col("deviation") > 1e-4, F.lit(False)))


def feature_matrix(rows: DataFrame, numbers: list[str], flags: list[str], squares: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with ``x_<name>`` of every feature, ready to fit: nulls are 0, flags 0 or 1 and never scaled, numbers standardised by population moments.

    ``squares`` adds ``<name>_sq``, the square over a divisor, standardised too; a feature without spread is 0.
    """
    filled = rows.withColumns({f"_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numbers})
    filled = filled.withColumns({f"_{n}_sq": F.col(f"_{n}") * F.col(f"_{n}") / by for n, by in (squares or {}).items()})
    scaled = [*numbers, *(f"{n}_sq" for n in squares or {})]
    out = standardised(filled, [], *[f"_{n}" for n in scaled])
    out = out.withColumns({f"x_{n}": F.coalesce(f"z__{n}", F.lit(0.0)) for n in scaled} | {f"x_{n}": F.when(F.col(n), 1.0).otherwise(0.0) for n in flags})
    return out.drop(*[f"_{n}" for n in scaled], *[f"z__{n}" for n in scaled])


def home_edges(residuals: DataFrame, base: float = 2.0, prior_games: float = 20.0, lo: float = 0.5, hi: float = 3.5) -> DataFrame:
    """Each team's home edge beyond ``base`` from residuals at home, shrunk to nothing by ``prior_games`` and clipped so that base and edge lie within lo and hi."""
    teams = residuals.groupBy("team").agg(F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"), F.stddev_pop("residual").alias("deviation"))
    edge = clamp(F.col("mean_residual") * F.col("n") / (F.col("n") + prior_games), lo - base, hi - base)
    return teams.where("n > 0").withColumn("edge", edge).withColumn("hfa", base + F.col("edge"))


def blend_by_sets(rows: DataFrame, a: str, b: str, target: str, label: str, tie: str, weights: list[float], guard: tuple[float, float] = (0.1, 0.25)) -> DataFrame:
    """Weights w of w * a + (1 - w) * b by what they reach in sets A and B: Pearson and ordinal Spearman correlation, their mean as ``objective``, and ``chosen``.

    The best objective whose Pearson in B is not negative wins, of equal ones the smallest weight. If that is weight 0 with a Pearson in B
    under ``guard[1]``, weight ``guard[0]`` is taken if it reaches that. Ranks of equal values go by ``tie``.
    """
    known = rows.where(F.col(target).isNotNull()).select(F.col(label).alias("_set"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.col(target).cast("double").alias("_y"), F.col(tie).alias("_tie"))
    ranked, _ = stored(ordinal(known, ["_set"], ["_y", "_tie"], "_ry"), "blend-ranks")
    each = ranked.select("*", F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w")).withColumn("_x", F.col("w") * F.col("_a") + (1 - F.col("w")) * F.col("_b"))
    reached = each.groupBy("w", "_set").agg(F.corr("_x", "_y").alias("p")).join(rank_correlation(each, ["_set", "w"], ["_x", "_tie"], "_ry", "s"), ["w", "_set"], "left")
    reached, _ = stored(reached, "blend-sets")  # a row to a weight and set, read for all weights and for the best of them
    of = lambda x, s: F.coalesce(F.max(F.when(F.col("_set") == s, F.col(x))), F.lit(0.0))
    sets = reached.groupBy("w").agg(of("p", "A").alias("pearson_a"), of("s", "A").alias("spearman_a"), of("p", "B").alias("pearson_b"), of("s", "B").alias("spearman_b"))
    sets = sets.withColumn("objective", 0.5 * (F.col("pearson_a") + F.col("spearman_a")) + 0.5 * (F.col("pearson_b") + F.col("spearman_b")))
    valid = F.col("pearson_b") >= 0
    best = sets.agg(F.min_by(F.struct("w", "pearson_b"), F.when(valid, F.struct(-F.col("objective"), F.col("w")))).alias("top"), F.bool_or((F.abs(F.col("w") - guard[0]) < 1e-9) & (F.col("pearson_b") >= guard[1])).alias("fits"))
    pick = F.when((F.col("top.w") == 0) & (F.col("top.pearson_b") < guard[1]) & F.col("fits"), F.lit(guard[0])).otherwise(F.col("top.w"))
    # one row against as many as there are weights
    return sets.crossJoin(best.select(pick.alias("_pick"))).withColumn("chosen", F.coalesce(F.abs(F.col("w") - F.col("_pick")) < 1e-9, F.lit(False))).drop("_pick")


def variance_probe(rows: DataFrame, keys: list[str], x: str, hfa: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares of y on a rating difference and home-field points: both slopes, ``variance_ratio`` of predictions to y, and whether the slopes are positive.

    Without spread in the points (a deviation up to 1e-6) only the difference is fitted and the points' slope is 0. Everything comes from one aggregate.
    """
    w, a, b, t = F.col(weight), F.col(x).cast("double"), F.coalesce(F.col(hfa).cast("double"), F.lit(0.0)), F.col(y).cast("double")
    n = F.sum(w)
    weighted = lambda p, q: F.sum(w * p * q) / n - F.sum(w * p) / n * F.sum(w * q) / n
    m = rows.where(a.isNotNull() & t.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), weighted(a, a).alias("_aa"), weighted(b, b).alias("_bb"), weighted(a, b).alias("_ab"), weighted(a, t).alias("_at"), weighted(b, t).alias("_bt"),
        F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb"), F.covar_pop(a, b).alias("_cab"), F.stddev_pop(t).alias("deviation"),
    )
    both = F.sqrt("_vb") > 1e-6
    apart = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    slope = F.when(both, ratio(F.col("_at") * F.col("_bb") - F.col("_bt") * F.col("_ab"), apart)).otherwise(ratio("_at", "_aa"))
    m = m.withColumns({"slope": slope, "hfa_slope": F.when(both, ratio(F.col("_bt") * F.col("_aa") - F.col("_at") * F.col("_ab"), apart)).otherwise(0.0)})
    s, h = F.col("slope"), F.col("hfa_slope")
    predicted = F.sqrt(F.greatest(F.lit(0.0), s * s * F.col("_va") + h * h * F.col("_vb") + 2 * s * h * F.col("_cab")))
    return m.withColumns({"variance_ratio": ratio(predicted, "deviation"), "signs_ok": (s > 0) & (~both | (h > 0))}).drop(*[c for c in m.columns if c.startswith("_")])


def score_errors(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Of each rated team: rating, mean points for and against, and ``sigma``, the root mean square of margins less differences of ratings (0 without a rated opponent)."""
    t = team_games(games.where("home_score is not null and away_score is not null"))
    own, other = ratings.select("team", "rating"), ratings.select(F.col("team").alias("opponent"), F.col("rating").alias("theirs"))
    error = F.col("margin") - (F.col("rating") - F.col("theirs"))
    both = t.join(own, "team").join(other, "opponent", "left")
    return both.groupBy("team", "rating").agg(F.avg("pf").alias("offense"), F.avg("pa").alias("defense"), F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("sigma"))


def strategy_summary(bets: DataFrame, keys: list[str], least: float = 3.0) -> DataFrame:
    """Graded bets of each strategy, in counts, win rate and return (per cent), with ``tier_a_bets`` and ``tier_a_roi`` of those whose model is ``least`` or more off the close.

    A bet without a close, or with a close of 0, is in no tier; a strategy without graded bets has no row.
    """
    graded = bets.where(F.col("result").isin("win", "loss", "push"))
    top = F.coalesce((F.col("close") != 0) & (F.abs(F.col("model") - F.col("close")) >= least), F.lit(False))
    count = lambda r: F.count_if(F.col("result") == r)
    total = lambda c, cond=None: F.sum(F.when(cond, F.coalesce(c, F.lit(0.0))) if cond is not None else F.coalesce(c, F.lit(0.0)))
    return graded.groupBy(*keys).agg(
        F.count("*").alias("bets"), count("win").alias("wins"), count("loss").alias("losses"), count("push").alias("pushes"), (ratio(count("win"), count("win") + count("loss")) * 100).alias("win_rate"),
        total("stake").alias("total_stake"), total("pnl").alias("total_pnl"), F.coalesce(ratio(total("pnl"), total("stake")) * 100, F.lit(0.0)).alias("roi"),
        F.count_if(top).alias("tier_a_bets"), (ratio(total("pnl", top), total("stake", top)) * 100).alias("tier_a_roi"),
    )


def off_market(games: DataFrame, outputs: DataFrame, implied: str, market: Column, key: str = "game", least: float = 2.0) -> DataFrame:
    """Games for which some model's output is ``least`` or more off the market."""
    near = outputs.join(games.select(key, market.alias("_market")), key).where(F.abs(F.col(implied) - F.col("_market")) >= least)
    return games.join(near.select(key).distinct(), key, "left_semi")


def matched_game(left: DataFrame, games: DataFrame, on: list[str], at: str, date: str, left_id: str, value: str, days: float = 2.0, alone: float = 8.0, unsettled: float = 14.0, moving: Column | None = None) -> DataFrame:
    """The earliest game within ``days`` days, else the only one of its teams and season if it is within ``alone`` days (``unsettled`` where ``moving`` holds); ``how`` tells which."""
    apart = F.abs(F.unix_micros(at) - F.unix_micros(date)) / F.lit(86_400_000_000.0)
    near = apart <= days
    met = left.join(games.select(*on, date, value), on)
    found = met.groupBy(left_id).agg(F.min(F.when(near, F.struct(date, value))).alias("_near"), F.count("*").alias("_n"), F.min(value).alias("_only"), F.min(apart).alias("_apart"))
    far = F.when(moving, unsettled).otherwise(alone) if moving is not None else F.lit(alone)
    out = left.join(found, left_id, "left")
    only = F.when((F.col("_n") == 1) & (F.col("_apart") <= far), F.col("_only"))
    how = F.when(F.col("_near").isNotNull(), "window").when(only.isNotNull(), "season")
    return out.withColumns({value: F.coalesce(F.col("_near")[value], only), "how": how}).drop("_near", "_n", "_only", "_apart")


def market_fit(games: DataFrame, prior: DataFrame, ridge: float = 0.1, most: float = 35.0, least_games: int = 50) -> tuple[DataFrame, float]:
    """Ratings (team, rating) that fit market targets of games (home, away, target, row_weight) with one home-field constant, drawn to a standardised ``prior`` (team, prior), and that constant.

    Targets over ``most`` are left out, and fewer than ``least_games`` others are an error; teams without a prior have 0 before it is standardised. The
    constant is eliminated: one solve fits the targets, one the games at home, and both over tables, so any number of teams will do.
    """
    kept = games.where((F.abs("target") <= most) & F.col("row_weight").isNotNull())
    links = graphs.edges(kept, F.col("target"), F.col("row_weight"))
    every = links.agg(F.sum("n").alias("n")).first().n or 0
    if every // 2 < least_games:
        raise ValueError(f"fewer than {least_games} games")
    known = prior.groupBy("team").agg(F.first("prior", True).cast("double").alias("p"))
    teams = graphs.nodes(links).join(known, "team", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    spread = teams.agg(F.avg("p").alias("_m"), F.stddev_pop("p").alias("_s"))
    teams = teams.crossJoin(F.broadcast(spread)).withColumn("b", F.col("b") + ridge * F.when(F.col("_s") > 1e-10, (F.col("p") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("p", "_m", "_s")  # one row
    found = graphs.solve(links, teams, ridge, "b", "c")
    s = found.agg(F.sum(F.col("c") * F.col("x_b")).alias("cb"), F.sum(F.col("c") * F.col("x_c")).alias("cc")).first()
    whole = kept.agg(F.sum("row_weight").alias("w"), F.sum(F.col("row_weight") * F.col("target")).alias("b")).first()
    hfa = (whole.b - s.cb) / (whole.w - s.cc)
    return graphs.centred(found, F.col("x_b") - F.lit(float(hfa)) * F.col("x_c")), float(hfa)
