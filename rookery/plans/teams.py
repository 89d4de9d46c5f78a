"""Queries on teams: records, ordered features, ratings, pairings, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import aggregates, linear, ratings, windows
from rookery.plans.registry import games, query, rounded, st

TG = """tg as (select game, date, season, home as team, away as opponent, home_score as pf, away_score as pa, true as is_home, home_score - away_score as margin from games
  union all select game, date, season, away, home, away_score, home_score, false, away_score - home_score from games )"""
#: Team weeks: the mean points for and against of a team in a month, which stands for a week.
TW = f"{TG}, tw as (select team, season, cast(month(date) as integer) as week, {st('avg(pf)')} as pf, {st('avg(pa)')} as pa from tg group by 1, 2, 3)"
TS = f"{TG}, ts as (select team, season, {st('avg(pf)')} as pf, {st('avg(pa)')} as pa, count(*) as n from tg group by 1, 2)"


def _sides(spark, d):
    return ratings.team_games(games(spark, d))


def _weeks(spark, d):
    found = _sides(spark, d).groupBy("team", "season", F.month("date").alias("week")).agg(F.avg("pf").alias("pf"), F.avg("pa").alias("pa"))
    return rounded(found, "pf", "pa")


def _seasons(spark, d):
    return rounded(_sides(spark, d).groupBy("team", "season").agg(F.avg("pf").alias("pf"), F.avg("pa").alias("pa"), F.count("*").alias("n")), "pf", "pa")


def z(x: str, by: str = "season") -> str:
    """The SQL of a z-score over a season."""
    return f"({x} - avg({x}) over (partition by {by})) / (case when stddev_pop({x}) over (partition by {by}) = 0 then 1 else stddev_pop({x}) over (partition by {by}) end)"


@query(f"with {TG} select game, team, opponent, pf, pa, is_home, margin from tg")
def unpivoted_games(spark, d):
    return _sides(spark, d).select("game", "team", "opponent", "pf", "pa", "is_home", "margin")


@query(f"with {TG} select team, count(*) as games, count(*) filter (where margin > 0) as wins, count(*) filter (where margin < 0) as losses, cast(sum(pf) as bigint) as pf, cast(sum(pa) as bigint) as pa, {st('avg(margin)')} as mean_margin from tg group by 1")
def team_records(spark, d):
    return rounded(ratings.records(games(spark, d)), "mean_margin")


@query("select game, home, away from games where home % 3 <> 0 and away % 3 <> 0")
def member_games(spark, d):
    members = spark.range(40).where("id % 3 <> 0").withColumnRenamed("id", "team")
    return ratings.members_only(games(spark, d), members).select("game", "home", "away")


@query(f"with {TW} select team, season, week, {st('avg(pf) over (partition by team, season order by week range between unbounded preceding and 1 preceding)')} as prior from tw")
def prior_mean(spark, d):
    return rounded(_weeks(spark, d).withColumn("prior", windows.prior_mean("pf", ["team", "season"], "week")), "prior").select("team", "season", "week", "prior")


def _ewma(weights: tuple[float, ...], prior: float, prior_weight: float) -> str:
    terms = [f"lag(pf, {i + 1}) over (partition by team, season order by week)" for i in range(len(weights))]
    top = " + ".join([*(f"coalesce({t} * {w}, 0)" for t, w in zip(terms, weights)), str(prior * prior_weight)])
    bottom = " + ".join([*(f"case when {t} is not null then {w} else 0 end" for t, w in zip(terms, weights)), str(prior_weight)])
    return st(f"({top}) / ({bottom})")


@query(f"with {TW} select team, season, week, {_ewma(windows.EWMA_3, 20.0, 0.2)} as ewma3, {_ewma(windows.EWMA_5, 20.0, 0.2)} as ewma5 from tw")
def ewma_features(spark, d):
    w = _weeks(spark, d)
    short, long = (windows.ewma("pf", ["team", "season"], ["week"], k, F.lit(20.0), 0.2) for k in (windows.EWMA_3, windows.EWMA_5))
    return rounded(w.select("team", "season", "week", short.alias("ewma3"), long.alias("ewma5")), "ewma3", "ewma5")


@query(f"with {TG}, r as (select game, team, cast(date_diff('day', lag(date) over (partition by team order by date, game)::date, date::date) as bigint) as rest_days from tg) select game, team, rest_days, coalesce(rest_days > 10, false) as bye from r")
def rest_days(spark, d):
    g = _sides(spark, d).withColumn("date", F.to_date("date").cast("timestamp"))
    return windows.rest(g, ["team"], "date", "game").select("game", "team", "rest_days", "bye")


@query(f"with {TG}, r as (select *, row_number() over (partition by team, season order by date desc, game desc) as k from tg) select team, season, {st('sum(pf * case when k <= 3 then 1.5 else 1 end) / sum(case when k <= 3 then 1.5 else 1 end)')} as recency_mean, count(*) as n from r group by 1, 2")
def recency_weighted(spark, d):
    return rounded(windows.recency_mean(_sides(spark, d), ["team", "season"], [F.desc("date"), F.desc("game")], "pf"), "recency_mean")


@query(f"with {TG}, r as (select *, row_number() over (partition by team, season order by date desc, game desc) as k from tg) select team, season, {st('avg(pf)')} as mean, count(pf) as n from r where k <= 10 group by 1, 2")
def last_ten_mean(spark, d):
    return rounded(windows.last_n_mean(_sides(spark, d), ["team", "season"], [F.desc("date"), F.desc("game")], "pf"), "mean")


@query(f"with {TS} select team, season, {st(z('pf'))} as z_pf, {st(z('pa'))} as z_pa from ts")
def zscores(spark, d):
    return rounded(windows.standardised(_seasons(spark, d), ["season"], "pf", "pa"), "z_pf", "z_pa").select("team", "season", "z_pf", "z_pa")


@query(f"""with {TW}, e as (select season, list_sort(list(pf))[least(cast(floor(count(*) * 0.01) as bigint) + 1, count(*))] as lo, list_sort(list(pf))[least(cast(floor(count(*) * 0.99) as bigint) + 1, count(*))] as hi, avg(pf) as m, stddev_pop(pf) as s from tw group by 1)
  select team, season, week, greatest(lo, least(hi, pf)) as clipped, {st('case when s > 1e-4 then (greatest(lo, least(hi, pf)) - m) / s end')} as z from tw join e using (season)""")
def winsorised(spark, d):
    return rounded(windows.winsorised(_weeks(spark, d), ["season"], "pf"), "z").select("team", "season", "week", "clipped", "z")


@query(f"with {TS}, r as (select season, pf, pa, row_number() over (partition by season order by pf, team) as a, row_number() over (partition by season order by pa, team) as b from ts) select season, {st('corr(a, b)')} as spearman, {st('corr(pf, pa)')} as pearson, count(*) as n from r group by 1")
def rank_correlation(spark, d):
    return rounded(windows.spearman(_seasons(spark, d), ["season"], "pf", "pa", "team"), "spearman", "pearson")


WEIGHTS = {"pf": 0.6, "pa": -0.4}


@query(f"with {TS} select team, season, {st(f'(({z(chr(112) + chr(102))}) * 0.6 + ({z(chr(112) + chr(97))}) * -0.4) * 8')} as rating from ts")
def index_rating(spark, d):
    return rounded(ratings.index_rating(_seasons(spark, d), WEIGHTS, ["season"]), "rating").select("team", "season", "rating")


PARTS = {"success": "avg({})", "explosive": "max({})", "finish": "avg({} * {}) / 100", "available": "min({})"}
SIDES = ", ".join(f"{st(sql.replace('{}', c))} as {s}_{p}" for s, c in (("off", "pf"), ("def", "pa")) for p, sql in PARTS.items())
NET = " + ".join(f"({z(f'off_{p}')}) * {w} - ({z(f'def_{p}')}) * {w}" for p, w in {"success": 0.5, "explosive": 0.25, "finish": 0.15, "available": 0.1}.items())


@query(f"with {TG}, u as (select team, season, {SIDES} from tg group by 1, 2), n as (select team, season, {NET} as net from u) select team, season, {st('(net - avg(net) over (partition by season)) * 10')} as rating from n")
def v4_rating(spark, d):
    parts = {}
    for s, c in (("off", "pf"), ("def", "pa")):
        x = F.col(c)
        parts |= {f"{s}_success": F.avg(x), f"{s}_explosive": F.max(x), f"{s}_finish": F.avg(x * x) / 100, f"{s}_available": F.min(x)}
    stats = rounded(_sides(spark, d).groupBy("team", "season").agg(*[v.alias(k) for k, v in parts.items()]), *parts)
    return rounded(ratings.v4_rating(stats, ["season"]), "rating").select("team", "season", "rating")


@query(f"with {TS} select team, season, {st(f'(({z(chr(112) + chr(102))}) + ({z(chr(112) + chr(97))})) / 2 * 14')} as rating from ts")
def balanced_rating(spark, d):
    return rounded(ratings.balanced_rating(_seasons(spark, d), ["season"], ("pf", "pa")), "rating").select("team", "season", "rating")


@query()
def strength_adjusted(spark, d):
    """No oracle: passes that stop by a tolerance."""
    start = ratings.records(games(spark, d)).select("team", F.col("mean_margin").alias("rating"), F.lit(0.8).alias("confidence"), "games")
    return rounded(ratings.strength_passes(start, games(spark, d)), "adjusted", "rating")


@query(f"""with t as (select home as team, avg(home_score - away_score) as raw, count(*) as n from games where abs(home_score - away_score) <= 20 group by 1),
  l as (select greatest(1.0, least(4.0, median(raw))) as league from t), w as (select t.*, league, case when n < 4 then least(n / (n + 8.0), 0.4) else n / (n + 8.0) end as w from t, l)
  select team, n, {st('raw')} as raw, {st('greatest(0.5, least(5.0, w * raw + (1 - w) * league))')} as hfa from w""")
def home_advantage(spark, d):
    residuals = games(spark, d).select(F.col("home").alias("team"), (F.col("home_score") - F.col("away_score")).alias("residual"))
    return rounded(ratings.team_hfa(residuals), "raw", "hfa").select("team", "n", "raw", "hfa")


@query("select game, home_score - away_score as diff_pf, away_score - home_score as diff_pa from games ")
def training_pairs(spark, d):
    return ratings.training_pairs(_sides(spark, d), ("pf", "pa"))


@query(f"""with {TG}, r as (select team, {st('avg(margin)')} as rating from tg group by 1), m as (select game, h.rating - a.rating + 2 as implied_hma, 45 + 0.5 * abs(h.rating - a.rating) as implied_total, home_score - away_score as spread, home_score + away_score as total from games join r h on h.team = home join r a on a.team = away)
  select game, {st('implied_hma')} as implied_hma, {st('implied_total')} as implied_total, {st('implied_hma - spread')} as spread_edge, case when abs(implied_hma - spread) >= 4 then 'A' when abs(implied_hma - spread) >= 3 then 'B' when abs(implied_hma - spread) >= 2 then 'C' end as spread_tier, {st('greatest(abs(implied_hma - spread), abs(implied_total - total))')} as max_edge from m""")
def matchup_edges(spark, d):
    rating = rounded(ratings.records(games(spark, d)).select("team", F.col("mean_margin").alias("rating")), "rating")
    g = games(spark, d).withColumns({"neutral": F.lit(False), "spread": F.col("home_score") - F.col("away_score"), "total": F.col("home_score") + F.col("away_score")})
    out = ratings.with_edges(ratings.matchups(g, rating), "spread", "total")
    return rounded(out.select("game", "implied_hma", "implied_total", "spread_edge", "spread_tier", "max_edge"), "implied_hma", "implied_total", "spread_edge", "max_edge")


@query(f"with p as (select season, home_score as x, away_score as y, 1 + game % 3 as w from games ) select season, {st('sum(x * y) / sum(x * x)')} as origin, {st('regr_slope(y, x)', 6)} as slope, {st('regr_intercept(y, x)')} as intercept, {st('regr_r2(y, x)', 6)} as r2 from p group by 1")
def simple_regressions(spark, d):
    p = games(spark, d).select("season", F.col("home_score").cast("double").alias("x"), F.col("away_score").cast("double").alias("y"))
    out = p.groupBy("season").agg(linear.through_origin("x", "y").alias("origin"), *linear.simple("x", "y"))
    for name, places in (("origin", 4), ("slope", 6), ("intercept", 4), ("r2", 6)):
        out = out.withColumn(name, F.floor(F.col(name) * 10.0**places + 0.5000001) / 10.0**places)
    return out


@query(f"""with p as (select season, cast(home_score as double) as x, cast(away_score as double) as y, cast(1 + game % 3 as double) as w from games ),
  s as (select season, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * y) as sxy, sum(w * x * x) as sxx, sum(w * y * y) as syy from p group by 1)
  select season, {st('(sxy / sw - sx / sw * sy / sw) / sqrt((sxx / sw - sx / sw * sx / sw) * (syy / sw - sy / sw * sy / sw))')} as r from s""")
def weighted_correlation(spark, d):
    p = games(spark, d).select("season", F.col("home_score").cast("double").alias("x"), F.col("away_score").cast("double").alias("y"), (1 + F.col("game") % 3).cast("double").alias("w"))
    return rounded(p.groupBy("season").agg(linear.weighted_correlation("x", "y", "w").alias("r")), "r")


@query(f"with f as (select regr_slope(away_score, home_score) as b, regr_intercept(away_score, home_score) as a from games where season < 1996) select game, {st('away_score - b * home_score - a')} as res_away_score from games , f")
def residualised(spark, d):
    g = games(spark, d).withColumns({c: F.col(c).cast("double") for c in ("home_score", "away_score")})
    return rounded(linear.residualised(g, ["away_score"], "home_score", F.col("season") < 1996), "res_away_score").select("game", "res_away_score")


@query(f"with f as (select regr_slope(away_score, home_score) as b, regr_intercept(away_score, home_score) as a from games ) select game, {st('a + b * home_score')} as calibrated from games , f")
def calibration_head(spark, d):
    g = games(spark, d).withColumns({c: F.col(c).cast("double") for c in ("home_score", "away_score")})
    return rounded(linear.calibrated(g, "home_score", "away_score"), "calibrated").select("game", "calibrated")


def _features(spark, d):
    g = games(spark, d)
    return g.select("game", F.month("date").alias("week"), F.col("home").cast("double").alias("f1"), F.col("away").cast("double").alias("f2"), (F.col("home_score") - F.col("away_score")).cast("double").alias("margin"))


@query()
def elastic_net_grid(spark, d):
    """No oracle: coordinate descent over folds of weeks."""
    found = linear.cross_validated(_features(spark, d), ["f1", "f2"], "margin", "week", [0.0, 0.1, 1.0], [0.0, 0.5, 1.0])
    return rounded(spark.createDataFrame([(r["alpha"], r["mix"], r["rmse"]) for r in found], "alpha double, mix double, rmse double"), "rmse")


@query()
def walk_forward(spark, d):
    """No oracle: a fit for each week on all weeks before it."""
    return rounded(linear.walk_forward(_features(spark, d), ["f1", "f2"], "margin", "week"), "prediction").select("game", "week", "margin", "prediction")


@query(f"with w as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]) as w), p as (select w, w * home_score + (1 - w) * away_score as blend, home_score - away_score as target from games , w) select cast(w as double) as w, {st('corr(blend, target)')} as pearson, {st('sqrt(avg((blend - target) * (blend - target)))')} as rmse, {st('avg(abs(blend - target))')} as mae, {st('stddev_pop(abs(blend - target))')} as abs_error_deviation, count(*) as n from p group by 1")
def blend_search(spark, d):
    from rookery.operators import bets

    g = games(spark, d).withColumn("target", F.col("home_score") - F.col("away_score"))
    return rounded(bets.grid(g, [0.0, 0.25, 0.5, 0.75, 1.0], "home_score", "away_score", "target"), "pearson", "rmse", "mae", "abs_error_deviation")


@query(f"with {TW} select season, list_sort(list(pf))[least(cast(floor(count(*) * 0.1) as bigint) + 1, count(*))] as p10, list_sort(list(pf))[least(cast(floor(count(*) * 0.5) as bigint) + 1, count(*))] as upper_median, list_sort(list(pf))[least(cast(floor(count(*) * 0.9) as bigint) + 1, count(*))] as p90 from tw group by 1")
def nearest_rank_percentiles(spark, d):
    return aggregates.nearest_rank(_weeks(spark, d), ["season"], "pf", {"p10": 0.1, "upper_median": 0.5, "p90": 0.9})


@query(f"with {TS}, r as (select team, season, pf, row_number() over (partition by season order by pf desc, team) as k from ts) select team, season, pf, cast(k as integer) as rank from r where k <= 5")
def top_five(spark, d):
    from pyspark.sql import Window

    ranked = _seasons(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("season").orderBy(F.desc("pf"), "team")))
    return ranked.where("rank <= 5").select("team", "season", "pf", "rank")


@query("with g as (select home, away, home_score, away_score from games ), b as (select case when home % 3 = 0 then 'P5' when home % 3 = 1 then 'G5' else 'FCS' end as h, case when away % 3 = 0 then 'P5' when away % 3 = 1 then 'G5' else 'FCS' end as a from g), c as (select case when (h = 'P5' and a = 'G5') or (h = 'G5' and a = 'P5') then 'P5_G5' when (h = 'P5' and a = 'FCS') or (h = 'FCS' and a = 'P5') then 'P5_FCS' when (h = 'G5' and a = 'FCS') or (h = 'FCS' and a = 'G5') then 'G5_FCS' when h = 'G5' and a = 'G5' then 'G5_G5' else 'P5_P5' end as class from b) select class, count(*) as n from c group by 1")
def matchup_classes(spark, d):
    from rookery.functions.numbers import matchup_class

    tier = lambda c: F.when(F.col(c) % 3 == 0, "P5").when(F.col(c) % 3 == 1, "G5").otherwise("FCS")
    return games(spark, d).groupBy(matchup_class(tier("home"), tier("away")).alias("class")).agg(F.count("*").alias("n"))
