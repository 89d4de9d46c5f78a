"""Queries on training rows, feature matrices, blends, home edges, strategy summaries and market filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import ratings, training, windows
from rookery.plans.registry import bets, games, kicks, query, quotes, rounded, st
from rookery.plans.teams import TG, TS, _seasons, _sides, z

_LEVEL = "case when team < 15 then 2 when team < 30 then 1 else 0 end"
_SIDE = lambda x, home: f"max(case when {'' if home else 'not '}is_home then {x} end)"
_GAP = lambda x: f"{_SIDE(x, True)} - {_SIDE(x, False)}"


@query(f"""with {TG}, k as (select game, min(kick) as kick from kicks group by 1),
  w as (select k.game, q.book, q.ts, q.line, row_number() over (partition by k.game, q.book order by q.ts desc, q.quote_id desc) as n from k join quotes q on q.game = k.game and q.ts >= k.kick - interval 1440 minute and q.ts <= k.kick + interval 5 minute),
  f as (select game, -median(case when n = 1 then line end) as target, count(distinct book) as books, min(ts) as window_start, max(ts) as window_end from w group by 1),
  r as (select *, coalesce(cast(date_diff('day', lag(date::date) over (partition by team order by date, game), date::date) as double), 0) as rest, {_LEVEL} as level from tg),
  p as (select game, {_GAP('pf')} as diff_pf, {_GAP('level')} as tier_gap, {_SIDE('level', True)} + {_SIDE('level', False)} = 3 as p5_vs_g5, {_GAP('rest')} as rest_diff, {_SIDE('rest > 10', True)} as bye_home, {_SIDE('rest > 10', False)} as bye_away from r group by 1)
  select game, diff_pf, cast(tier_gap as integer) as tier_gap, p5_vs_g5, rest_diff, bye_home, bye_away, {st('target')} as target, books, window_start, window_end, books is not null as pre_kick, 'B' as set_label, 0.6::double as row_weight from p left join f using (game)""")
def training_set(spark, d):
    rested = windows.rest(_sides(spark, d).withColumn("date", F.to_date("date").cast("timestamp")), ["team"], "date", "game").withColumnRenamed("rest_days", "rest")
    rows = rested.withColumn("tier", F.when(F.col("team") < 15, "P5").when(F.col("team") < 30, "G5").otherwise("FCS"))
    starts = kicks(spark, d).groupBy("game").agg(F.min("kick").alias("kick"))
    return rounded(training.training_rows(rows, training.targets(starts, quotes(spark, d), before=1440), ("pf",), "B"), "target")


_ENGINEERED = ("off_adj_epa", "edge_epa", "ewma3_def", "ewma5_off")


def _mean(x: str, weights: tuple[float, ...], of: int) -> str:
    """The SQL of an average of the last games with the prior in place of missing ones."""
    lags = [f"lag({x}, {i + 1}) over w" for i in range(len(weights))]
    spare = f"greatest(0.0::double, 1 - (row_number() over w - 1) / {of}.0::double)"
    top = " + ".join(["0::double", *(f"coalesce({t} * {k}::double, 0)" for t, k in zip(lags, weights)), f"talent * {spare}"])
    bottom = " + ".join(["0::double", *(f"case when {t} is not null then {k}::double else 0::double end" for t, k in zip(lags, weights)), spare])
    return f"({top}) / ({bottom})"


def _clean(x: str) -> tuple[str, str]:
    """The SQL of a column's ends and moments, and of the cleaned column."""
    pick = lambda p: f"list_sort(list({x}))[least(cast(floor(count({x}) * {p}) as bigint) + 1, count({x}))]"
    return f"{pick(0.01)} as lo_{x}, {pick(0.99)} as hi_{x}, avg({x}) as m_{x}, stddev_pop({x}) as s_{x}", st(f"(greatest(lo_{x}, least(hi_{x}, {x})) - m_{x}) / s_{x}", 3) + f" as {x}"


_BASE = f"""with {TG}, r as (select *, (team * 37 % 101)::double as talent from tg),
  n as (select r.*, (r.pf - x.pa)::double as off_adj_epa, (-(r.pa + x.pf))::double as def_adj_epa, (r.pf - x.pa + r.pa + x.pf)::double as edge_epa from r left join r x on r.game = x.game and r.opponent = x.team),
  e as (select *, {_mean('def_adj_epa', windows.EWMA_3, 5)} as ewma3_def, {_mean('off_adj_epa', windows.EWMA_5, 5)} as ewma5_off, row_number() over w <= 3 as low_3, cast(date_diff('day', lag(date::date) over w, date::date) as bigint) as rest_days from n window w as (partition by team, season order by date, game))"""


def _nets(spark, d):
    g = _sides(spark, d).withColumns({"talent": (F.col("team") * 37 % 101).cast("double"), "date": F.to_date("date").cast("timestamp")})
    return g.select("game", "team", "opponent", "season", "date", "talent", *[F.col(c).cast("double").alias(f"{s}_{m}") for m in ratings.NETS for s, c in (("off", "pf"), ("def", "pa"))])


@query(f"""{_BASE}, k as (select season, {', '.join(_clean(c)[0] for c in _ENGINEERED)} from e group by 1)
  select game, team, low_3, rest_days, {' + '.join(f'case when {c} < lo_{c} or {c} > hi_{c} then 1 else 0 end' for c in _ENGINEERED)} as n_clipped, {', '.join(_clean(c)[1] for c in _ENGINEERED)} from e join k using (season)""")
def engineered_features(spark, d):
    from rookery.functions.numbers import stable

    out = training.engineered(_nets(spark, d), ["season"], _ENGINEERED).select("game", "team", "low_3", "rest_days", "n_clipped", *_ENGINEERED)
    return out.withColumns({c: stable(c, 3) for c in _ENGINEERED})


@query("""with g as (select case when game % 9 <> 0 then home_score end as few, case when game % 3 <> 0 then away_score end as many, 4 as flat from games ), l as (select 'few' as name, few::double as x from g union all select 'many', many from g union all select 'flat', flat from g),
  s as (select name, 1 - count(x) / count(*) as null_share, stddev_pop(x) as deviation from l group by 1) select name, floor(null_share * 10000.0 + 0.5000001) / 10000.0 as null_share, floor(deviation * 10000.0 + 0.5000001) / 10000.0 as deviation, null_share < 0.15 and deviation > 1e-4 as passed from s""")
def null_gates(spark, d):
    g = games(spark, d).select(F.when(F.col("game") % 9 != 0, F.col("home_score")).alias("few"), F.when(F.col("game") % 3 != 0, F.col("away_score")).alias("many"), F.lit(4).alias("flat"))
    return rounded(training.null_gates(g, ("few", "many", "flat")), "null_share", "deviation")


_X = {"f_diff": "coalesce(case when game % 9 <> 0 then home_score - away_score end, 0)::double", "f_home": "home_score::double", "f_sq": "power(coalesce(case when game % 9 <> 0 then home_score - away_score end, 0)::double, 2) / 100"}
_SCALED = ", ".join(f"{st(f'({n} - avg({n}) over ()) / stddev_pop({n}) over ()')} as {o}" for n, o in (("f_diff", "x_diff"), ("f_home", "x_home"), ("f_sq", "x_diff_sq")))


@query(f"with m as (select game, {', '.join(f'{x} as {n}' for n, x in _X.items())}, case when game % 4 = 0 then 1.0 else 0.0 end::double as x_neutral from games ) select game, {_SCALED}, x_neutral from m")
def feature_matrix(spark, d):
    margin = F.when(F.col("game") % 9 != 0, F.col("home_score") - F.col("away_score"))
    rows = games(spark, d).select("game", margin.alias("diff"), F.col("home_score").alias("home"), F.when(F.col("game") % 4 == 0, True).alias("neutral"))  # a null flag is 0
    names = ("x_diff", "x_home", "x_diff_sq")
    return rounded(training.feature_matrix(rows, ["diff", "home"], ["neutral"], {"diff": 100.0}), *names).select("game", *names, "x_neutral")


@query(f"""with t as (select home as team, count(*) as n, avg(home_score - away_score - 2) as m, stddev_pop(home_score - away_score - 2) as s from games group by 1), e as (select *, greatest(-1.5, least(1.5, m * n / (n + 20.0))) as e from t)
  select team, n, {st('m')} as mean_residual, {st('s')} as deviation, {st('e')} as edge, {st('2 + e')} as hfa from e""")
def home_edges(spark, d):
    residuals = games(spark, d).select(F.col("home").alias("team"), (F.col("home_score") - F.col("away_score") - 2).alias("residual"))
    return rounded(training.home_edges(residuals), "mean_residual", "deviation", "edge", "hfa")


_W = [round(i / 20, 2) for i in range(21)]


@query(f"""with p as (select game, case when season % 2 = 0 then 'A' else 'B' end as s, home_score as a, away_score as b, home_score - 2 * away_score as y from games ),
  e as (select p.*, v.w, v.w * a + (1 - v.w) * b as x from p, (select unnest([{', '.join(f'{w}::double' for w in _W)}]) as w) v),
  r as (select *, row_number() over (partition by s, w order by x, game) as rx, row_number() over (partition by s, w order by y, game) as ry from e),
  c as (select w, coalesce(corr(x, y) filter (where s = 'A'), 0) as pearson_a, coalesce(corr(rx, ry) filter (where s = 'A'), 0) as spearman_a, coalesce(corr(x, y) filter (where s = 'B'), 0) as pearson_b, coalesce(corr(rx, ry) filter (where s = 'B'), 0) as spearman_b from r group by 1),
  o as (select *, 0.5 * (pearson_a + spearman_a) + 0.5 * (pearson_b + spearman_b) as objective from c), t as (select w, pearson_b from o where pearson_b >= 0 order by objective desc, w limit 1),
  k as (select case when w = 0 and pearson_b < 0.25 and exists (select 1 from o where o.w = 0.1 and o.pearson_b >= 0.25) then 0.1 else w end as pick from t)
  select w, {', '.join(f'{st(c)} as {c}' for c in ('pearson_a', 'spearman_a', 'pearson_b', 'spearman_b', 'objective'))}, coalesce(abs(w - (select pick from k)) < 1e-9, false) as chosen from o""")
def blend_by_sets(spark, d):
    g = games(spark, d).withColumns({"label": F.when(F.col("season") % 2 == 0, "A").otherwise("B"), "target": F.col("home_score") - 2 * F.col("away_score")})
    return rounded(training.blend_by_sets(g, "home_score", "away_score", "target", "label", "game", _W), "pearson_a", "spearman_a", "pearson_b", "spearman_b", "objective")


_WC = lambda p, q: f"(sum(w * {p} * {q}) / sum(w) - sum(w * {p}) / sum(w) * sum(w * {q}) / sum(w))"


@query(f"""with p as (select season, home_score::double as a, case when game % 10 = 0 then 0.0 else 2.0 + home % 3 * 0.5 end::double as b, (home_score - away_score)::double as t, case when game % 3 = 0 then 0.6 else 1.0 end::double as w from games ),
  m as (select season, count(*) as n, {_WC('a', 'a')} as aa, {_WC('b', 'b')} as bb, {_WC('a', 'b')} as ab, {_WC('a', 't')} as av, {_WC('b', 't')} as bv, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as cab, stddev_pop(t) as deviation from p group by 1),
  s as (select *, (av * bb - bv * ab) / (aa * bb - ab * ab) as slope, (bv * aa - av * ab) / (aa * bb - ab * ab) as hfa_slope from m)
  select season, n, {st('deviation')} as deviation, {st('slope')} as slope, {st('hfa_slope')} as hfa_slope, {st('sqrt(slope * slope * va + hfa_slope * hfa_slope * vb + 2 * slope * hfa_slope * cab) / deviation')} as variance_ratio, slope > 0 and hfa_slope > 0 as signs_ok from s""")
def variance_probe(spark, d):
    g = games(spark, d).select(
        "season", F.col("home_score").alias("x"), F.when(F.col("game") % 10 == 0, 0.0).otherwise(2.0 + F.col("home") % 3 * 0.5).alias("hfa"), (F.col("home_score") - F.col("away_score")).alias("y"),
        F.when(F.col("game") % 3 == 0, 0.6).otherwise(1.0).alias("weight"),
    )
    return rounded(training.variance_probe(g, ["season"], "x", "hfa", "y", "weight"), "deviation", "slope", "hfa_slope", "variance_ratio")


@query(f"""with {TG}, r as (select team, {st('avg(margin)')} as rating from tg group by 1)
  select t.team, r.rating, {st('avg(t.pf)')} as offense, {st('avg(t.pa)')} as defense, {st('sqrt(avg(power(t.margin - (r.rating - o.rating), 2)))')} as sigma from tg t join r on r.team = t.team left join r o on o.team = t.opponent group by 1, 2""")
def score_errors(spark, d):
    rating = rounded(ratings.records(games(spark, d)).select("team", F.col("mean_margin").alias("rating")), "rating")
    return rounded(training.score_errors(games(spark, d), rating), "offense", "defense", "sigma")


_TOP = "(clv <> 0 and abs(edge - clv) >= 3)"


@query(f"""select market, week, count(*) as bets, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes,
  {st("count(*) filter (where result = 'win') * 100.0 / (count(*) filter (where result = 'win') + count(*) filter (where result = 'loss'))", 2)} as win_rate, {st('sum(stake)', 0)} as total_stake, {st('sum(pnl)', 0)} as total_pnl, {st('sum(pnl) * 100 / sum(stake)', 2)} as roi,
  count(*) filter (where {_TOP}) as tier_a_bets, {st(f'sum(pnl) filter (where {_TOP}) * 100 / sum(stake) filter (where {_TOP})', 2)} as tier_a_roi from bets group by 1, 2""")
def strategy_summary(spark, d):
    from rookery.functions.numbers import stable

    b = bets(spark, d).withColumns({"model": F.col("edge"), "close": F.col("clv")})
    out = training.strategy_summary(b, ["market", "week"])
    return out.withColumns({n: stable(n, places) for n, places in (("win_rate", 2), ("total_stake", 0), ("total_pnl", 0), ("roi", 2), ("tier_a_roi", 2))})


@query("select game, home, away from games where abs(45 + home - (home_score + away_score)) >= 2 or abs(45 - home - (home_score + away_score)) >= 2")
def off_market(spark, d):
    g = games(spark, d)
    outputs = g.select("game", F.explode(F.array(45 + F.col("home"), 45 - F.col("home"))).alias("implied_total"))
    return training.off_market(g, outputs, "implied_total", F.col("home_score") + F.col("away_score")).select("game", "home", "away")


_APART = "abs(epoch_us(q.ts) - epoch_us(k.kick)) / 86400000000.0"


@query(f"""with m as (select k.kick_id, count(*) as n, min(q.quote_id) as only_one, min({_APART}) as apart, arg_min(q.quote_id, (q.ts, q.quote_id)) filter (where {_APART} <= 2) as near from kicks k join quotes q on q.game = k.game and q.book = 'click' group by 1)
  select k.kick_id, coalesce(near, case when n = 1 and apart <= case when k.game % 2 = 0 then 14 else 8 end then only_one end) as match, case when near is not null then 'window' when n = 1 and apart <= case when k.game % 2 = 0 then 14 else 8 end then 'season' end as how from kicks k left join m using (kick_id)""")
def matched_games(spark, d):
    right = quotes(spark, d).where("book = 'click'").select("game", "ts", F.col("quote_id").alias("match"))
    return training.matched_game(kicks(spark, d), right, ["game"], "kick", "ts", "kick_id", "match", moving=F.col("game") % 2 == 0).select("kick_id", "match", "how")


_V1 = {
    "ypp_off": "case when team <> 7 then pf end", "pass_ypa_off": "pa", "rush_ypc_off": "pf + pa", "success_off": "case when team <> 7 then n end", "epa_off": "pf - pa",
    "ypp_def": "case when team % 4 <> 0 and team <> 7 then pf * 2 end", "pass_ypa_def": "case when team % 4 <> 0 then pa end", "rush_ypc_def": "case when team % 4 <> 0 then pa - pf end", "success_def": "case when team <> 7 then pa * 3 end", "epa_def": "n",
    "talent": "team * 37 % 101", "blue_chips": "team * 13 % 7", "commits": "team % 5", "weeks": "team % 10", "conference": "case when team % 3 = 0 then 'SEC' when team % 3 = 1 then 'MAC' else 'Nowhere' end",
}
_SUM = lambda weights: " + ".join(f"coalesce({z(c)}, 0) * {w!r}" for c, w in weights.items())


@query(f"""with {TS}, s as (select team, season, {', '.join(f'{x} as {n}' for n, x in _V1.items())} from ts),
  p as (select *, {_SUM(ratings.V1_OFFENSE)} as offense, -(case when coalesce(ypp_def, pass_ypa_def, rush_ypc_def) is not null then {_SUM(ratings.V1_DEFENSE)} else {_SUM({'success_def': 0.25 / 0.45, 'epa_def': 0.2 / 0.45})} end) as defense, {_SUM(ratings.V1_TALENT)} as prior from s)
  select team, season, {st('offense')} as offense, {st('defense')} as defense, {st("(case when team <> 7 then offense + defense else 0 end + greatest(0, 1 - weeks / 8.0) * prior + case conference when 'SEC' then 5.0 when 'MAC' then -3.5 else -5.0 end) * 8")} as rating from p""")
def v1_rating(spark, d):
    stats = _seasons(spark, d).select("team", "season", *[F.expr(x).alias(n) for n, x in _V1.items()])
    return rounded(ratings.v1_rating(stats, ["season"]), "offense", "defense", "rating").select("team", "season", "offense", "defense", "rating")
