"""Queries on bets: records, bands, profiles, sequences, strategies, scalar functions, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import frames, numbers, text
from rookery.operators import aggregates, bets as ops, resolve, windows
from rookery.plans.registry import bets, games, query, rounded, st
from rookery.session import table

RECORD = ["win_rate", "hit_rate", "stake", "pnl", "roi", "avg_edge", "avg_clv"]
AGGS = f"""count(*) as bets, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes,
  {st("count(*) filter (where result = 'win') / nullif(count(*) filter (where result in ('win', 'loss')), 0)")} as win_rate, {st("count(*) filter (where result = 'win') / nullif(count(result), 0)")} as hit_rate,
  {st("sum(stake)", 2)} as stake, {st("sum(coalesce(pnl, 0))", 2)} as pnl, {st("sum(coalesce(pnl, 0)) / sum(stake)")} as roi, {st("avg(edge)")} as avg_edge, {st("avg(clv)")} as avg_clv"""


def _record(df):
    out = rounded(df, "win_rate", "hit_rate", "roi", "avg_edge", "avg_clv")
    return out.withColumns({c: numbers.stable(c, 2) for c in ("stake", "pnl")})


@query(f"select week, market, {AGGS}, cast(grouping(week, market) as bigint) as level from bets group by grouping sets ((week), (market), ())")
def season_summary(spark, d):
    return _record(aggregates.breakdowns(bets(spark, d), "week", "market")).withColumn("level", F.col("level").cast("bigint"))


@query(f"select case when edge < -10 then 'low' when edge < 10 then 'middle' else 'high' end as band, {AGGS} from bets group by 1")
def edge_bands(spark, d):
    return _record(bets(spark, d).groupBy(aggregates.band("edge", [-10.0, 10.0], ["low", "middle", "high"]).alias("band")).agg(*aggregates.record()))


@query(f"select week, case when edge < 0 then 'under' else 'over' end as band, count(*) as n, {st('avg(pnl)', 2)} as pnl from bets group by 1, 2 having count(*) >= 100")
def banded_cells(spark, d):
    found = aggregates.crosstab(bets(spark, d), F.col("week"), aggregates.band("edge", [0.0], ["under", "over"]).alias("band"), 100, F.avg("pnl").alias("pnl"))
    return found.withColumn("pnl", numbers.stable("pnl", 2))


@query("select cast(floor(edge) as bigint) as bucket, count(*) as n from bets group by 1")
def edge_histogram(spark, d):
    return aggregates.histogram(bets(spark, d), "edge")


@query(f"select case when abs(edge) <= 7 then '0-7' when abs(edge) <= 14 then '7-14' when abs(edge) <= 28 then '14-28' else '28+' end as bucket, count(*) as n, {st('avg(edge)')} as mean, {st('stddev_pop(edge)')} as deviation from bets group by 1")
def residual_buckets(spark, d):
    return rounded(aggregates.residual_buckets(bets(spark, d), "edge"), "mean", "deviation")


def _profile(c: str) -> str:
    x = f"cast({c} as double)"
    return f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as nulls, count(*) filter (where {c} = 0) as zeros, {st(f'avg({x})')} as mean, {st(f'stddev_pop({x})')} as deviation, min({x}) as least, max({x}) as most from bets "


@query(" union all ".join(map(_profile, ("edge", "clv", "week"))))
def feature_profile(spark, d):
    return rounded(aggregates.profile(bets(spark, d), "edge", "clv", "week"), "mean", "deviation")


@query("with f as (select case when week % 2 = 0 then clv end as clv, case when edge > 0 then edge end as edge from bets ) select 'clv' as column_name, count(*) as n_rows, count(clv) as filled, count(clv) / count(*) as ratio from f union all select 'edge', count(*), count(edge), count(edge) / count(*) from f")
def completeness(spark, d):
    b = bets(spark, d).select(F.when(F.col("week") % 2 == 0, F.col("clv")).alias("clv"), F.when(F.col("edge") > 0, F.col("edge")).alias("edge"))
    return aggregates.fill_ratio(b, "clv", "edge")


@query(f"select book, {st('nullif(sum(coalesce(edge, 0)) / count(*), 0)')} as mean, {st('sum(coalesce(edge, 0) * week) / nullif(sum(week), 0)')} as weighted from bets group by 1")
def guarded_means(spark, d):
    return rounded(bets(spark, d).groupBy("book").agg(aggregates.mean_zero_as_null("edge").alias("mean"), aggregates.weighted_mean("edge", "week").alias("weighted")), "mean", "weighted")


@query(f"with e as (select book, game, week, part, sum(pnl) over (partition by book order by game, week, part rows unbounded preceding) as equity from bets ), p as (select *, greatest(0.0, max(equity) over (partition by book order by game, week, part rows unbounded preceding)) as peak from e) select book, count(*) as n, {st('max(peak - equity)', 1)} as max_drawdown, {st('max(peak)', 1)} as peak from p group by 1")
def drawdowns(spark, d):
    run = windows.drawdown(bets(spark, d), ["book"], ["game", "week", "part"], "pnl").groupBy("book").agg(F.count("*").alias("n"), F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("peak"))
    return run.withColumns({c: numbers.stable(c, 1) for c in ("max_drawdown", "peak")})


@query(f"select book, {st('exp(sum(ln(1 + 0.01 * pnl / stake))) * 1000', 2)} as bankroll from bets group by 1")
def bankrolls(spark, d):
    b = bets(spark, d).withColumns({"share": F.lit(0.01), "outcome": F.col("pnl") / F.col("stake")})
    run = windows.bankroll(b, ["book"], ["game", "week", "part"], "share", "outcome")
    return run.groupBy("book").agg(numbers.stable(F.max_by("bankroll", F.struct("game", "week", "part")), 2).alias("bankroll"))


LEDGER = "order by week, game, part rows unbounded preceding"


@query(f"""with e as (select week, sum(coalesce(pnl, 0)) over ({LEDGER}) as equity, row_number() over ({LEDGER.removesuffix(" rows unbounded preceding")}) as x from bets ), p as (select *, greatest(0.0, max(equity) over (order by x rows unbounded preceding)) as peak from e)
  select week, count(*) as n, max(x) as last, {st('max(peak - equity)', 0)} as max_drawdown, {st('max(peak)', 0)} as peak, {st('max_by(equity, x)', 0)} as equity from p group by 1""")
def whole_ledger(spark, d):
    """All bets as one ledger, week after week: its places, peak, drawdown and equity at each week's end."""
    run = windows.drawdown(bets(spark, d), [], ["week", "game", "part"], "pnl")
    run = run.groupBy("week").agg(F.count("*").alias("n"), F.max("x").cast("bigint").alias("last"), F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("peak"), F.max_by("equity", "x").alias("equity"))
    return run.withColumns({c: numbers.stable(c, 0) for c in ("max_drawdown", "peak", "equity")})


#: All bets, cut by market into two strategies.
STRATEGIES = "h as (select game, min(case when edge > 0 then 'home' else 'away' end) as side from bets where market = 'O' group by 1), o as (select game, min(case when result = 'win' then 'home' else 'away' end) as side from bets where market <> 'O' group by 1)"


def _strategies(spark, d):
    b = bets(spark, d)
    hybrid = b.where("market = 'O'").groupBy("game").agg(F.min(F.when(F.col("edge") > 0, "home").otherwise("away")).alias("side"))
    other = b.where("market <> 'O'").groupBy("game").agg(F.min(F.when(F.col("result") == "win", "home").otherwise("away")).alias("side"))
    return hybrid, other


@query(f"with {STRATEGIES} select h.game, h.side, case when o.side is null then 'hybrid_only' when o.side <> h.side then 'strong' else 'weak' end as conflict from h left join o using (game)")
def conflict_tags(spark, d):
    return ops.conflicts(*_strategies(spark, d), "game")


@query(f"with {STRATEGIES}, b as (select coalesce(h.game, o.game) as game, h.side as a, o.side as b from h full join o on h.game = o.game) select case when b is null then 'a_only' when a is null then 'b_only' when a = b then 'same' else 'opposite' end as overlap, count(*) as n from b group by 1")
def strategy_overlap(spark, d):
    return ops.overlap(*_strategies(spark, d), "game").groupBy("overlap").agg(F.count("*").alias("n"))


@query(f"with {STRATEGIES} select * from h union all select o.* from o where not exists (select 1 from h where h.game = o.game)")
def portfolio(spark, d):
    return ops.portfolio(*_strategies(spark, d), "game")


@query("with p as (select week as bet_id, game, part, market, case when edge > 0 then 'home' else 'away' end as side from bets ), o as (select *, row_number() over (partition by game, side order by bet_id, part) as n from p where market <> 'O') select p.game, p.side, p.bet_id, p.part, o.bet_id as other_id from p join o on o.game = p.game and o.side = p.side and o.n = 1 where p.market = 'O'")
def agreeing_bets(spark, d):
    p = bets(spark, d).select(F.col("week").alias("bet_id"), "game", "part", "market", F.when(F.col("edge") > 0, "home").otherwise("away").alias("side"))
    return ops.agreeing(p.where("market = 'O'"), p.where("market <> 'O'"), "game", ["bet_id", "part"]).select("game", "side", "bet_id", "part", "other_id")


@query("with e as (select game, home_score - away_score as spread, home_score + away_score - 50 as total, case when game % 3 = 0 then 'A' else 'B' end as confidence, home as team from games ), k as (select game, cast(greatest(abs(spread), abs(total), 0.0) as double) as max_edge from e where (abs(spread) >= 30 or abs(total) >= 40) and confidence = 'A' and team <> 7) select game, max_edge from k order by max_edge desc, game limit 25")
def ruleset_picks(spark, d):
    g = games(spark, d)
    e = g.select("game", (F.col("home_score") - F.col("away_score")).alias("spread"), (F.col("home_score") + F.col("away_score") - 50).alias("total"), F.when(F.col("game") % 3 == 0, "A").otherwise("B").alias("confidence"), F.col("home").alias("team"))
    rules = {"edges": {"spread": 30, "total": 40}, "confidence": ["A"], "exclude": [7], "maxGames": 25}
    return ops.ruleset(e, rules).select("game", F.col("max_edge").cast("double").alias("max_edge"))


@query("select 'all' as stage, count(*) as n from bets union all select 'edge', count(*) from bets where edge > 0 union all select 'graded', count(*) from bets where edge > 0 and result <> 'push' union all select 'won', count(*) from bets where edge > 0 and result = 'win'")
def bet_funnel(spark, d):
    stages = {"all": F.lit(True), "edge": F.col("edge") > 0, "graded": F.col("result") != "push", "won": F.col("result") == "win"}
    return ops.funnel(bets(spark, d), stages)


@query("with v as (select avg(edge) as mean_edge, cast(count(*) filter (where pnl is null) as double) as null_pnl from bets ) select 'mean_edge' as check_name, floor(mean_edge * 10000.0 + 0.5000001) / 10000.0 as value, mean_edge between -5 and 5 as passed from v union all select 'null_pnl', null_pnl, null_pnl between 0 and 0 from v")
def quality_gates(spark, d):
    checks = {"mean_edge": (F.avg("edge"), -5.0, 5.0), "null_pnl": (aggregates.count_if(F.col("pnl").isNull()), 0.0, 0.0)}
    return rounded(aggregates.gates(bets(spark, d), checks), "value")


PRICES = "case when game % 2 = 0 then 100 + game % 300 else -100 - game % 300 end"


@query(f"""with p as (select game, cast({PRICES} as double) as price, cast(home_score - away_score as double) as hma from games ), v as (select *, case when price > 0 then 100 / (price + 100) else price / (price - 100) end as implied, greatest(0.01, least(0.99, 1 / (1 + power(10.0, -hma / 14.5)))) as prob from p)
  select game, {st('implied')} as implied, case when price > 0 then price / 100 else 100 / -price end as payout, {st('prob')} as prob, {st('(prob - implied) * 100')} as value,
  case when prob >= 0.5 then floor(-100 * prob / (1 - prob) + 0.5) else floor(100 * (1 - prob) / prob + 0.5) end as fair, {st('greatest(0.1, least(5.0, least(abs(hma) / 100, 0.1) * 0.5 * 10))')} as kelly,
  floor(hma / 3 * 2 + 0.5) / 2 as half, -abs(hma) as fc, case when hma > 0 then 'home' when hma < 0 then 'away' end as favourite from v""")
def odds_functions(spark, d):
    price = F.when(F.col("game") % 2 == 0, 100 + F.col("game") % 300).otherwise(-100 - F.col("game") % 300).cast("double")
    p = games(spark, d).select("game", price.alias("price"), (F.col("home_score") - F.col("away_score")).cast("double").alias("hma"))
    prob = numbers.win_probability("hma")
    out = p.select(
        "game", numbers.american_to_probability("price").alias("implied"), numbers.american_payout("price").alias("payout"), prob.alias("prob"), numbers.moneyline_value(prob, "price").alias("value"),
        numbers.fair_moneyline(prob).alias("fair"), numbers.kelly_stake(F.abs("hma"), 0.5).alias("kelly"), numbers.round_to_half(F.col("hma") / 3).alias("half"), frames.hma_to_fc("hma").alias("fc"), frames.favourite("hma").alias("favourite"),
    )
    return rounded(out, "implied", "prob", "value", "kelly").withColumn("fair", F.col("fair").cast("double"))


@query("with p as (select game, cast(home_score - away_score as double) as model, cast(away - home as double) as market from games ) select game, case when abs(model - market) >= 0.1 then case when model > market then 'home' else 'away' end end as side, case when abs(model - market) >= 0.1 then case when model > market then -market else market end end as line, case when model - market >= 2.5 then 'over' when model - market <= -2.5 then 'under' end as pick, greatest(-3.0, least(3.0, 0.25 * (model - market))) as overlay from p")
def pick_functions(spark, d):
    p = games(spark, d).select("game", (F.col("home_score") - F.col("away_score")).cast("double").alias("model"), (F.col("away") - F.col("home")).cast("double").alias("market")).withColumn("b", frames.bettable("model", "market"))
    return p.select("game", F.col("b.side").alias("side"), F.col("b.line_book").alias("line"), frames.total_pick("model", "market").alias("pick"), numbers.overlay("model", "market").alias("overlay"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(replace(p_name, '&', 'and')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g') as field, p_name || ' @ ' || p_brand as matchup from part")
def name_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.field_name(F.col("p_type")).alias("field"), text.matchup(F.col("p_name"), F.col("p_brand")).alias("matchup"))


@query("with n as (select n_nationkey, n_name, case when n_nationkey % 4 = 0 then n_name when n_nationkey % 4 = 1 then lower(n_name) when n_nationkey % 4 = 2 then n_name || ' (x)' else 'alias ' || n_nationkey end as name from nation) select name, n_nationkey as team_id, cast(case when n_nationkey % 4 = 0 then 0 when n_nationkey % 4 = 3 then 1 when n_nationkey % 4 = 1 then 2 else 3 end as integer) as tier from n")
def resolved_names(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    given = F.when(key % 4 == 0, F.col("n_name")).when(key % 4 == 1, F.lower("n_name")).when(key % 4 == 2, F.concat("n_name", F.lit(" (x)"))).otherwise(F.concat(F.lit("alias "), key.cast("string")))
    teams = n.select(F.col("n_name").alias("team"), key.alias("team_id"))
    aliases = n.select(F.concat(F.lit("alias "), key.cast("string")).alias("alias"), key.alias("team_id"))
    return resolve.resolved(n.select(given.alias("name")), teams, aliases)
