"""Queries on rosters, adjustments, drives, rates, grading, cards, slates, pages and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import numbers, text
from rookery.operators import aggregates, asof, bets as ops, resolve, slate
from rookery.plans.registry import bets, games, kicks, query, quotes, rounded, st
from rookery.session import table

D = "double"


def clip(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def two(x: str) -> str:
    return f"case when {x} > 0.67 then 2 when {x} > 0.33 then 1 else 0 end"


RETURNING = """r as (select game, case when game % 7 = 0 then null else home_score / 60.0 end as off, case when game % 5 = 0 then null else away_score * 1.7 end as def,
  case when game % 11 = 0 then null else home_score / 55.0 end as passing, case when game % 3 = 0 then null else away_score / 50.0 end as rushing, home_score % 26 as t_in, away_score % 22 - 8 as net from games ),
  s as (select *, case when off is null then 0 when off > 1 then least(1.0, off / 100) else off end as a, case when def is null then 0 when def > 1 then least(1.0, def / 100) else def end as b, 0.75 * least(0.3, t_in / 20.0 * 0.3) as fresh from r)"""
CONTINUITY = f"case when off is not null or def is not null then 0.5 * {clip('case when a > 0 then a else b end + fresh')} + 0.5 * {clip('case when b > 0 then b else a end + fresh')} end"
SHOCK = f"case when passing is not null or rushing is not null or def is not null then {clip('(coalesce((1 - passing) * 0.3, 0) + coalesce((1 - rushing) * 0.25, 0) + coalesce((1 - def) * 0.3, 0)) / (case when passing is null then 0 else 0.3 end + case when rushing is null then 0 else 0.25 end + case when def is null then 0 else 0.3 end)')} end"


@query(f"""with {RETURNING}, i as (select game, {CONTINUITY} as continuity, {SHOCK} as shock, {clip('t_in / 20.0')} as mercenary, {clip('(net + 5) / 15.0')} as aggressor from s),
  p as (select *, case when continuity < 0.5 then 2 when continuity < 0.7 then 1 else 0 end + {two('shock')} + {two('mercenary')} + case when aggressor > 0.67 then 1 else 0 end as points from i)
  select game, {st('continuity')} as continuity, {st('shock')} as shock, {st('mercenary')} as mercenary, {st('aggressor')} as aggressor, case when points >= 5 then 'high' when points >= 3 then 'medium' else 'low' end as band from p""")
def roster_indices(spark, d):
    g = F.col("game")
    r = games(spark, d).select(
        "game", F.when(g % 7 != 0, F.col("home_score") / 60.0).alias("off"), F.when(g % 5 != 0, F.col("away_score") * F.lit(1.7)).alias("def"), F.when(g % 11 != 0, F.col("home_score") / 55.0).alias("passing"),
        F.when(g % 3 != 0, F.col("away_score") / 50.0).alias("rushing"), (F.col("home_score") % 26).alias("t_in"), (F.col("away_score") % 22 - 8).alias("net"),
    )
    nothing = F.lit(None).cast(D)
    r = r.withColumns({"continuity": numbers.continuity("off", "def", nothing, "t_in"), "shock": numbers.positional_shock("passing", "rushing", nothing, "def"), "mercenary": numbers.mercenary_index("t_in"), "aggressor": numbers.portal_aggressor("net")})
    r = r.withColumn("band", numbers.risk_band(*[F.col(c) for c in ("continuity", "shock", "mercenary", "aggressor")]))
    return rounded(r.select("game", "continuity", "shock", "mercenary", "aggressor", "band"), "continuity", "shock", "mercenary", "aggressor")


@query(f"""with a as (select game, case when home_score % 9 = 0 then null else (home_score % 11) / 10.0 end as sure, away_score % 12 as n, home_score % 30 as wind, away_score % 40 as cold, case game % 3 when 0 then 'none' when 1 then 'snow' else 'rain' end as rain,
  case game % 6 when 0 then 'QB' when 1 then 'OL' when 2 then 'WR' when 3 then 'DB' when 4 then 'RB' else 'LB' end as pos, case game % 4 when 0 then 'out' when 1 then 'questionable' else 'probable' end as sev, case game % 2 when 0 then 'pass' else 'run' end as hs, case game % 5 when 0 then 'pass' else 'run' end as aw from games ),
  i as (select *, case pos when 'QB' then 2.5 when 'OL' then 1.0 when 'WR' then 0.75 when 'RB' then 0.75 when 'DB' then 0.5 else 0.0 end * case sev when 'out' then 1.0 when 'questionable' then 0.5 else 0.25 end as lost from a)
  select game, {st(f"{clip('0.12 + least(0.15, (1 - case when sure <> 0 then sure else 0.5 end) * 0.5) + case when n < 3 then 0.18 when n <= 4 then 0.12 when n <= 7 then 0.06 else 0 end', '0.18', '0.42')}")} as shrinkage,
  {st("case when wind >= 15 then least(-1.5 - (wind - 15) * 0.1, -3.0) else 0 end + case when rain = 'snow' then -2 when rain <> 'none' then -1 else 0 end + case when cold < 20 then -1.5 else 0 end")} as weather,
  cast(case when wind >= 15 and hs = 'pass' and aw = 'run' then 0.5 when wind >= 15 and hs = 'run' and aw = 'pass' then -0.5 else 0 end as double) as moved, {st('case when game % 2 = 0 then -lost else lost end')} as injury from i""")
def adjustments(spark, d):
    g = F.col("game")
    a = games(spark, d).select(
        "game", F.when(F.col("home_score") % 9 != 0, F.col("home_score") % 11 / 10.0).alias("sure"), (F.col("away_score") % 12).alias("n"), (F.col("home_score") % 30).alias("wind"), (F.col("away_score") % 40).alias("cold"),
        F.when(g % 3 == 0, "none").when(g % 3 == 1, "snow").otherwise("rain").alias("rain"), F.element_at(F.array(*map(F.lit, ("QB", "OL", "WR", "DB", "RB", "LB"))), (g % 6 + 1).cast("int")).alias("pos"),
        F.when(g % 4 == 0, "out").when(g % 4 == 1, "questionable").otherwise("probable").alias("sev"), F.when(g % 2 == 0, "pass").otherwise("run").alias("hs"), F.when(g % 5 == 0, "pass").otherwise("run").alias("aw"),
    )
    out = a.select(
        "game", numbers.shrink_factor("sure", "n").alias("shrinkage"), numbers.weather_line("wind", F.col("rain"), "cold").alias("weather"), numbers.weather_spread("wind", F.col("hs"), F.col("aw")).alias("moved"),
        numbers.injury_spread(F.col("pos"), F.col("sev"), g % 2 == 0).alias("injury"),
    )
    return rounded(out, "shrinkage", "weather", "injury")


@query("""with c as (select game, home_score - away_score as edge, case game % 4 when 0 then 'strong' when 1 then 'weak' when 2 then 'hybrid_only' end as conflict from games )
  select game, case when conflict = 'strong' then case when abs(edge) >= 4 then 'super_tier_a' when abs(edge) >= 3 then 'tier_a' when abs(edge) >= 2 then 'tier_b' end when conflict is null then case when abs(edge) >= 3 then 'tier_a' when abs(edge) >= 2 then 'tier_b' end end as bucket,
  case when abs(edge) >= 4 then 'B' when abs(edge) >= 3 then 'C' end as degraded, edge - 0.1 as playable, edge + 0.1 as flips from c""")
def conflict_buckets(spark, d):
    g = F.col("game")
    c = games(spark, d).select("game", (F.col("home_score") - F.col("away_score")).alias("edge"), F.when(g % 4 == 0, "strong").when(g % 4 == 1, "weak").when(g % 4 == 2, "hybrid_only").alias("conflict"))
    to, flips = numbers.bet_to("edge")
    return c.select("game", numbers.conflict_bucket(F.col("conflict"), "edge").alias("bucket"), numbers.degraded(numbers.tier("edge")).alias("degraded"), to.alias("playable"), flips.alias("flips"))


GIVEN = "case n_nationkey % 8 when 0 then 'LowVig.ag' when 1 then ' DK ' when 2 then n_name || ' Sportsbook' when 3 then n_name || '.com' when 4 then 'Pinny book' when 5 then null when 6 then 'Texas A&M Aggies' else 'Miami (OH)' end"


@query(f"""with n as (select n_nationkey, n_name, {GIVEN} as given from nation) select n_nationkey, case n_nationkey % 8 when 0 then 'LowVig' when 1 then 'DraftKings' when 4 then 'Pinnacle' when 5 then 'Unknown' when 6 then 'Texas A&m Aggies' when 7 then 'Miami (oh)'
  else array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end as book, case n_nationkey % 8 when 6 then 'texas-a-m' when 7 then 'miami-oh' end as guarded, case when given is null then '' when given = 'mock' then 'MOCK' else upper(given[1]) || given[2:] end as badge from n""")
def book_names(spark, d):
    k, name = F.col("n_nationkey") % 8, F.col("n_name")
    given = F.when(k == 0, "LowVig.ag").when(k == 1, " DK ").when(k == 2, F.concat(name, F.lit(" Sportsbook"))).when(k == 3, F.concat(name, F.lit(".com"))).when(k == 4, "Pinny book").when(k == 6, "Texas A&M Aggies").when(k == 7, "Miami (OH)")
    n = table(spark, d, "nation").select("n_nationkey", given.alias("given"))
    return n.select("n_nationkey", text.book_name(F.col("given")).alias("book"), text.guarded_team(F.col("given")).alias("guarded"), text.source_badge(F.col("given")).alias("badge"))


DRIVES = """dr as (select l_orderkey as game_id, l_suppkey % 10 as offense, l_partkey % 10 as defense, case when l_linenumber = 3 then null else cast(l_quantity as integer) * 3 - 10 end as s, case when l_linenumber = 2 then null else cast(l_partkey % 70 as integer) - 5 end as y, case when l_linenumber % 2 = 0 then cast(l_suppkey % 110 as integer) end as e, l_partkey % 8 as points from lineitem),
  sides as (select game_id, offense as team, 'off' as side, s, y, e, points from dr union all select game_id, defense, 'def', s, y, e, points from dr), q as (select *, greatest(0, least(100, s)) as c, greatest(0, least(100, e)) as ce, case when s is not null and y is not null then least(100, greatest(0, least(100, s)) + y) end as reach from sides),
  v as (select *, coalesce(case when e is not null then ce else reach end >= 60, false) as chance, case when s is not null and 100 - c > 0 and coalesce(y, case when e is not null then ce - c end) is not null then greatest(0.0, least(1.0, greatest(0, coalesce(y, ce - c)) / (100 - c))) end as share from q)"""


@query(f"with {DRIVES} select team, side, count(*) as drives, {st('count(*) filter (where y >= 40) / count(*)')} as quality_rate, {st('count(*) / count(distinct game_id)')} as tempo, count(*) filter (where chance) as opportunities, {st('sum(points) filter (where chance) / nullif(count(*) filter (where chance), 0)')} as points_per_opportunity, {st('avg(share)')} as available_yards from v group by 1, 2")
def drive_stats(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as game_id", "l_suppkey % 10 as offense", "l_partkey % 10 as defense", "if(l_linenumber = 3, null, cast(l_quantity as int) * 3 - 10) as start_yards", "if(l_linenumber = 2, null, cast(l_partkey % 70 as int) - 5) as yards",
        "if(l_linenumber % 2 = 0, cast(l_suppkey % 110 as int), null) as end_yards", "l_partkey % 8 as points",
    )
    return rounded(aggregates.drives(rows), "quality_rate", "tempo", "points_per_opportunity", "available_yards")


@query(f"""with s as (select home as team, sum(home_score) as yards, sum(away_score) as py, count(*) * 3 as att, sum(home_score % 17) as ry, sum(away_score % 3) as ru, count(*) as n, sum(home_score % 5) as trips, sum(away_score % 4) as td, sum(home_score % 9) as pen, sum(away_score % 30) as peny, sum(home_score % 3) as sacks, sum(away_score % 2) as hits, sum(home_score % 4) as tfl from games group by 1)
  select team, {st('yards / (att + ru)')} as ypp, {st('py / att')} as ypa, {st('ry / ru')} as ypc, {st('(att + ru) / n')} as pace, {st('case when trips > 0 then td / trips else 0 end')} as red_zone_rate, {st('pen / n')} as penalties_per_game, {st('peny / n')} as penalty_yards_per_game, {st('(sacks + hits) / (sacks + hits + tfl)')} as pressure_rate, {st('(sacks + tfl) / (sacks + tfl + 100)')} as havoc_rate,
  {st(clip('0.14 * yards / (att + ru)', '0.3', '0.8'))} as points_per_play from s""")
def team_rates(spark, d):
    total = lambda x, name: F.sum(F.expr(x)).alias(name)
    s = games(spark, d).groupBy(F.col("home").alias("team")).agg(
        total("home_score", "yards"), total("away_score", "py"), (F.count("*") * 3).alias("att"), total("home_score % 17", "ry"), total("away_score % 3", "ru"), F.count("*").alias("n"), total("home_score % 5", "trips"), total("away_score % 4", "td"),
        total("home_score % 9", "pen"), total("away_score % 30", "peny"), total("home_score % 3", "sacks"), total("away_score % 2", "hits"), total("home_score % 4", "tfl"), F.lit(0).alias("none"),
    )
    rates = numbers.derived_rates("yards", "py", "att", "ry", "ru", "n") | numbers.provider_rates({"trips": "trips", "touchdowns": "td", "penalties": "pen", "penalty_yards": "peny", "sacks": "sacks", "hits": "hits", "tfl": "tfl", "interceptions": "none", "fumbles": "none", "games": "n"})
    s = s.withColumns(rates).withColumn("points_per_play", numbers.points_per_play(F.lit(None).cast(D), "ypp"))
    return rounded(s.select("team", *rates, "points_per_play"), *rates, "points_per_play")


#: Bets of all three markets on games, some with a close of their own.
MARKETS = """b as (select l_orderkey as game, l_linenumber as n, l_partkey as part, case l_linenumber % 3 when 0 then 'spread' when 1 then 'total' else 'moneyline' end as market, case when l_linenumber % 3 = 1 then case when l_suppkey % 2 = 0 then 'over' else 'under' end else case when l_suppkey % 2 = 0 then 'home' else 'away' end end as side,
  cast(case l_linenumber % 3 when 0 then l_partkey % 40 - 20 when 1 then 30 + l_partkey % 40 else case when l_partkey % 2 = 0 then 100 + l_partkey % 200 else -100 - l_partkey % 200 end end as double) as model, cast(case when l_linenumber = 4 then l_suppkey % 60 + 5 when l_linenumber % 3 = 2 then case when l_suppkey % 3 = 0 then 100 + l_suppkey % 90 else -100 - l_suppkey % 90 end end as double) as close, l_extendedprice as stake from lineitem),
  c as (select game, 'spread' as market, cast(home - away as double) as filled from games union all select game, 'total', cast(home + away as double) from games where game % 3 <> 0),
  j as (select b.game, n, part, market, side, model, coalesce(close, filled) as close, stake, home_score - away_score as margin, home_score + away_score as points from b left join games using (game) left join c using (game, market)),
  o as (select *, case when side = 'home' then margin else -margin end as own from j),
  r as (select *, case when close is null or margin is null then null when market = 'spread' then case when abs(own - close) < 0.5 then 'push' when own > close then 'win' else 'loss' end when market = 'total' then case when abs(points - close) < 0.5 then 'push' when (points > close) = (side = 'over') then 'win' else 'loss' end else case when own > 0 then 'win' when own < 0 then 'loss' else 'push' end end as result from o),
  gr as (select *, case result when 'win' then stake * case when market = 'moneyline' then case when model > 0 then model / 100 else 100 / -model end else 0.909 end when 'loss' then -stake when 'push' then 0.0 end as pnl,
  case when result is null then null when market = 'moneyline' then case when model > 0 then 100 / (model + 100) else model / (model - 100) end - case when close > 0 then 100 / (close + 100) else close / (close - 100) end when side in ('home', 'over') then model - close else close - model end as clv from r)"""


def _market_bets(spark, d):
    k = "l_linenumber % 3"
    b = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as game", "l_linenumber as n", "l_partkey as part", f"case {k} when 0 then 'spread' when 1 then 'total' else 'moneyline' end as market", f"if({k} = 1, if(l_suppkey % 2 = 0, 'over', 'under'), if(l_suppkey % 2 = 0, 'home', 'away')) as side",
        f"cast(case {k} when 0 then l_partkey % 40 - 20 when 1 then 30 + l_partkey % 40 else if(l_partkey % 2 = 0, 100 + l_partkey % 200, -100 - l_partkey % 200) end as double) as model",
        f"cast(case when l_linenumber = 4 then l_suppkey % 60 + 5 when {k} = 2 then if(l_suppkey % 3 = 0, 100 + l_suppkey % 90, -100 - l_suppkey % 90) end as double) as close", "l_extendedprice as stake",
    )
    g = games(spark, d)
    closes = g.select("game", F.lit("spread").alias("market"), (F.col("home") - F.col("away")).cast(D).alias("close")).unionByName(g.where("game % 3 <> 0").select("game", F.lit("total").alias("market"), (F.col("home") + F.col("away")).cast(D).alias("close")))
    return slate.graded(b, g, closes)


@query(f"with {MARKETS} select game, n, market, side, close, result, {st('pnl', 2)} as pnl, {st('clv')} as clv from gr")
def graded_markets(spark, d):
    g = _market_bets(spark, d)
    return g.select("game", "n", "market", "side", "close", "result", numbers.stable("pnl", 2).alias("pnl"), numbers.stable("clv").alias("clv"))


LINES = "cur as (select game, market, max(close) as current, min(side) as current_book from gr where n <= 3 group by 1, 2), ca as (select gr.*, current, current_book from gr left join cur using (game, market))"


@query(f"with {MARKETS}, {LINES} select game, n, market, current, current_book, {st('coalesce(case when current is not null then case when market = ' + chr(39) + 'moneyline' + chr(39) + ' then case when model > 0 then 100 / (model + 100) else model / (model - 100) end - case when close > 0 then 100 / (close + 100) else close / (close - 100) end else model - close end end, clv)')} as clv, {st('model - current')} as edge_now from ca")
def my_card(spark, d):
    g = _market_bets(spark, d)
    lines = g.where("n <= 3").groupBy("game", "market").agg(F.max("close").alias("current"), F.min("side").alias("current_book"))
    return rounded(slate.card(g, lines), "clv", "edge_now").select("game", "n", "market", "current", "current_book", "clv", "edge_now")


@query(f"with {MARKETS} select count(*) as total, count(*) filter (where result is null) as pending, count(result) as graded, {st('sum(stake)', 1)} as stake, {st('sum(case when result is not null then pnl else 0 end)', 1)} as pnl, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes, {st('count(*) filter (where result = ' + chr(39) + 'win' + chr(39) + ') / count(result)')} as hit_rate from gr")
def my_card_summary(spark, d):
    s = slate.card_summary(_market_bets(spark, d))
    return s.withColumns({"stake": numbers.stable("stake", 1), "pnl": numbers.stable("pnl", 1), "hit_rate": numbers.stable("hit_rate")})


@query(f"""with {MARKETS}, e as (select market, game, n, part, sum(coalesce(case result when 'win' then stake * 0.909 when 'loss' then -stake else 0 end, 0)) over (partition by market order by game, n, part rows unbounded preceding) as equity, row_number() over (partition by market order by game, n, part) as k from gr),
  p as (select *, greatest(0.0, max(equity) over (partition by market order by game, n, part rows unbounded preceding)) as peak from e) select market, count(*) as n, {st('max(peak - equity)', 0)} as max_drawdown, {st('max(equity)', 0)} as best, max(k) as last from p group by 1""")
def backtest_markets(spark, d):
    run = ops.backtest(_market_bets(spark, d), ["market"], ["game", "n", "part"])
    out = run.groupBy("market").agg(F.count("*").alias("n"), F.max("drawdown").alias("max_drawdown"), F.max("equity").alias("best"), F.max("x").cast("bigint").alias("last"))
    return out.withColumns({c: numbers.stable(c, 0) for c in ("max_drawdown", "best")})


@query("with g as (select game, cast(home_score - away_score as double) as model, cast(away - home as double) as market from games ) select game, abs(model - market) as edge, case when model > market then 'home' else 'away' end as side, 100.0::double as stake, 'official' as strategy from g where abs(model - market) >= 0.1")
def generated_bets(spark, d):
    g = games(spark, d).select("game", (F.col("home_score") - F.col("away_score")).cast(D).alias("model"), (F.col("away") - F.col("home")).cast(D).alias("market"))
    return ops.generated(g, "model", "market", "official").select("game", "edge", "side", "stake", "strategy")


RATINGS = f"ra as (select team, {st('avg(m)')} as rating, {st('avg(pf) / 30')} as pace from (select home as team, home_score - away_score as m, home_score as pf from games union all select away, away_score - home_score, away_score from games ) group by 1)"


def _ratings(spark, d):
    from rookery.operators.ratings import team_games

    return rounded(team_games(games(spark, d)).groupBy("team").agg(F.avg("margin").alias("rating"), (F.avg("pf") / 30).alias("pace")), "rating", "pace")


SLATE = f"""{RATINGS}, fq as (select game, book, line, row_number() over (partition by game, book order by ts, quote_id) as n from quotes ), li as (select game, {st('median(line) / 4 - 10')} as market_spread, {st('avg(line)')} as market_total, cast(-110 - game % 90 as double) as home_price from fq where n = 1 group by game),
  sg as (select kick_id as game, game as user_game, game % 40 as home, (game * 7 + 3) % 40 as away, kick_id % 9 = 0 as neutral, kick as date, case kick_id % 4 when 0 then 'strong' when 1 then 'weak' when 2 then 'hybrid_only' end as conflict from kicks ),
  sl as (select sg.*, h.rating as hr, a.rating as ar, market_spread, market_total, home_price, h.rating - a.rating + case when neutral then 0 else 2.0 end as hma, 45.0 + 0.5 * abs(h.rating - a.rating) as tot from sg left join ra h on h.team = home left join ra a on a.team = away left join li on li.game = user_game),
  se as (select *, hma - market_spread as spread_edge, tot - market_total as total_edge, greatest(abs(hma - market_spread), abs(tot - market_total)) as me from sl),
  sm as (select *, (greatest(0.01, least(0.99, 1 / (1 + power(10.0, -hma / 14.5)))) - home_price / (home_price - 100)) * 100 as value from se),
  sn as (select * exclude (me), case when abs(hma) <= 24 and value > 1 then value end as mv, greatest(me, case when abs(hma) <= 24 and value > 1 then value end) as me from sm),
  sv as (select *, case when abs(spread_edge) >= 4 or abs(total_edge) >= 4 or mv >= 10 then 'A' when abs(spread_edge) >= 3 or abs(total_edge) >= 3 or mv >= 5 then 'B' when abs(spread_edge) >= 0.1 or abs(total_edge) >= 0.1 or mv >= 1 then 'C' end as t from sn)"""


def _slate(spark, d):
    first = quotes(spark, d).groupBy("game", "book").agg(F.min_by("line", F.struct("ts", "quote_id")).alias("line"))
    lines = first.groupBy("game").agg((F.median("line") / 4 - 10).alias("market_spread"), F.avg("line").alias("market_total"))
    lines = rounded(lines, "market_spread", "market_total").withColumn("home_price", (-110 - F.col("game") % 90).cast(D))
    k = kicks(spark, d)
    tag = F.when(F.col("kick_id") % 4 == 0, "strong").when(F.col("kick_id") % 4 == 1, "weak").when(F.col("kick_id") % 4 == 2, "hybrid_only")
    g = k.select(F.col("kick_id").alias("game"), F.col("game").alias("user_game"), (F.col("game") % 40).alias("home"), ((F.col("game") * 7 + 3) % 40).alias("away"), (F.col("kick_id") % 9 == 0).alias("neutral"), F.col("kick").alias("date"), tag.alias("conflict"))
    return slate.built(g, _ratings(spark, d), lines.withColumnRenamed("game", "user_game"), on="user_game")


@query(f"""with {SLATE} select game, home, away, {st('hma')} as implied_hma, {st('tot')} as implied_total, {st('spread_edge')} as spread_edge, {st('total_edge')} as total_edge, case when spread_edge >= 0.1 then 'home' when spread_edge <= -0.1 then 'away' end as spread_pick, case when total_edge >= 2.5 then 'over' when total_edge <= -2.5 then 'under' end as total_pick,
  t as confidence, {st('me', 2)} as max_edge, {st('value', 2)} as home_value, case when hma is null then 'no spread' when abs(hma) > 24 then 'spread over 24' when abs(market_spread) >= 21 then 'favourite of 21 or more' when value is null or value <= 1 then 'no value' end as withheld,
  case when conflict = 'strong' then case when abs(spread_edge) >= 4 then 'super_tier_a' when abs(spread_edge) >= 3 then 'tier_a' when abs(spread_edge) >= 2 then 'tier_b' end when conflict is null then case when abs(spread_edge) >= 3 then 'tier_a' when abs(spread_edge) >= 2 then 'tier_b' end end as bucket from sv""")
def slate_games(spark, d):
    s = rounded(_slate(spark, d), "implied_hma", "implied_total", "spread_edge", "total_edge").withColumns({c: numbers.stable(c, 2) for c in ("home_value", "max_edge")})
    return s.select("game", "home", "away", "implied_hma", "implied_total", "spread_edge", "total_edge", "spread_pick", "total_pick", "confidence", "max_edge", "home_value", "withheld", "bucket")


@query(f"with {SLATE} select cast(date as date) as day, list(game order by coalesce(me, '-infinity'::double) desc, game) as games, cast(count(*) as integer) as n from sv group by 1")
def slate_by_date(spark, d):
    return slate.by_date(_slate(spark, d))


@query(f"""with {SLATE}, f as (select game, case when market_spread <> 0 then -abs(market_spread) end as fl, case when market_spread <> 0 then abs(market_spread) end as dl, -abs(hma) as ml, case when hma > 0 then home when hma < 0 then away end as mf, case when game % 10 = 0 then 1.0 else 0.0 end as off from sv)
  select 'line_signs' as assertion, count(*) filter (where not ((fl is null and dl is null) or coalesce(fl < 0 and dl > 0, false))) as failures from f union all select 'edge_identity', count(*) filter (where fl is not null and off > 0) from f union all select 'model_favourite', count(*) filter (where not coalesce(case when mf is null then ml = 0 else true end, false)) from f""")
def response_assertions(spark, d):
    s = _slate(spark, d)
    fav = F.when(F.col("market_spread") != 0, -F.abs("market_spread"))
    line, own = -F.abs("implied_hma"), F.when(F.col("implied_hma") > 0, F.col("home")).when(F.col("implied_hma") < 0, F.col("away"))
    off = F.when(F.col("game") % 10 == 0, 1.0).otherwise(0.0)
    return slate.asserted(s.select("game", fav.alias("favourite_line"), (-fav).alias("dog_line"), (line - fav + off).alias("edge"), line.alias("model_line"), own.alias("model_favourite"), own.alias("converted_favourite")))


@query(f"""with {RATINGS}, l as (select g.game, coalesce(h.rating, 0) - coalesce(a.rating, 0) + case when g.game % 9 = 0 then 0 else 2.0 end as spread, 45 + 2 * (coalesce(h.pace, 0) + coalesce(a.pace, 0)) as total, coalesce(case when g.game % 2 = 0 then cast(home - away as double) end, 0) as ms, coalesce(case when g.game % 2 = 0 then cast(home + away as double) end, 45) as mt from games g left join ra h on h.team = home left join ra a on a.team = away)
  select game, {st('spread')} as implied_spread, {st('total')} as implied_total, case when greatest(abs(spread - ms), abs(total - mt)) >= 4 then 'A' when greatest(abs(spread - ms), abs(total - mt)) >= 3 then 'B' else 'C' end as confidence from l""")
def seed_lines(spark, d):
    g = games(spark, d)
    markets = g.where("game % 2 = 0").select("game", (F.col("home") - F.col("away")).cast(D).alias("market_spread"), (F.col("home") + F.col("away")).cast(D).alias("market_total"))
    out = slate.seed_lines(g.withColumn("neutral", F.col("game") % 9 == 0), _ratings(spark, d), markets)
    return rounded(out.select("game", "implied_spread", "implied_total", "confidence"), "implied_spread", "implied_total")


@query(f"with {RATINGS} select g.game, {st('-0.5 + 2.2 * coalesce((0.05 * (h.rating - a.rating) / 3.5 + 0.95 * (h.pace - a.pace) / 8.25) * 3.5, h.rating - a.rating) + 0.3 * 2.0')} as spread, cast(case home % 7 when 0 then 5.0 when 1 then 2.0 when 2 then -2.0 when 3 then -3.5 when 4 then -6.0 else -5.0 end as double) as conference from games g join (select team, rating, case when team % 3 <> 0 then pace end as pace from ra) h on h.team = home join (select team, rating, case when team % 3 <> 0 then pace end as pace from ra) a on a.team = away")
def blended_spreads(spark, d):
    r = _ratings(spark, d).withColumn("pace", F.when(F.col("team") % 3 != 0, F.col("pace")))
    side = lambda s: r.select(F.col("team").alias(s), F.col("rating").alias(f"{s}_r"), F.col("pace").alias(f"{s}_p"))
    g = games(spark, d).join(side("home"), "home").join(side("away"), "away")
    diff = slate.blended_difference(F.col("home_r"), F.col("away_r"), F.col("home_p"), F.col("away_p"), 0.05, 3.5, 8.25)
    name = F.element_at(F.array(*map(F.lit, ("SEC", "ACC", "AAC", "MAC", "FCS", "Unknown", "Elsewhere"))), (F.col("home") % 7 + 1).cast("int"))
    return g.select("game", numbers.stable(slate.core_spread(diff, F.lit(2.0), -0.5, 2.2, 0.3)).alias("spread"), numbers.conference_adjustment(name).alias("conference"))


@query("select game, week, part, stake from bets order by stake desc, game, week, part limit 50 offset 100")
def page_of_bets(spark, d):
    return slate.page(bets(spark, d).select("game", "week", "part", "stake"), [F.desc("stake"), F.col("game"), F.col("week"), F.col("part")], 50, 100)


@query("select game, home_score - away_score as residual from games order by abs(home_score - away_score) desc, game limit 20")
def tail_outliers(spark, d):
    return slate.outliers(games(spark, d).select("game", (F.col("home_score") - F.col("away_score")).alias("residual")), "residual", "game")


PAIRS = "select a.n_nationkey * 25 + b.n_nationkey as game, a.n_name as away, b.n_name as home from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey"


@query(f"with g as ({PAIRS}), s as (select *, case when (contains(lower(away), 'nation_1') and contains(lower(home), 'nation_2')) or (contains(lower(away), 'nation_2') and contains(lower(home), 'nation_1')) then 200 else 0 end as score from g) select game, away, home, cast(score as integer) as score from s where score > 0 order by score desc, game limit 8")
def searched_games(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    a, b = n.toDF("ak", "region", "away"), n.toDF("bk", "region", "home")
    return slate.search(a.join(b, "region").where("ak <> bk").select((F.col("ak") * 25 + F.col("bk")).alias("game"), "away", "home"), "Nation_1 @ nation_2")


@query("select game, book, min(ts) as window_start, max(ts) as window_end from quotes group by 1, 2")
def quote_spans(spark, d):
    return slate.span(quotes(spark, d), ["game", "book"], "ts")


@query("with a as (select distinct home as team_id from games ), b as (select distinct away as team_id from games where away < 30) select 'union' as kind, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b)")
def id_sets(spark, d):
    g = games(spark, d)
    a, b = g.select(F.col("home").alias("team_id")), g.where("away < 30").select(F.col("away").alias("team_id"))
    parts = [("union", resolve.every_id(a, b)), ("intersect", resolve.shared(a, b)), ("except", resolve.missing(a, b))]
    found = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("with o as (select game, row_number() over (order by date, game) - 1 as k, count(*) over () as n from games ) select game, cast(least(4, k // greatest(1, n // 5)) as integer) as fold from o")
def contiguous_folds(spark, d):
    return slate.contiguous_folds(games(spark, d).select("game", "date"), ["date", "game"]).select("game", "fold")


@query(f"with k as (select kick_id, game, kick from kicks ), w as (select kick_id, count(line) as n, {st('avg(line)')} as mean, min(ts) as window_start, max(ts) as window_end from k join quotes q using (game) where q.ts between k.kick - interval 5 minute and k.kick + interval 600 minute group by 1) select * from w")
def late_window_lines(spark, d):
    found = asof.in_window(kicks(spark, d), quotes(spark, d), "game", "kick", "ts", 5, 600)
    return rounded(found.groupBy("kick_id").agg(F.count("line").alias("n"), F.avg("line").alias("mean"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end")), "mean")
