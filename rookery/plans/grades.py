"""Queries on unit grades, talent, moneyline gates, transfers, small rating rules, labels and fits of two predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import frames, numbers, text, times
from rookery.operators import aggregates, bets as ops, linear, ratings
from rookery.plans.registry import games, query, quotes, rounded, st
from rookery.plans.teams import TG, TS, _seasons, _sides, z
from rookery.session import table


@query(f"""with {TG}, r as (select game, team, opponent, pf * 0.1 as o1, pa * 0.2 as d1, pf * 0.7 as o7, pa * 0.8 as d7 from tg)
  select r.game, r.team, {st('r.o1 - x.d1')} as off_adj_epa, {st('-(r.d1 + x.o1)')} as def_adj_epa, {st('(r.o1 - x.d1) + (r.d1 + x.o1)')} as edge_epa, {st('(r.o7 - x.d7) + (r.d7 + x.o7)')} as edge_field
  from r left join r x on r.game = x.game and r.opponent = x.team""")
def adjusted_nets(spark, d):
    g = _sides(spark, d)
    g = g.select("game", "team", "opponent", *[(F.col(c) * (i + k) / 10.0).alias(f"{s}_{m}") for i, m in enumerate(ratings.NETS) for s, c, k in (("off", "pf", 1), ("def", "pa", 2))])
    names = ("off_adj_epa", "def_adj_epa", "edge_epa", "edge_field")
    return rounded(ratings.adjusted_nets(g).select("game", "team", *names), *names)


@query(f"""with {TS}, s as (select team, season, case when team % 5 <> 0 then pf end as pf, pa, n from ts), g as (select team, season, {z('pf')} as zp, {z('pa')} as za, {z('n')} as zn from s)
  select team, season, {st('(coalesce(zp * 0.6, 0) + za * -0.4) / (case when zp is not null then 0.6 else 0 end + 0.4)')} as run, {st('zn')} as pass, {st('zp')} as explosive from g""")
def unit_grades(spark, d):
    s = _seasons(spark, d).withColumn("pf", F.when(F.col("team") % 5 != 0, F.col("pf")))
    names = ("run", "pass", "explosive")
    g = ratings.unit_grades(s, ["season"], {"run": {"pf": 0.6, "pa": -0.4}, "pass": {"n": 1.0}, "explosive": {"pf": 1.0}})
    return rounded(g.select("team", "season", *names), *names)


_Z = lambda x: f"({x} - avg({x}) over (partition by season)) / coalesce(nullif(stddev_pop({x}) over (partition by season), 0), 1)"


def _blend(pair) -> str:
    """The SQL of the mean of what is known, else 0."""
    terms = [f"{sign} * ({_Z(c)})" for c, sign in pair]
    top = " + ".join(f"coalesce({t}, 0)" for t in terms)
    bottom = " + ".join(f"case when {t} is not null then 1 else 0 end" for t in terms)
    return st(f"coalesce(({top}) / nullif({bottom}, 0), 0)")


#: A game's figures from its scores; some are missing, some teams have no games of a kind.
_GAME = {"line_yards_off": "case when team % 7 <> 0 then pf * 0.1e0 end", "iso_ppp_off": "case when pf > 5 then pf * 0.03e0 end", "iso_ppp_def": "pa * 0.02e0", "pass_sr": "case when team % 9 <> 0 then pf / 60.0e0 end", "def_sr": "pa / 70.0e0", "run_epa": "case when team % 5 <> 0 and team % 7 <> 0 then (pf - pa) * 0.01e0 end", "pass_epa": "case when team % 4 <> 0 then (pf - 2 * pa) * 0.02e0 end"}
_PPA = {"ppa_off": "pf * 0.015e0", "ppa_def": "case when team % 11 <> 0 then pa * 0.015e0 end"}


@query(f"""with {TG}, e as (select team, season, avg(line_yards_off) as line_yards_off, avg(iso_ppp_off) as iso_ppp_off, avg(iso_ppp_def) as iso_ppp_def, avg(pass_sr) as pass_sr_off, avg(def_sr) as pass_sr_def, avg(run_epa) as run_epa, avg(pass_epa) as pass_epa from (select team, season, {', '.join(f'{x} as {c}' for c, x in _GAME.items())} from tg) group by 1, 2),
  a as (select team, season, avg(ppa_off) as ppa_off, avg(ppa_def) as ppa_def from (select team, season, {', '.join(f'{x} as {c}' for c, x in _PPA.items())} from tg where team % 13 <> 0) group by 1, 2),
  s as (select team, season, count(*) / 10.0 as stuff_rate, case when team % 3 <> 0 then sum(pf) / 1000.0 end as havoc_off, case when team % 10 <> 0 then sum(pa) / 1000.0 end as havoc_def from tg where team % 8 <> 0 group by 1, 2),
  i as (select e.*, coalesce(run_epa, ppa_off) as rush_ppa_off, coalesce(pass_epa, ppa_off) as pass_ppa_off, ppa_def as rush_ppa_def, ppa_def as pass_ppa_def, stuff_rate, havoc_off, havoc_def from e left join a using (team, season) left join s using (team, season))
  select team, season, {', '.join(f'{_blend(pair)} as {name}' for name, pair in ratings.SEVEN.items())} from i""")
def seven_grades(spark, d):
    """The seven unit grades of each team's season."""
    t = _sides(spark, d)
    made = lambda df, figures: df.select("team", "season", *[F.expr(x).cast("double").alias(c) for c, x in figures.items()])
    season = t.where("team % 8 <> 0").groupBy("team", "season").agg((F.count("*") / 10.0).alias("stuff_rate"), (F.sum("pf") / 1000.0).alias("o"), (F.sum("pa") / 1000.0).alias("d"))
    season = season.select("team", "season", "stuff_rate", F.expr("case when team % 3 <> 0 then o end").alias("havoc_off"), F.expr("case when team % 10 <> 0 then d end").alias("havoc_def"))
    inputs = ratings.unit_inputs(t, made(t, _GAME), made(t.where("team % 13 <> 0"), _PPA), season)
    return rounded(ratings.seven_grades(inputs, ["season"]).select("team", "season", *ratings.SEVEN), *ratings.SEVEN)


_UNITS = {"run": (0.4, 0.01), "pass": (0.4, 0.02), "explosive": (0.2, 0.03)}
_NET = lambda us, them: " + ".join(f"{w} * ({us} * {k} - {them} * 0.015)" for w, k in _UNITS.values())
_UNIT_HMA = f"(({_NET('home_score', 'home_score')}) - ({_NET('away_score', 'away_score * 2')})) * 9 + case when game % 10 = 0 then 0 else 2.5 end"


@query(f"with u as (select game, home_score - away_score as core, {_UNIT_HMA} as unit_hma from games ) select game, {st('unit_hma')} as unit_hma, {st('0.7 * core + 0.3 * unit_hma')} as hybrid from u")
def unit_spreads(spark, d):
    home, away = F.col("home_score"), F.col("away_score")
    units = {f"{who}_off_{u}": score * k for who, score in (("home", home), ("away", away)) for u, (_, k) in _UNITS.items()}
    units |= {f"{who}_def_{u}": score * 0.015 for who, score in (("home", away * 2), ("away", home)) for u in _UNITS}
    g = games(spark, d).withColumns(units | {"neutral": F.col("game") % 10 == 0, "core": home - away})
    g = ratings.unit_spread(g)
    return rounded(g.select("game", "unit_hma", ratings.hybrid("core", "unit_hma").alias("hybrid")), "unit_hma", "hybrid")


@query(f"""with {TS}, t as (select range as team from range(45)), f as (select t.team, a.pf as a, b.pf as b, c.pf as c from t left join ts a on a.team = t.team and a.season = 1997 and a.team % 4 <> 0
  left join ts b on b.team = t.team and b.season = 1996 and b.team % 3 <> 0 left join ts c on c.team = t.team and c.season = 1995 and c.team % 5 <> 0)
  select team, coalesce(a, b, c) as pf, case when a is not null then 'game' when b is not null then 'season' when c is not null then 'baseline' else 'missing' end as source from f""")
def tiered_features(spark, d):
    s = _seasons(spark, d)
    tiers = [s.where(f"season = {year} and team % {k} <> 0") for year, k in ((1997, 4), (1996, 3), (1995, 5))]
    return ratings.tiered_features(spark.range(45).withColumnRenamed("id", "team"), *tiers, "pf")


#: Conferences of the teams, and talent by team and season, of which some have none; 1995 has too few in the low conferences.
_CONFERENCE = lambda n: f"case {n} % 8 when 0 then 'American Athletic' when 1 then 'SEC' when 2 then 'Sun Belt' when 3 then 'Big Ten' when 4 then 'Mid-American' when 5 then 'ACC' when 6 then 'Mountain West' else 'Big 12' end"


@query(f"""with {TS}, ta as (select team, season, pf as talent from ts where team % 6 <> 0 and not (season = 1995 and team > 20)), lo as (select * from ta where {_CONFERENCE('team')} in ('American Athletic', 'Sun Belt', 'Mid-American', 'Mountain West')),
  p as (select season, list_sort(list(talent)) as l, count(*) as n from lo group by 1 having count(*) >= 10), f as (select season, least(greatest(l[cast(floor(n * 0.1) as bigint) + 1], l[cast(floor(n * 0.05) as bigint) + 1]), l[cast(floor(n * 0.25) as bigint) + 1]) as fill from p), s as (select season, stddev_pop(talent) as sd from ta group by 1),
  g as (select game, coalesce(h.talent, fill) - coalesce(a.talent, fill) as gap, sd, h.talent is null as home_filled, a.talent is null as away_filled from games g left join ta h on h.team = home and h.season = g.season left join ta a on a.team = away and a.season = g.season left join s on s.season = g.season left join f on f.season = g.season)
  select game, {st('gap')} as gap, {st('case when sd < 0.1 then 0 else gap / sd end')} as gap_z, home_filled, away_filled from g""")
def talent_gaps(spark, d):
    s = _seasons(spark, d).where("team % 6 <> 0 and not (season = 1995 and team > 20)").select("team", "season", F.col("pf").alias("talent"))
    teams = _sides(spark, d).select("team").distinct().withColumn("conference", F.expr(_CONFERENCE("team")))
    return rounded(ratings.talent_gap(games(spark, d), s, teams), "gap", "gap_z").select("game", "gap", "gap_z", "home_filled", "away_filled")


_IMPLIED = "case when {0} < 0 then -{0} / (100.0 - {0}) else 100.0 / ({0} + 100.0) end"


@query(f"""with m as (select game, (home_score + 20) / 100.0 as p, case when away_score % 2 = 0 then -(110 + away_score * 5) else 100 + away_score * 5 end as price, case when game % 13 <> 0 then home_score - away_score end as spread, away_score - 20 as market from games ),
  v as (select *, (p - {_IMPLIED.format('price')}) * 100 as h, (1 - p - {_IMPLIED.format('(-price)')}) * 100 as a from m)
  select game, {st('h')} as home_value, case when h > 1 and h >= a then 'home' when a > 1 then 'away' end as side,
  case when spread is null then 'no spread' when abs(spread) > 24 then 'spread over 24' when abs(market) >= 21 then 'favourite of 21 or more' when h <= 1 then 'no value' end as withheld,
  abs(market) >= 21 and h > 0 as blocked, {st('least(abs(h) / 10 * 0.25, 0.5)')} as share from v""")
def moneyline_gates(spark, d):
    home, away = F.col("home_score"), F.col("away_score")
    price = F.when(away % 2 == 0, -(110 + away * 5)).otherwise(100 + away * 5)
    m = games(spark, d).select("game", ((home + 20) / 100.0).alias("p"), price.alias("price"), F.when(F.col("game") % 13 != 0, home - away).alias("spread"), (away - 20).alias("market"))
    m = m.withColumns({"home_value": numbers.moneyline_value("p", "price"), "away_value": numbers.moneyline_value(1 - F.col("p"), -F.col("price"))})
    out = m.select(
        "game", "home_value", numbers.moneyline_side("home_value", "away_value").alias("side"), numbers.moneyline_gate("spread", "market", "home_value").alias("withheld"),
        numbers.blocked_underdog("market", "home_value").alias("blocked"), numbers.bankroll_share("home_value", 0.5).alias("share"),
    )
    return rounded(out, "home_value", "share")


@query(f"""with r as (select game, home_score as h, away_score as a from games )
  select game, {st('0.7 * h + 0.3 * a')} as shrunk, {st('greatest(0.0, 1 - (h % 12) / 8.0)')} as decayed, {st('case when game % 9 = 0 then 0 else greatest(1.0, least(5.0, 2.0 + case when a % 5 = 0 then 0 else a / 10.0 - 2 end)) end')} as hfa,
  {st('case when h % 20 + 1 < 10 then 60.0 / (h % 20 + 1) else h % 20 + 1 end')} as plays, {st('(5 * (h % 3) + 4 * (h % 4) + 3 * (h % 5)) / (case when a % 6 = 0 then null else a % 6 end)')} as commits,
  {st('case when h > 15 then greatest(-3.0, -0.05 * (h - 15)) else 0 end + case when a * 2 > 50 then -0.2 else 0 end')} as weather, abs(h * 2 - a) <= 50 as spread_fits, h + a between 20 and 90 as total_fits, h + a between 15 and 120 as result_fits,
  abs(h + a - (h + a + a % 2)) <= 0.5 and abs(h - a - (h - a + h % 2)) <= 0.5 as agrees from r""")
def rating_rules(spark, d):
    h, a, points = F.col("home_score"), F.col("away_score"), F.col("home_score") + F.col("away_score")
    out = games(spark, d).select(
        "game", numbers.shrink("home_score", "away_score", F.lit(0.3)).alias("shrunk"), numbers.decay(h % 12).alias("decayed"),
        numbers.home_field(F.col("game") % 9 == 0, F.lit(2.0), F.when(a % 5 != 0, a / 10.0 - 2)).alias("hfa"), numbers.plays_per_game(h % 20 + 1).alias("plays"),
        numbers.commits_signal(h % 3, h % 4, h % 5, a % 6).alias("commits"), numbers.weather_penalty("home_score", a * 2).alias("weather"), numbers.plausible_spread(h * 2 - a).alias("spread_fits"),
        numbers.plausible_total(points).alias("total_fits"), numbers.plausible_total(points, True).alias("result_fits"), frames.consistent("home_score", "away_score", points + a % 2, h - a + h % 2).alias("agrees"),
    )
    return rounded(out, "shrunk", "decayed", "hfa", "plays", "commits", "weather")


@query("""with m as (select case when game % 4 <> 0 then home end as destination, away as origin from games ), e as (select destination as team, 1 as i, 0 as o from m union all select origin, 0, 1 from m)
  select team, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from e where team is not null group by 1""")
def transfer_counts(spark, d):
    return aggregates.transfers(games(spark, d).select(F.when(F.col("game") % 4 != 0, F.col("home")).alias("destination"), F.col("away").alias("origin")))


@query("""with b as (select game, case when game % 7 <> 0 then home_score / 60.0 end as continuity, case when game % 11 <> 0 then away_score - 20 end as close from games )
  select game from b where not coalesce(continuity < 0.6 and close >= 0, false)""")
def strong_underdogs(spark, d):
    b = games(spark, d).select("game", F.when(F.col("game") % 7 != 0, F.col("home_score") / 60.0).alias("continuity"), F.when(F.col("game") % 11 != 0, F.col("away_score") - 20).alias("close"))
    return ops.without_weak_underdogs(b).select("game")


_SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""with n as (select n_nationkey as id, n_name || case n_nationkey % 3 when 0 then ' College' else '' end as name, case n_nationkey % 6 when 0 then '12.5' when 1 then 'x' when 2 then '' when 3 then 'NaN' when 4 then '1e3' else cast(n_nationkey as varchar) end as raw from nation),
  v as (select *, try_cast(raw as double) as v from n) select id, {_SLUG} in ('france', 'japan') or (regexp_matches({_SLUG}, '-college$') and {_SLUG} <> 'algeria-college') as denied, case when isfinite(v) then v end as number from v""")
def name_rules(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k % 6 == 0, "12.5").when(k % 6 == 1, "x").when(k % 6 == 2, "").when(k % 6 == 3, "NaN").when(k % 6 == 4, "1e3").otherwise(k.cast("string"))
    name = F.concat("n_name", F.when(k % 3 == 0, " College").otherwise(""))
    return table(spark, d, "nation").select(k.alias("id"), text.denied(name, ("france", "japan"), ("algeria-college",)).alias("denied"), text.safe_number(raw).alias("number"))


@query("""select quote_id, strftime(ts at time zone 'UTC' at time zone 'America/Chicago', '%a %b %-d, %-I:%M %p') as label, strftime((ts at time zone 'America/Chicago') at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as utc from quotes """)
def local_labels(spark, d):
    return quotes(spark, d).select("quote_id", times.local_label(F.col("ts")).alias("label"), times.iso_seconds(times.to_utc(F.col("ts"), "America/Chicago")).alias("utc"))


def _fit(x1: str, x2: str, y: str) -> str:
    """The SQL of a fit of two predictors, by covariances."""
    bottom = f"(var_pop({x1}) * var_pop({x2}) - covar_pop({x1}, {x2}) * covar_pop({x1}, {x2}))"
    one = f"((covar_pop({x1}, {y}) * var_pop({x2}) - covar_pop({x2}, {y}) * covar_pop({x1}, {x2})) / {bottom})"
    two = f"((covar_pop({x2}, {y}) * var_pop({x1}) - covar_pop({x1}, {y}) * covar_pop({x1}, {x2})) / {bottom})"
    level = f"(avg({y}) - {one} * avg({x1}) - {two} * avg({x2}))"
    return f"{st(level)} as intercept, {st(one)} as first, {st(two)} as second, {st(f'({one} * covar_pop({x1}, {y}) + {two} * covar_pop({x2}, {y})) / var_pop({y})')} as r2"


@query(f"""with g as (select season, home_score / 10.0::double as x, away_score / 10.0::double as w, (home_score - away_score + home_score * away_score % 7)::double as y from games )
  select season, 'quadratic' as kind, {_fit('x', 'x * x', 'y')} from g group by season union all select season, 'multiple', {_fit('x', 'w', 'y')} from g group by season""")
def two_predictor_fits(spark, d):
    h, a = F.col("home_score"), F.col("away_score")
    g = games(spark, d).select("season", (h / 10.0).alias("x"), (a / 10.0).alias("w"), (h - a + h * a % 7).cast("double").alias("y"))
    fits = [g.groupBy("season").agg(*f).withColumn("kind", F.lit(kind)) for kind, f in (("quadratic", linear.quadratic("x", "y")), ("multiple", linear.two_predictors(F.col("x"), F.col("w"), F.col("y"))))]
    return rounded(fits[0].unionByName(fits[1]), "intercept", "first", "second", "r2")


_HALF = lambda x: f"(floor(({x}) * 2 + 0.5) / 2)"


@query(f"""with p as (select game, 'T' || home as h, 'T' || away as a, (away_score - home_score) / 4.0::double as model, (away - home) / 2.0::double + 0.25 as market, (home_score + away_score)::double as mt, 46.25 + game % 9 as kt from games ),
  f as (select *, model < 0 as mh, market < 0 as kh, -{_HALF('abs(model)')} as ml, -{_HALF('abs(market)')} as kl from p), e as (select *, case when mh = kh then ml - kl else model - market end as edge, case when kh then h else a end as fav, case when kh then a else h end as dog from f),
  s as (select *, mh <> kh or edge > 0 as ondog from e), t as (select *, case when ondog then dog else fav end as team, case when ondog then -kl else kl end + 0.0 as line from s)
  select game, team, line, team || case when ondog then ' +' else ' ' end || printf('%.1f', line) as label, abs(edge) as edge_pts, case when ondog then abs({_HALF('ml - 0.1')}) when edge < 0 then least(-0.5, {_HALF('ml + 0.1')}) end as bet_to, mh <> kh as disagree,
  case when mt > kt then 'Over' when mt < kt then 'Under' end as total_pick, case when mt <> kt then case when mt > kt then 'Over ' else 'Under ' end || printf('%.1f', {_HALF('kt')}) end as total_label, case when abs(mt - kt) >= 0.1 then case when mt > kt then {_HALF('mt - 0.1')} else {_HALF('mt + 0.1')} end end as total_bet_to from t""")
def pick_cards(spark, d):
    """Spread and total picks against the market, with labels and the line to which to bet."""
    g = games(spark, d)
    p = g.select(
        "game", F.concat(F.lit("T"), F.col("home").cast("string")).alias("h"), F.concat(F.lit("T"), F.col("away").cast("string")).alias("a"), ((F.col("away_score") - F.col("home_score")) / 4.0).alias("model"), ((F.col("away") - F.col("home")) / 2.0 + 0.25).alias("market"),
        (F.col("home_score") + F.col("away_score")).cast("double").alias("mt"), (F.lit(46.25) + F.col("game") % 9).alias("kt"),
    )
    cards = p.select("game", frames.spread_card("model", "market", frames.value_over_market("model", "market"), F.col("h"), F.col("a")).alias("s"), frames.total_card("mt", "kt").alias("t"))
    return cards.select("game", "s.*", F.col("t.pick").alias("total_pick"), F.col("t.label").alias("total_label"), F.col("t.bet_to").alias("total_bet_to"))
