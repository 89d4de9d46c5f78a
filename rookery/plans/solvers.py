"""Queries on rating systems over the graph of games, with oracles that iterate on lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.operators import graphs, linear, ratings, training
from rookery.plans.registry import games, query, rounded, st
from rookery.plans.teams import TG


def _system(source: str, b: str, w: str = "1.0", c: str = "0.0") -> str:
    """CTEs ``sys``: one row of the teams in order, sums ``b`` and ``c``, degrees ``d`` and a list of each team's weights to all others ``m``. ``source`` has team and opponent."""
    return f"""names as (select team, row_number() over (order by team) as i from (select distinct team from {source})),
  pairs as (select team, opponent, sum({w})::double as w from {source} group by 1, 2), sides as (select team, sum({w})::double as d, sum({b})::double as b, sum({c})::double as c from {source} group by 1),
  lines as (select a.team, list(coalesce(p.w, 0.0)::double order by o.i) as m from names a cross join names o left join pairs p on p.team = a.team and p.opponent = o.team and p.team <> p.opponent group by 1),
  sys as (select list(team order by team) as teams, list(d order by team) as d, list(b order by team) as b, list(c order by team) as c, list(m order by team) as m, count(*) as n from sides join lines using (team))"""


def _rounds(step: str, most: int, until: str) -> str:
    """The recursive CTE ``it``: lists x from zeros, ``step`` being the SQL of team i's next value, until the largest move is less than ``until``."""
    return f"it as (select 0 as k, list_transform(range(n), lambda i: 0.0::double) as x, 1e9::double as moved from sys union all select k + 1, y, list_max(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) from (select it.k, it.x, list_transform(range(1, n + 1), lambda i: {step}) as y from it, sys where it.k < {most} and it.moved >= {until}))"


_LAST = "last_x as (select arg_max(x, k) as x from it), found as (select unnest(teams) as team, unnest(x) as x from sys, last_x)"
_OTHERS = "list_dot_product(m[i], x)"


#: The CTEs ``cg`` and ``solved`` (list x): conjugate gradients on lists for ``eq``, a matrix ``a`` and right side ``y``.
_ADD = lambda u, f, v: f"list_transform(list_zip({u}, {v}), lambda z: z[1] + ({f}) * z[2])"
_SOLVED = f"""cg as (select 0 as k, list_transform(y, lambda v: 0.0::double) as x, y as r, y as p, list_dot_product(y, y) as rr, list_dot_product(y, y) as rr0 from eq union all
    select k + 1, x, r, {_ADD('r', 'nn / rr', 'p')}, nn, rr0 from (select *, list_dot_product(r, r) as nn from (select k, {_ADD('x', 's', 'p')} as x, {_ADD('r', '-s', 'q')} as r, p, rr, rr0 from (select *, rr / list_dot_product(p, q) as s from (select cg.*, list_transform(eq.a, lambda row: list_dot_product(row, cg.p)) as q from cg, eq where rr > rr0 * 1e-28 and k < 500))))),
  solved as (select arg_max(x, k) as x from cg)"""
_MATRIX = lambda ridge: f"list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: case when i = j then d[i] + {ridge} else -m[i][j] end))"


@query(f"with recursive {TG}, {_system('tg', 'margin')}, eq as (select {_MATRIX('1e-6')} as a, b as y from sys), {_SOLVED}, found as (select unnest(teams) as team, unnest(x) as x from sys, solved) select team, {st('x - avg(x) over ()')} as rating from found")
def massey_rating(spark, d):
    """Least squares over pairs by conjugate gradients; the oracle does so on lists."""
    return rounded(ratings.massey(games(spark, d).withColumn("home_score", F.col("home_score").cast("double"))), "rating")


def _links(spark, d):
    return graphs.edges(games(spark, d), F.col("home_score") - F.col("away_score"))


_RATED = "rated as (select team, x - avg(x) over () as rating from found)"
_SIGMA = f"select t.team, {st('r.rating')} as rating, {st('avg(t.pf)')} as offense, {st('avg(t.pa)')} as defense, {st('sqrt(avg(power(t.margin - (r.rating - o.rating), 2)))')} as sigma from tg t join rated r on r.team = t.team left join rated o on o.team = t.opponent group by t.team, r.rating"


@query(f"with recursive {TG}, {_system('tg', 'margin')}, {_rounds(f'(b[i] + {_OTHERS}) / d[i]', 100, '0.001')}, {_LAST}, {_RATED} {_SIGMA}")
def score_rating(spark, d):
    """Ratings from scores alone in at most 100 rounds that stop when no team moves by .001, with points and the deviation of a team's margins."""
    return rounded(training.score_errors(games(spark, d), graphs.rounds_rating(_links(spark, d))), "rating", "offense", "defense", "sigma")


@query(f"with recursive {TG}, {_system('tg', 'margin')}, {_rounds(f'(b[i] - {_OTHERS}) / d[i]', 12, '0.0')}, {_LAST} select team, {st('x - avg(x) over ()')} as rating from found")
def score_rating_against(spark, d):
    """The older sign of the same rounds, 12 of them."""
    return rounded(graphs.rounds_rating(_links(spark, d), 12, 0.0, against=True), "rating")


_MG = """mg as (select home as team, away as opponent, home_score - away_score as t, case when season % 2 = 0 then 1.0 else 0.6 end as w, 1.0 as s from games where abs(home_score - away_score) <= 35
  union all select away, home, away_score - home_score, case when season % 2 = 0 then 1.0 else 0.6 end, -1.0 from games where abs(home_score - away_score) <= 35)"""


@query(f"""with recursive {TG}, {_MG}, pr as (select team, {st('avg(pf)')} as p from tg group by 1), {_system('mg', 'w * t', 'w', 'w * s')},
  z as (select list((p - m) / s order by team) as p from (select team, p, avg(p) over () as m, stddev_pop(p) over () as s from (select distinct team from mg) join pr using (team))), whole as (select sum(w)::double / 2 as w, sum(case when s > 0 then w * t end)::double as t from mg),
  eq as (select list_append(list_transform(range(1, n + 1), lambda i: list_append(({_MATRIX('0.1')})[i], c[i])), list_append(c, w)) as a, list_append(list_transform(range(1, n + 1), lambda i: b[i] + 0.1 * z.p[i]), t) as y from sys, z, whole), {_SOLVED},
  found as (select unnest(teams) as team, unnest(x[1:n]) as x, x[n + 1] as h from sys, solved) select team, {st('x - avg(x) over ()')} as rating, {st('h')} as hfa from found""")
def market_ratings(spark, d):
    """Ratings that fit targets of games with one home constant, drawn to a prior of points."""
    g = games(spark, d)
    prior = rounded(ratings.team_games(g).groupBy("team").agg(F.avg("pf").alias("prior")), "prior")
    rows = g.select("home", "away", (F.col("home_score") - F.col("away_score")).cast("double").alias("target"), F.when(F.col("season") % 2 == 0, 1.0).otherwise(0.6).alias("row_weight"))
    found, hfa = training.market_fit(rows, prior)
    return rounded(found.withColumn("hfa", F.lit(hfa)), "rating", "hfa")


#: Sums of all earlier weeks, and the closed form of the fit on two predictors.
_EARLIER = ", ".join(f"sum({x}) over w as {n}" for n, x in {"n": "n", "x": "x", "z": "z", "y": "y", "xx": "xx", "zz": "zz", "xz": "xz", "xy": "xy", "zy": "zy"}.items())
_WALK = f"""p as (select game, cast(month(date) as integer) as week, home::double as x, away::double as z, (home_score - away_score)::double as y from games ),
  s as (select week, count(*) as n, sum(x) as x, sum(z) as z, sum(y) as y, sum(x * x) as xx, sum(z * z) as zz, sum(x * z) as xz, sum(x * y) as xy, sum(z * y) as zy from p group by 1),
  c as (select week, {_EARLIER} from s window w as (order by week rows between unbounded preceding and 1 preceding)),
  v as (select week, n, x / n as mx, z / n as mz, y / n as my, xx / n - x / n * x / n as vx, zz / n - z / n * z / n as vz, xz / n - x / n * z / n as vxz, xy / n - x / n * y / n as vxy, zy / n - z / n * y / n as vzy from c),
  b as (select *, (vxy * vz - vzy * vxz) / (vx * vz - vxz * vxz) as bx, (vzy * vx - vxy * vxz) / (vx * vz - vxz * vxz) as bz from v),
  r as (select game, p.week, p.y, my + bx * (p.x - mx) + bz * (p.z - mz) as prediction from p join b using (week))"""


def _walked(spark, d):
    from rookery.plans.teams import _features

    return linear.residual_walk(_features(spark, d), ["f1", "f2"], "f1", ["f2"], "margin", "week", 0.0, 0.5)


@query(f"with {_WALK} select game, week, {st('prediction')} as prediction from r")
def residual_walk(spark, d):
    """Each month by the fit on all earlier ones, the second feature as what the first leaves of it: without a penalty that is the fit on both."""
    return rounded(_walked(spark, d), "prediction").select("game", "week", "prediction")


@query(f"with {_WALK}, m as (select avg(y) as mean from r) select {st('sqrt(avg(power(y - prediction, 2)))')} as rmse, {st('1 - sum(power(y - prediction, 2)) / sum(power(y - mean, 2)) filter (where prediction is not null)')} as r2, {st('corr(y, prediction)')} as pearson, count(prediction) as n from r, m")
def residual_walk_score(spark, d):
    return rounded(linear.scored(_walked(spark, d), "prediction", "margin"), "rmse", "r2", "pearson")
