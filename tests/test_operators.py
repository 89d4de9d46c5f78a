"""Operators that SQL cannot express, and cases that the tables lack."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F
from rookery.functions import frames, numbers, text
from rookery.operators import aggregates, asof, bets, consensus, dedup, linear, ratings, windows


def games(spark, seed=1, n=120, teams=9):
    rng = np.random.default_rng(seed)
    true, rows = rng.normal(0, 8, teams), []
    for i in range(n):
        h, a = rng.choice(teams, 2, replace=False)
        rows.append((i, int(h), int(a), float(30 + true[h]), float(30 + true[a]), i % 12))
    return spark.createDataFrame(rows, "game int, home int, away int, home_score double, away_score double, week int"), true


def test_massey_recovers_ratings_that_explain_every_margin(spark):
    g, true = games(spark)
    got = {r.team: r.rating for r in ratings.massey(g).collect()}
    assert np.allclose([got[t] for t in range(9)], true - true.mean(), atol=1e-3)
    assert ratings.massey(g.limit(0)).count() == 0


def test_strength_passes_match_a_loop(spark):
    g, _ = games(spark)
    start = ratings.records(g).select("team", F.col("mean_margin").alias("rating"), F.lit(0.8).alias("confidence"), "games")
    rows, faced = {r.team: r for r in start.collect()}, {}
    for r in g.collect():
        faced.setdefault(r.home, []).append(r.away)
        faced.setdefault(r.away, []).append(r.home)
    now = {t: r.rating for t, r in rows.items()}
    for _ in range(3):
        now = {t: rows[t].rating + 0.25 * np.mean([now[o] for o in faced[t]]) for t in now}
    got = {r.team: r.adjusted for r in ratings.strength_passes(start, g, tolerance=0.0).collect()}
    assert all(math.isclose(got[t], now[t], abs_tol=1e-9) for t in now)


def table(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.5, n)
    rows = [(int(i % 10), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "week int, f1 double, f2 double, y double"), x, y


def test_moments_solve_like_least_squares(spark):
    df, x, y = table(spark)
    m = linear.Moments.of(df, ["f1", "f2"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert np.allclose(linear.solve(m), want) and np.allclose(linear.elastic_net(m, 0.0, 0.5, tolerance=1e-10), want, atol=1e-6)
    assert np.abs(linear.elastic_net(m, 100.0, 1.0)[1:]).max() == 0
    assert m.errors(want)["rmse"] == pytest.approx(np.sqrt(np.mean((y - np.column_stack([np.ones(len(x)), x]) @ want) ** 2)))


def test_walk_forward_fits_on_earlier_weeks_only(spark):
    df, x, y = table(spark)
    got = [(r.week, r.f1, r.prediction) for r in linear.walk_forward(df, ["f1", "f2"], "y", "week").collect()]
    assert all((p is None) == (w < 2) for w, _, p in got)
    week = np.arange(len(x)) % 10
    fit = np.linalg.lstsq(np.column_stack([np.ones((week < 5).sum()), x[week < 5]]), y[week < 5], rcond=None)[0]
    want = {round(float(a), 9): float(fit @ [1, a, b]) for (a, b), w in zip(x, week) if w == 5}
    assert all(math.isclose(p, want[round(f, 9)], abs_tol=1e-6) for w, f, p in got if w == 5)


def test_penalties_are_chosen_on_held_out_weeks(spark):
    df, *_ = table(spark)
    found = linear.cross_validated(df, ["f1", "f2"], "y", "week", [0.0, 5.0], [0.5])
    assert found[0]["alpha"] == 0.0 and found[0]["rmse"] < 0.7 < found[1]["rmse"]


def test_bankroll_is_a_fold_and_ruin_stays(spark):
    outcomes = [0.9, -1.0, 0.9, None, -12.0, 5.0]
    df = spark.createDataFrame([("b", i, 0.1, o) for i, o in enumerate(outcomes)], "k string, i int, share double, outcome double")
    got = [r.bankroll for r in windows.bankroll(df, ["k"], ["i"], "share", "outcome").orderBy("i").collect()]
    want, money = [], 1000.0
    for o in outcomes:
        money = max(0.0, money * (1 + 0.1 * (o or 0.0)))
        want.append(money)
    assert got == pytest.approx(want)


def test_grading_pushes_lie_within_half_a_point(spark):
    df = spark.createDataFrame([(3.0, -3.49), (3.0, -3.5), (3.0, -2.5), (0.0, 0.0), (None, 1.0)], "margin double, line double")
    got = [(r.r, r.p) for r in df.select(bets.spread_result("margin", "line").alias("r")).withColumn("p", bets.profit(F.col("r"), F.lit(100.0))).collect()]
    assert got == [("push", 0.0), ("loss", -100.0), ("win", pytest.approx(90.9)), ("push", 0.0), (None, None)]


def test_a_closing_quote_falls_back_to_any_time(spark):
    kicks = spark.createDataFrame([(1, 1, 100), (2, 2, 100), (3, 3, 100)], "kick_id int, game int, k int").withColumn("kick", F.timestamp_seconds("k"))
    quotes = spark.createDataFrame([(1, 1, 100, 1.0), (2, 1, 150, 2.0), (3, 2, 150, 3.0), (4, 2, 140, 4.0)], "quote_id int, game int, t int, line double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.kick_id: (r.line, r.on_time) for r in asof.asof(kicks, quotes, "game", "kick", "ts", "line", "quote_id", "kick_id").collect()}
    assert got == {1: (1.0, True), 2: (3.0, False), 3: (None, False)}


def test_consensus_of_mixed_signs_and_price_leaks(spark):
    rows = [(1, "a", 1, 29.0), (2, "a", 2, -29.0), (3, "b", 3, 29.5), (4, "b", 4, -29.5), (5, "c", 5, -115.0), (6, "d", 6, 28.5)]
    q = spark.createDataFrame(rows, "quote_id int, book string, t int, line double").withColumns({"game": F.lit(1), "ts": F.timestamp_seconds("t")})
    r = consensus.spread_consensus(q, ["game"]).first()
    assert (r.consensus_fc, r.n_raw, r.n_books) == (-29.0, 6, 3)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(numbers.round_to_half(F.lit(-29.25))) == -29.0 and value(numbers.round_to_half(F.lit(29.25))) == 29.5
    assert value(numbers.zscore(F.lit(None).cast("double"), 1.0, 2.0, True)) == 0.0
    assert value(frames.label(F.lit("Team"), 4.6)) == "Team +4.5" and value(frames.label(F.lit("Team"), -4.5)) == "Team -4.5"
    assert value(text.slug(F.lit("San José St. (CA) & Co"))) == "san-jose-st-ca-and-co"
    assert value(numbers.matchup_class(F.lit("FCS"), F.lit("G5"))) == "G5_FCS"
    assert text.week_list("1-3, 7") == [1, 2, 3, 7]


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, dedup.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, dedup.insert_ignore(old, new, ["k"]).collect())) == [(3, "d")]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_roster_indices_of_known_teams(spark):
    rows = [(0.6, 0.8, None, 10), (None, None, 70.0, 0), (None, None, None, 5), (0.9, None, None, 40), (0.0, 0.5, None, None)]
    got = values(spark, rows, "off double, def double, overall double, n int", numbers.continuity("off", "def", "overall", "n"), numbers.mercenary_index("n"), numbers.portal_aggressor("n"))
    assert got == [(pytest.approx(0.8125), 0.5, 1.0), (pytest.approx(0.7), 0.0, pytest.approx(1 / 3)), (None, 0.25, pytest.approx(2 / 3)), (1.0, 1.0, 1.0), (0.5, None, None)]
    shock = values(spark, [(0.5, None, 1.0, 0.0), (None,) * 4], "p double, r double, c double, d double", numbers.positional_shock("p", "r", "c", "d"))
    assert shock == [(pytest.approx((0.15 + 0 + 0.3) / 0.75),), (None,)]
    bands = values(spark, [(0.4, 0.7, 0.5, 0.7), (0.6, 0.5, 0.4, 0.1), (0.9, None, 0.1, None)], "a double, b double, c double, d double", numbers.risk_band(*[F.col(c) for c in "abcd"]))
    assert [b for (b,) in bands] == ["high", "medium", "low"]


def test_shrinkage_steps(spark):
    got = values(spark, [(1.0, 2), (0.9, 4), (0.8, 7), (1.0, 8), (0.1, 0), (None, 20)], "c double, n int", numbers.shrink_factor("c", "n"))
    assert [x for (x,) in got] == pytest.approx([0.30, 0.29, 0.28, 0.18, 0.42, 0.27])


def test_state_and_tech_are_not_taken_for_one_another(spark):
    from rookery.operators import resolve

    teams = spark.createDataFrame([(1, "Georgia"), (2, "Georgia State"), (3, "Georgia Tech"), (4, "Texas A&M")], "team_id int, team string")
    names = spark.createDataFrame([("University of Georgia",), ("State Georgia",), ("The Georgia Tech College",)], "name string")
    assert sorted((r.name, r.team_id) for r in resolve.fuzzy(names, teams).collect()) == [("State Georgia", 2), ("The Georgia Tech College", 3), ("University of Georgia", 1)]
    aliases = spark.createDataFrame([], "alias string, team_id int")
    got = {r.name: r.team_id for r in resolve.resolved(spark.createDataFrame([("Georgia St. State",), ("georgia",)], "name string"), teams, aliases).collect()}
    assert got == {"Georgia St. State": None, "georgia": 1}


def test_time_line_joins_with_repeated_rows_ties_and_nulls(spark):
    kicks = spark.createDataFrame([(1, 1, 100), (1, 1, 100), (2, 1, None), (3, None, 100), (4, 2, 100)], "kick_id int, game int, k int").withColumn("kick", F.timestamp_seconds("k"))
    quotes = spark.createDataFrame([(1, 1, 100, 1.0), (2, 1, 100, 2.0), (3, None, 90, 9.0), (4, 2, 90, 4.0), (5, 2, 110, 5.0), (6, 2, None, 6.0)], "quote_id int, game int, t int, line double").withColumn("ts", F.timestamp_seconds("t"))
    rows = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)
    strict = asof.asof(kicks, quotes, "game", "kick", "ts", "line", "quote_id", "kick_id", fallback=False)
    assert rows(strict, "kick_id", "line", "on_time") == sorted([(1, 2.0, True), (1, 2.0, True), (2, None, False), (3, None, False), (4, 4.0, True)], key=repr)
    assert rows(asof.asof(kicks, quotes, "game", "kick", "ts", "line", "quote_id", "kick_id"), "kick_id", "line") == sorted([(1, 2.0), (1, 2.0), (2, 2.0), (3, None), (4, 4.0)], key=repr)
    near = asof.nearest(kicks, quotes, "game", "kick", "ts", "kick_id", "quote_id")
    assert rows(near, "kick_id", "quote_id", "gap_us") == [(1, 1, 0), (1, 1, 0), (4, 4, 10_000_000)]


def test_window_joins_match_brute_force_on_a_hot_key(spark):
    rng = np.random.default_rng(6)
    k = [(i, 0 if i % 3 else 1, int(t)) for i, t in enumerate(rng.integers(-20_000, 20_000, 60))]
    q = [(i, 0 if i % 3 else 1, int(t)) for i, t in enumerate(rng.integers(-20_000, 20_000, 400))]
    kicks = spark.createDataFrame(k, "kick_id int, game int, k int").withColumn("kick", F.timestamp_seconds("k"))
    quotes = spark.createDataFrame(q, "quote_id int, game int, t int").withColumn("ts", F.timestamp_seconds("t"))
    want = sorted((i, j) for i, g, a in k for j, h, b in q if g == h and a - 3600 <= b <= a + 300)
    assert sorted((r.kick_id, r.quote_id) for r in asof.in_window(kicks, quotes, "game", "kick", "ts").collect()) == want and want
    every = sorted([*want, *((i, j) for i, g, a in k if i not in {x for x, _ in want} for j, h, _ in q if g == h)])
    assert sorted((r.kick_id, r.quote_id) for r in asof.window_or_all(kicks, quotes, "game", "kick", "ts", "kick_id").collect()) == every


def test_the_newest_row_of_a_key_wins_a_merge(spark, tmp_path):
    from rookery.streaming import quotes as streams

    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = lambda *r: spark.createDataFrame([(k, v) for k, v in r], "t int, value double").select(F.lit(1).cast("bigint").alias("event_id"), F.timestamp_seconds("t").alias("ts"), F.lit(7).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), "value", F.lit("").alias("props"))
    rows((50, 5.0), (90, 9.0), (70, 7.0)).coalesce(1).write.parquet(f"{tmp_path}/in")
    streams.merged(streams.stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/table", ["event_id"], f"{tmp_path}/c").awaitTermination()
    rows((60, 6.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    streams.merged(streams.stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/table", ["event_id"], f"{tmp_path}/c").awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "table").iterdir() if p.name.isdigit())
    assert last == 1 and [r.value for r in spark.read.parquet(f"{tmp_path}/table/{last}").collect()] == [9.0]


def test_insert_ignore_keeps_the_least_row_of_a_key(spark):
    new = spark.createDataFrame([(3, "e"), (3, "d")], "k int, v string")
    assert [tuple(r) for r in dedup.insert_ignore(new.limit(0), new, ["k"]).collect()] == [(3, "d")]


def test_nearest_rank_of_ties_extremes_and_null_keys(spark):
    import math
    import random

    rng = random.Random(8)
    rows = [(k, v) for k in (None, 1, 2, 3) for v in [rng.choice((0.0, 1.5, -2.0, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None, rng.random())) for _ in range(200)]]
    rows += [(4, 5.0)] * 300 + [(5, None)] + [(6, float(i)) for i in range(1000)]
    shares = {"low": 0.1, "mid": 0.5, "top": 1.0}
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)

    def pick(held):
        return tuple(repr(held[min(int(len(held) * p), len(held) - 1)]) for p in shares.values())

    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (repr(r.low), repr(r.mid), repr(r.top)) for r in aggregates.nearest_rank(df, ["k"], "v", shares).collect()}
    assert got == {k: pick(sorted((v for n, v in rows if n == k and v is not None), key=order)) for k in (None, 1, 2, 3, 4, 6)}
    (every,) = aggregates.nearest_rank(df, [], "v", shares).collect()
    assert (repr(every.low), repr(every.mid), repr(every.top)) == pick(sorted((v for _, v in rows if v is not None), key=order))
    assert aggregates.nearest_rank(df.where("false"), ["k"], "v", shares).count() == 0
