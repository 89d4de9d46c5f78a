"""Training operators beyond their oracles: ranks against plain sorting, the market fit against numpy, nulls and empty tables."""

import random

import numpy as np
import pytest

from rookery.operators import training, windows


def test_ordinal_ranks_match_plain_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 1, 2, 7]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(7)
    got = {r.i: r.rank for r in windows.ordinal(df, ["k"], ["x", "i"], "rank", blocks=8).collect()}
    want = {}
    for k in ("a", "b", None):
        group = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n + 1 for n, r in enumerate(group)}
    assert got == want


def test_ordinal_of_nothing_and_of_one_value(spark):
    assert windows.ordinal(spark.createDataFrame([], "x int"), [], ["x"], "rank").count() == 0
    same = spark.createDataFrame([(1,)] * 40, "x int")
    assert sorted(r.rank for r in windows.ordinal(same, [], ["x"], "rank", blocks=2).collect()) == list(range(1, 41))


def test_market_fit_solves_the_ridge_system(spark):
    rng = random.Random(5)
    rows = [(h, a, rng.uniform(-30, 30), rng.choice([1.0, 0.6])) for h, a in (rng.sample(range(6), 2) for _ in range(80))] + [(0, 1, 60.0, 1.0)]
    prior = {0: 3.0, 1: -1.0, 2: 0.5}
    games = spark.createDataFrame(rows, "home int, away int, target double, row_weight double")
    found, hfa = training.market_fit(games, spark.createDataFrame(list(prior.items()), "team int, prior double"), 0.1)
    p = np.array([prior.get(t, 0.0) for t in range(6)])
    p = (p - p.mean()) / p.std()
    # the same minimum as a plain least-squares problem with a row to a game and a row to a team's prior
    a, b = [], []
    for h, w, t, weight in rows[:-1]:
        row = np.zeros(7)
        row[h], row[w], row[6] = 1, -1, 1
        a.append(row * weight**0.5)
        b.append(t * weight**0.5)
    for t in range(6):
        row = np.zeros(7)
        row[t] = 0.1**0.5
        a.append(row)
        b.append(0.1**0.5 * p[t])
    x = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    got = {r.team: r.rating for r in found.collect()}
    assert np.allclose([got[t] for t in range(6)], x[:6] - x[:6].mean())
    assert abs(hfa - x[6]) < 1e-9


def test_market_fit_refuses_few_games(spark):
    with pytest.raises(ValueError, match="fewer than"):
        training.market_fit(spark.createDataFrame([(1, 2, 3.0, 1.0)], "home int, away int, target double, row_weight double"), spark.createDataFrame([], "team int, prior double"))


def test_training_rows_of_set_a_need_a_target_and_both_teams(spark):
    schema = "game int, is_home boolean, tier string, rest int, bye boolean, m double"
    rows = spark.createDataFrame([(1, True, "P5", None, True, 2.0), (1, False, "G5", 4, False, None), (2, True, "G5", 3, False, 1.0), (3, True, "x", 7, False, 5.0), (3, False, None, 7, None, 1.0)], schema)
    found = spark.createDataFrame([(1, 6.5, 2)], "game int, target double, books bigint")
    (one,) = training.training_rows(rows, found, ("m",)).collect()
    assert (one.game, one.diff_m, one.tier_gap, one.p5_vs_g5, one.rest_diff, one.bye_home, one.bye_away, one.row_weight) == (1, None, 1, True, -4.0, True, False, 1.0)
    other = {r.game: r for r in training.training_rows(rows, found, ("m",), "C").collect()}
    assert set(other) == {1, 3} and other[3].diff_m == 4.0 and other[3].target is None and not other[3].pre_kick and other[3].row_weight == 0.25


def test_blend_guard_leaves_weight_zero(spark):
    # in A the second rating fits and any of the first spoils it; in B it hardly fits and the guard's weight does well
    rows = [("A", i, -300.0 * i, float(i), float(i)) for i in range(20)] + [("B", i, float(i) * 100, float(i * 9 % 20), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "label string, i int, a double, b double, y double")
    got = {r.w: r for r in training.blend_by_sets(df, "a", "b", "y", "label", "i", [0.0, 0.1]).collect()}
    assert got[0.0].objective > got[0.1].objective and 0 <= got[0.0].pearson_b < 0.25
    assert got[0.1].pearson_b > 0.9 and got[0.1].chosen and not got[0.0].chosen
    none = training.blend_by_sets(df.where("label = 'none'"), "a", "b", "y", "label", "i", [0.0, 0.1]).collect()
    assert none == []


def test_feature_without_spread_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, True)], "i int, n double, f boolean")
    assert sorted((r.i, r.x_n, r.x_f) for r in training.feature_matrix(df, ["n"], ["f"]).collect()) == [(1, 0.0, 0.0), (2, 0.0, 1.0)]


def test_probe_without_spread_of_points_fits_the_difference(spark):
    df = spark.createDataFrame([(float(i), 2.0, 3.0 * i, 1.0) for i in range(10)], "x double, h double, y double, w double")
    (r,) = training.variance_probe(df, [], "x", "h", "y", "w").collect()
    assert abs(r.slope - 3) < 1e-9 and r.hfa_slope == 0 and abs(r.variance_ratio - 1) < 1e-9 and r.signs_ok


def test_rank_correlation_puts_rows_in_order_once(spark):
    rng = random.Random(3)
    rows = [(s, i, float(rng.randrange(40)), r) for s, n in (("A", 700), ("B", 90), (None, 5), ("one", 1)) for i, r in enumerate(rng.sample(range(1, n + 1), n))]
    df = spark.createDataFrame(rows, "s string, i int, x double, r int")
    out = windows.rank_correlation(df, ["s"], ["x", "i"], "r", "c")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1  # an ordinal rank reads, cuts and orders its rows twice
    got = {r.s: r.c for r in out.collect()}
    assert got.pop("one") is None and set(got) == {"A", "B", None}
    for s, c in got.items():
        order = sorted((x, i, r) for k, i, x, r in rows if k == s)
        assert abs(c - float(np.corrcoef(range(len(order)), [r for *_, r in order])[0, 1])) < 1e-9


def test_a_blend_stores_what_its_weights_reach(spark):
    df = spark.createDataFrame([("AB"[i % 2], i, float(i * 7 % 31), float(i * 5 % 17), float(i % 11)) for i in range(60)], "label string, i int, a double, b double, y double")
    out = training.blend_by_sets(df, "a", "b", "y", "label", "i", [0.0, 0.5])
    read = out._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("row_number()") == 0  # the weights and the best of them read the same stored sums
    assert len(out.collect()) == 2
