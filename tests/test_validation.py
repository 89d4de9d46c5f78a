"""Residuals inside folds by moments against refitting on rows."""

import numpy as np
import pytest

from rookery.operators import linear

FEATURES, ON, EXTENDED = ["r", "a", "b"], "r", ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 400
    r, w = rng.normal(2, 3, n), rng.choice([1.0, 0.6], n)
    a, b = 0.7 * r + rng.normal(0, 1, n), -0.4 * r + rng.normal(5, 2, n)
    y = 1 + 2 * r + 0.5 * a - b + rng.normal(0, 2, n)
    week = rng.integers(1, 13, n)
    df = spark.createDataFrame([tuple(map(float, x)) + (int(k), i) for i, (*x, k) in enumerate(zip(r, a, b, y, w, week))], "r double, a double, b double, y double, w double, week int, i int")
    return df, np.stack([r, a, b], 1), y, w, week


def residuals(x, train):
    out = x.copy()
    for k in (1, 2):
        r, f = x[train, 0], x[train, k]
        slope = ((r - r.mean()) * (f - f.mean())).mean() / ((r - r.mean()) ** 2).mean()
        out[:, k] = x[:, k] - (f.mean() - slope * r.mean()) - slope * x[:, 0]
    return out


def fitted(x, y, w, alpha, mix):
    v = np.column_stack([np.ones(len(x)), x, y])
    return linear.elastic_net(linear.Moments(tuple(FEATURES), v.T @ (v * w[:, None])), alpha, mix, rounds=3000, tolerance=1e-12)


def test_grid_equals_refitting_on_rows(spark, rows):
    df, x, y, w, week = rows
    alphas, mixes = [0.0, 0.05, 1.0], [0.1, 0.9]
    got = linear.residual_grid(df, FEATURES, ON, EXTENDED, "y", "week", alphas, mixes, 5, "w")
    weeks, want = sorted(set(week)), {}
    for a in alphas:
        for m in mixes:
            errors = []
            for f in range(5):
                held = np.isin(week, weeks[len(weeks) * f // 5 : len(weeks) * (f + 1) // 5])
                z = residuals(x, ~held)
                beta = fitted(z[~held], y[~held], w[~held], a, m)
                e = y[held] - beta[0] - z[held] @ beta[1:]
                errors.append(np.sqrt((w[held] * e * e).sum() / w[held].sum()))
            want[a, m] = np.mean(errors)
    assert {(r["alpha"], r["mix"]): r["rmse"] for r in got} == pytest.approx(want, abs=1e-3)
    assert [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)
    (best,) = [r for r in got if r["chosen"]]
    assert (best["mix"], best["alpha"]) == min((m, a) for (a, m), v in want.items() if v <= min(want.values()) + 0.2)
    assert linear.residual_grid(df.where("false"), FEATURES, ON, EXTENDED, "y", "week", alphas, mixes) == []


def test_walk_equals_refitting_on_rows(spark, rows):
    df, x, y, w, week = rows
    out = linear.residual_walk(df, FEATURES, ON, EXTENDED, "y", "week", 0.1, 0.5, weight="w")
    got = {r.i: r.prediction for r in out.collect()}
    for k in sorted(set(week)):
        train, held = week < k, week == k
        if not train.any():
            assert all(got[int(i)] is None for i in np.flatnonzero(held))
            continue
        z = residuals(x, train)
        beta = fitted(z[train], y[train], w[train], 0.1, 0.5)
        want = beta[0] + z[held] @ beta[1:]
        assert np.allclose([got[int(i)] for i in np.flatnonzero(held)], want, atol=2e-3)
    (s,) = linear.scored(out, "prediction", "y", "w").collect()
    known = np.array([got[i] is not None for i in range(len(y))])
    p = np.array([got[i] if got[i] is not None else 0.0 for i in range(len(y))])
    e = (y - p)[known]
    mean = (w * y).sum() / w.sum()
    assert s.n == known.sum() and s.rmse == pytest.approx(np.sqrt((w[known] * e * e).sum() / w[known].sum()))
    assert s.r2 == pytest.approx(1 - (w[known] * e * e).sum() / (w[known] * (y[known] - mean) ** 2).sum())


def test_a_line_without_spread_leaves_the_mean(spark):
    df = spark.createDataFrame([(5.0, float(i), float(2 * i), i % 4) for i in range(20)], "r double, a double, y double, week int")
    (m,) = linear.Moments.several(df, ["r", "a"], "y", [None]).values()
    change = linear.residual_change(m[0], "r", ["a"])
    assert change[2].tolist() == [-9.5, 0.0, 1.0, 0.0]
    assert linear.residual_walk(df.where("week = 9"), ["r", "a"], "r", ["a"], "y", "week", 0.1, 0.5).count() == 0


def test_grids_of_weights_equal_each_weight_on_rows(spark):
    from rookery.operators import bets

    rng = np.random.default_rng(5)
    a, b = rng.normal(3, 5, 300), rng.normal(-2, 4, 300)
    t = 0.3 * a + 0.7 * b + rng.normal(0, 2, 300)
    rows = [tuple(map(float, x)) for x in zip(a, b, t)] + [(None, 1.0, 2.0), (1.0, None, 2.0), (1.0, 2.0, None)]
    weights = [0.0, 0.3, 1.0, 1.5]
    got = {r.w: r for r in bets.grid(spark.createDataFrame(rows, "a double, b double, t double").repartition(3), weights, "a", "b", "t").collect()}
    assert sorted(got) == weights
    for w in weights:
        e = w * a + (1 - w) * b - t
        want = (np.corrcoef(e + t, t)[0, 1], np.sqrt((e * e).mean()), np.abs(e).mean(), np.abs(e).std(), 303)
        assert (got[w].pearson, got[w].rmse, got[w].mae, got[w].abs_error_deviation, got[w].n) == pytest.approx(want)
    flat = spark.createDataFrame([(1.0, 1.0, 1.0)] * 3, "a double, b double, t double")
    assert [tuple(r)[1:] for r in bets.grid(flat, [0.5], "a", "b", "t").collect()] == [(None, 0.0, 0.0, 0.0, 3)]
    assert bets.grid(flat.where("false"), weights, "a", "b", "t").count() == 0
