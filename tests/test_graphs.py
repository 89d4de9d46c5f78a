"""Rating systems over tables against dense ones in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.operators import graphs, ratings


def system(rows, n):
    a, b, c = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    for h, v, t, w in rows:
        a[h, h] += w
        a[v, v] += w
        a[h, v] -= w
        a[v, h] -= w
        b[h], b[v], c[h], c[v] = b[h] + w * t, b[v] - w * t, c[h] + w, c[v] - w
    return a, b, c


def links_of(spark, rows):
    df = spark.createDataFrame(rows, "home int, away int, target double, w double")
    return graphs.edges(df, F.col("target"), F.col("w"))


@pytest.mark.parametrize("ridge", [0.1, 3.0])
def test_two_sides_at_once_solve_the_dense_system(spark, ridge):
    rng = random.Random(1)
    rows = [(*rng.sample(range(60), 2), rng.uniform(-30, 30), rng.choice([1.0, 0.6])) for _ in range(90)]  # several parts and a few lone teams
    rows += [(0, i, float(i), 1.0) for i in range(1, 60)] * 2  # a hub that all have met
    a, b, c = system(rows, 60)
    links = links_of(spark, rows)
    found = graphs.solve(links, graphs.nodes(links), ridge, "b", "c").collect()
    got = np.array([[r.x_b, r.x_c] for r in sorted(found, key=lambda r: r.team)])
    want = np.linalg.solve(a + ridge * np.eye(60), np.stack([b, c], 1))
    assert np.allclose(got, want, atol=1e-8)


def test_rounds_match_a_loop_with_either_sign(spark):
    rng = random.Random(2)
    rows = [(*rng.sample(range(12), 2), float(rng.randint(-30, 30)), 1.0) for _ in range(80)]
    a, b, _ = system(rows, 12)
    links = links_of(spark, rows)
    d = np.diag(a)
    for against, rounds, tolerance in ((False, 7, 0.0), (True, 5, 0.0), (False, 100, 0.001)):
        x = np.zeros(12)
        for _ in range(rounds):
            y = (b + (-1 if against else 1) * ((np.diag(d) - a) @ x)) / d
            moved, x = np.abs(y - x).max(), y
            if moved < tolerance:
                break
        got = {r.team: r.rating for r in graphs.rounds_rating(links, rounds, tolerance, against).collect()}
        assert np.allclose([got[t] for t in range(12)], x - x.mean(), atol=1e-9)


def test_priors_nothing_and_a_system_that_does_not_settle(spark):
    games = spark.createDataFrame([(1, "a", "b", 30.0, 20.0), (2, "b", "c", 20.0, 20.0)], "game int, home string, away string, home_score double, away_score double")
    got = {r.team: r.rating for r in ratings.massey(games, 1.0, {"a": 6.0, "c": -3.0}).collect()}
    want = np.linalg.solve(np.array([[2.0, -1, 0], [-1, 3, -1], [0, -1, 2]]), np.array([16.0, -10, -3]))
    assert np.allclose([got[t] for t in "abc"], want - want.mean())
    assert ratings.massey(games.limit(0)).count() == 0 and graphs.rounds_rating(links_of(spark, [])).count() == 0
    links = links_of(spark, [(i, i + 1, 1.0, 1.0) for i in range(30)])
    with pytest.raises(ArithmeticError):
        graphs.solve(links, graphs.nodes(links), 0.0, "b", rounds=3)
