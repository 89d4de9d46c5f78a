"""Whitening against plain Python integers and numpy."""

import math

import numpy as np
import pytest

from rookery.llm import whitening

NEAR = 1e-6


def brute(rows, k=8):
    """deviation and whitened of each row kept, explained, and n, with Python integers for sums and deviations."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in kept]
    n = len(x)
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    c = np.array([[float((n * r[j] - s[j])) / n for j in range(d)] for r in x]).reshape(n, d)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in kept], deviation, np.abs(c @ u / np.sqrt(e)), e / np.trace(c.T @ c / n), n


def check(spark, rows, kind="array<float>"):
    got = whitening.components(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}").repartition(3)).collect()
    ids, deviation, whitened, explained, n = brute(rows)
    k = whitened.shape[1]
    assert len(got) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in got}
    for i, dev, w in zip(ids, deviation, whitened):
        for j in range(k):
            r = by[i, j + 1]
            assert (r.n, r.deviation_digits) == (n, str(dev)) and r.deviation == (dev if dev < 1 << 63 else None)
            assert abs(r.whitened) == pytest.approx(w[j], abs=NEAR) and r.explained == pytest.approx(explained[j], rel=NEAR)
            assert r.identity_error < 1e-9
    return got


def test_components_match_brute_force_and_odd_vectors_go(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(3, 1, 12) * np.arange(1, 13)]) for i in range(400)]
    rows += [(500, None), (501, [1.0, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] + [0.0] * 11), (504, [2.0, 1.0]), (505, [])]
    got = check(spark, rows)
    assert {r.component for r in got} == set(range(1, 9)) and not {r.vec_id for r in got} & {500, 501, 502, 503}
    assert got[0].identity_error is not None and sum(r.explained for r in got if r.vec_id == 0) <= 1


def test_a_third_of_all_rows_alike_and_wide_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [0.25] * 4) for i in range(100)] + [(100 + i, [float(c) for c in rng.normal(0, 10.0 ** np.array([9, 8, 9, 8]))]) for i in range(200)]
    got = check(spark, rows, "array<double>")
    assert any(r.deviation is None for r in got)


def test_whitened_vectors_have_the_identity_as_covariance(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(0, 1, (6, 6))
    rows = [(i, i % 3, (rng.normal(0, 1, 6) @ mix).tolist(), None) for i in range(500)] + [(500, None, None, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, made int, embedding array<double>, `a.b` string")
    fitted = whitening.fit(df, components=6)
    out = whitening.whiten(df, fitted)
    assert out.columns == [*df.columns, "whitened"]
    found = {r.vec_id: r for r in out.collect()}
    w = np.array([found[i].whitened for i in range(500)])
    assert np.allclose(w.T @ w / 500, np.eye(6), atol=1e-9) and np.allclose(w.mean(0), 0, atol=1e-9)
    assert found[500].whitened is None and found[500]["a.b"] == "x" and found[4].made == 1


def test_nothing_one_vector_and_flat_directions(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.components(spark.createDataFrame([], kind)).count() == 0
    assert whitening.components(spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [])], kind)).count() == 0
    one = whitening.components(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(1, c, 3, 0, None, None, None) for c in (1, 1, 1, 2, 2, 2)]
    flat = whitening.components(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {r.explained for r in flat if r.component == 1} == {1.0}


def test_sums_beyond_a_long_are_exact():
    x = np.array([[whitening.LIMIT + whitening.SHIFT]] * 3000)
    assert whitening._sums(x) == [3000 * (whitening.LIMIT + whitening.SHIFT)]
    assert whitening._added((2, [5]), (1, [1, 2])) == (3, [6, 2 * whitening.SHIFT + 2])
