"""Regression, calibration and validation.

Spark sums the moments; what reaches the driver is a matrix whose size is the number of features, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.numbers import ratio


@dataclass(frozen=True)
class Moments:
    """Weighted sums of products of (1, features, target)."""

    names: tuple[str, ...]
    products: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, features: list[str], target: str, weight: str | None = None, by: list[str] | None = None):
        """Of all rows, or a dict by the values of ``by``. A null feature is 0; rows without a target are left out."""
        found = {k: m[0] for k, m in cls.several(df, features, target, [weight], by).items()}
        return found if by else found.get((), cls(tuple(features), np.zeros((len(features) + 2,) * 2)))

    @classmethod
    def several(cls, df: DataFrame, features: list[str], target: str, weights: list[str | None], by: list[str] | None = None) -> dict:
        """A list, one to each of ``weights``, by the values of ``by``: all are summed in one pass."""
        cols = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features], F.col(target).cast("double")]
        n = len(cols)
        ws = [F.col(w) if w else F.lit(1.0) for w in weights]
        sums = [F.sum(w * cols[i] * cols[j]).alias(f"s{k}_{i}_{j}") for k, w in enumerate(ws) for i in range(n) for j in range(i, n)]
        rows = df.where(F.col(target).isNotNull()).groupBy(*(by or [])).agg(*sums).collect()
        found = {}
        for r in rows:
            every = []
            for k in range(len(ws)):
                m = np.zeros((n, n))
                for i in range(n):
                    for j in range(i, n):
                        m[i, j] = m[j, i] = r[f"s{k}_{i}_{j}"] or 0.0
                every.append(cls(tuple(features), m))
            found[tuple(r[k] for k in by or [])] = every
        return found

    def through(self, change: np.ndarray) -> Moments:
        """The moments of ``change`` applied to each row's (1, features, target)."""
        return Moments(self.names, change @ self.products @ change.T)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.names, self.products - other.products)

    @property
    def n(self) -> float:
        return float(self.products[0, 0])

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and population deviations of the features; a deviation of 0 counts as 1."""
        mean = self.products[0, 1:-1] / self.n
        var = np.maximum(np.diag(self.products)[1:-1] / self.n - mean**2, 0)
        sd = np.sqrt(var)
        return mean, np.where(sd > 1e-12, sd, 1.0)

    def errors(self, beta: np.ndarray) -> dict[str, float]:
        """RMSE and R2 of intercept and coefficients, from the moments alone."""
        v = np.concatenate([beta, [-1.0]])
        sse = float(v @ self.products @ v)
        y, yy = self.products[0, -1], self.products[-1, -1]
        sst = yy - y * y / self.n
        return {"rmse": float(np.sqrt(max(sse, 0) / self.n)), "r2": 1 - sse / sst if sst > 0 else 0.0}


def solve(m: Moments, ridge: float = 0.0) -> np.ndarray:
    """Weighted least squares with intercept; the ridge does not touch the intercept."""
    a = m.products[:-1, :-1] + np.diag([0.0, *[ridge] * len(m.names)])
    return np.linalg.lstsq(a, m.products[:-1, -1], rcond=None)[0]


def elastic_net(m: Moments, alpha: float, mix: float, penalise_intercept: bool = False, rounds: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """Coordinate descent on standardised features, from the moments; coefficients come back on the features' own scale.

    With ``penalise_intercept`` the intercept is thresholded like a coefficient and then computed anew from the means.
    """
    mean, sd = m.scale()
    n, p = m.n, m.products
    xx = (p[1:-1, 1:-1] / n - np.outer(mean, mean)) / np.outer(sd, sd)
    xy = (p[1:-1, -1] / n - mean * p[0, -1] / n) / sd
    beta = np.zeros(len(mean))
    for _ in range(rounds):
        before = beta.copy()
        for j in range(len(beta)):
            r = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
            beta[j] = np.sign(r) * max(abs(r) - alpha * mix, 0) / (xx[j, j] + alpha * (1 - mix)) if xx[j, j] > 0 else 0.0
        if np.abs(beta - before).max(initial=0) < tolerance:
            break
    y = p[0, -1] / n
    level = np.sign(y) * max(abs(y) - alpha * mix, 0) / (1 + alpha * (1 - mix)) if penalise_intercept else y
    own = beta / sd
    return np.concatenate([[level - own @ mean], own])


def predicted(features: list[str], beta: np.ndarray) -> Column:
    return F.lit(float(beta[0])) + sum((F.coalesce(F.col(c), F.lit(0.0)) * float(b) for c, b in zip(features, beta[1:])), F.lit(0.0))


def through_origin(x: str, y: str) -> Column:
    return F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))


def simple(x: str, y: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def two_predictors(x1: Column, x2: Column, y: Column) -> list[Column]:
    """Least squares on two predictors in one aggregate: ``intercept``, ``first``, ``second``, ``r2``; null where one predictor is constant or both are exactly collinear."""
    v1, v2, c, c1, c2 = F.var_pop(x1), F.var_pop(x2), F.covar_pop(x1, x2), F.covar_pop(x1, y), F.covar_pop(x2, y)
    apart = v1 * v2 - c * c
    first, second = ratio(c1 * v2 - c2 * c, apart), ratio(c2 * v1 - c1 * c, apart)
    level = F.avg(y) - first * F.avg(x1) - second * F.avg(x2)
    return [level.alias("intercept"), first.alias("first"), second.alias("second"), ratio(first * c1 + second * c2, F.var_pop(y)).alias("r2")]


def quadratic(x: str, y: str) -> list[Column]:
    """The fit on a value and its square."""
    return two_predictors(F.col(x), F.col(x) * F.col(x), F.col(y))


def weighted_correlation(x: str, y: str, w: str) -> Column:
    sw, mx, my = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    cov = F.sum(F.col(w) * F.col(x) * F.col(y)) / sw - mx * my / sw / sw
    vx = F.sum(F.col(w) * F.col(x) * F.col(x)) / sw - mx * mx / sw / sw
    vy = F.sum(F.col(w) * F.col(y) * F.col(y)) / sw - my * my / sw / sw
    return cov / F.sqrt(vx * vy)


def residualised(df: DataFrame, columns: list[str], on: str, train: Column) -> DataFrame:
    """Each column less its linear fit on ``on``, fitted on the training rows only."""
    fits = df.where(train).agg(*[f(c, on).alias(f"_{k}_{c}") for c in columns for k, f in (("s", F.regr_slope), ("i", F.regr_intercept))])
    out = df.crossJoin(F.broadcast(fits)).withColumns({f"res_{c}": F.col(c) - F.col(f"_s_{c}") * F.col(on) - F.col(f"_i_{c}") for c in columns})
    return out.drop(*fits.columns)


def calibrated(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """a + b * prediction by least squares, from one aggregate."""
    head = df.agg(F.regr_slope(target, prediction).alias("_b"), F.regr_intercept(target, prediction).alias("_a"))
    return df.crossJoin(F.broadcast(head)).withColumn("calibrated", F.col("_a") + F.col("_b") * F.col(prediction)).drop("_a", "_b")


def folds(df: DataFrame, week: str, k: int = 5) -> DataFrame:
    """Fold of each row: weeks in order, cut into k blocks."""
    weeks = df.select(week).distinct().withColumn("fold", F.ntile(k).over(Window.orderBy(week)) - 1)
    return df.join(weeks, week)


def cross_validated(df: DataFrame, features: list[str], target: str, week: str, alphas: list[float], mixes: list[float], k: int = 5, weight: str | None = None) -> list[dict]:
    """RMSE over held-out week blocks for every pair of penalties: one pass sums each fold's moments, the grid runs on them."""
    by_fold = Moments.of(folds(df, week, k), features, target, weight, ["fold"])
    if not by_fold:
        return []
    total = sum(list(by_fold.values())[1:], start=next(iter(by_fold.values())))
    found = []
    for alpha in alphas:
        for mix in mixes:
            sse, n = 0.0, 0.0
            for held in by_fold.values():
                rest = total - held
                if rest.n > len(features) + 1:
                    e = held.errors(elastic_net(rest, alpha, mix))
                    sse, n = sse + e["rmse"] ** 2 * held.n, n + held.n
            found.append({"alpha": alpha, "mix": mix, "rmse": float(np.sqrt(sse / n)) if n else float("nan")})
    return sorted(found, key=lambda r: (r["rmse"], r["alpha"], r["mix"]))


def _by_week(df: DataFrame, week: str, features: list[str], betas: dict) -> DataFrame:
    """``prediction`` by the coefficients of a row's week, null for weeks without; a table of weeks, so the plan does not grow with them."""
    kind = df.schema[week].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(w, [float(x) for x in b]) for w, b in betas.items()], f"_week {kind}, _beta array<double>")
    value = F.col("_beta")[0] + sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col("_beta")[i] for i, c in enumerate(features, 1)), F.lit(0.0))
    return df.join(table, F.col(week) == F.col("_week"), "left").withColumn("prediction", value).drop("_week", "_beta")


def walk_forward(df: DataFrame, features: list[str], target: str, week: str, first: int = 2, ridge: float = 0.0, weight: str | None = None) -> DataFrame:
    """Each week predicted by the fit on all earlier ones; before ``first`` weeks have passed a prediction is null, not 0."""
    by_week = dict(sorted((k[0], m) for k, m in Moments.of(df, features, target, weight, [week]).items()))
    so_far, betas, seen = None, {}, 0
    for w, m in by_week.items():
        if so_far is not None and seen >= first:
            betas[w] = solve(so_far, ridge)
        so_far, seen = m if so_far is None else so_far + m, seen + 1
    return _by_week(df, week, features, betas)


def residual_change(train: Moments, on: str, extended: list[str]) -> np.ndarray:
    """The matrix that takes (1, features, target) to the same with each of ``extended`` less its line on ``on``: the Schur complement of the training rows' moments, not of rows. Without spread of ``on`` only the mean goes."""
    change, r = np.eye(len(train.names) + 2), 1 + train.names.index(on)
    n, p = train.n, train.products
    spread = p[r, r] / n - (p[0, r] / n) ** 2
    for c in extended:
        k = 1 + train.names.index(c)
        slope = (p[k, r] / n - p[0, k] * p[0, r] / n**2) / spread if spread > 1e-10 else 0.0
        change[k, r], change[k, 0] = -slope, -(p[0, k] / n - slope * p[0, r] / n)
    return change


def _weekly(df: DataFrame, features: list[str], target: str, week: str, weight: str | None) -> tuple[list, list, list]:
    """Weeks in order, and of each the weighted and the plain moments: all that validation needs, from one pass."""
    found = dict(sorted((k[0], m) for k, m in Moments.several(df, features, target, [weight, None], [week]).items()))
    return list(found), [m[0] for m in found.values()], [m[1] for m in found.values()]


def residual_grid(df: DataFrame, features: list[str], on: str, extended: list[str], target: str, week: str, alphas: list[float], mixes: list[float], k: int = 5, weight: str | None = None, near: float = 0.2) -> list[dict]:
    """``cross_validated`` with ``extended`` made residuals of ``on`` anew in each fold, on its training rows: alpha, mix and ``rmse``, the mean of the folds', best first.

    Week i of n is in fold ((i + 1) * k - 1) // n. Residuals are by plain moments, fits and errors by weighted ones. ``chosen`` marks the pair of the least mix, then alpha, of those within ``near`` of the best.
    One pass over the rows, whatever the grid: a fold's moments are sums of its weeks', and residuals are a change of these.
    """
    weeks, weighted, plain = _weekly(df, features, target, week, weight)
    if not weeks:
        return []
    add = lambda ms: sum(ms[1:], start=ms[0])
    fold_of = [((i + 1) * k - 1) // len(weeks) for i in range(len(weeks))]
    found: dict[tuple, list[float]] = {(a, m): [] for a in alphas for m in mixes}
    for fold in sorted(set(fold_of)):
        held = [i for i, f in enumerate(fold_of) if f == fold]
        rest = [i for i, f in enumerate(fold_of) if f != fold]
        if not rest:
            continue
        change = residual_change(add([plain[i] for i in rest]), on, extended)
        train, test = (add([weighted[i] for i in part]).through(change) for part in (rest, held))
        for a, m in found:
            found[a, m].append(test.errors(elastic_net(train, a, m))["rmse"])
    rows = [{"alpha": a, "mix": m, "rmse": float(np.mean(v)) if v else float("inf")} for (a, m), v in found.items()]
    least = min(r["rmse"] for r in rows)
    best = min((r for r in rows if r["rmse"] <= least + near), key=lambda r: (r["mix"], r["alpha"]))
    return sorted(({**r, "chosen": r is best} for r in rows), key=lambda r: (r["rmse"], r["mix"], r["alpha"]))


def residual_walk(df: DataFrame, features: list[str], on: str, extended: list[str], target: str, week: str, alpha: float, mix: float, first: int = 1, weight: str | None = None) -> DataFrame:
    """``prediction`` of each week by the penalised fit on all earlier ones, ``extended`` being residuals of ``on`` by the lines of those; null before ``first`` weeks have passed. The fits come back on the features' own scale, so rows are read once for the moments and once for the predictions."""
    weeks, weighted, plain = _weekly(df, features, target, week, weight)
    betas = {}
    for i in range(max(1, first), len(weeks)):
        change = residual_change(sum(plain[1:i], start=plain[0]), on, extended)
        train = sum(weighted[1:i], start=weighted[0]).through(change)
        beta = elastic_net(train, alpha, mix) if alpha else solve(train)
        betas[weeks[i]] = beta @ change[:-1, :-1]
    return _by_week(df, week, features, betas)


def scored(predicted: DataFrame, prediction: str, target: str, weight: str | None = None) -> DataFrame:
    """One row of weighted rmse, r2 (about the mean of all rows) and pearson of the rows that were predicted, and how many they are."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, p = F.col(target), F.col(prediction)
    known = p.isNotNull() & y.isNotNull()
    mean = predicted.where(y.isNotNull()).agg((F.sum(w * y) / F.sum(w)).alias("_mean"))
    rows = predicted.where(known).crossJoin(F.broadcast(mean)).withColumn("_w", w)  # one row
    error, dev = y - p, y - F.col("_mean")
    return rows.agg(
        F.sqrt(F.sum(F.col("_w") * error * error) / F.sum("_w")).alias("rmse"), (1 - F.sum(F.col("_w") * error * error) / F.sum(F.col("_w") * dev * dev)).alias("r2"),
        weighted_correlation(target, prediction, "_w").alias("pearson"), F.count("*").alias("n"),
    )
