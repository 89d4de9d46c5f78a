"""Linear systems over a graph of games: edges and vectors are tables, and no matrix exists anywhere.

A system has a row to a team: its degree (weights of its games) and a ridge on the diagonal, minus the weight of each pair off it. Its product with
a vector is one join of edges and vector and one sum to a team. Vectors are stored each round, so the plan does not grow and a
lost executor costs its tasks; the driver sees a few sums a round, whatever the number of teams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.sources.shared import discard, stored


def edges(games: DataFrame, target: Column, weight: Column | None = None) -> DataFrame:
    """Both directions of each pair of teams (home, away): team, opponent, ``w`` the sum of weights, ``b`` that of weighted targets as the team sees them, ``c`` weights at home less those away, ``n`` games; a stored table."""
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    way = lambda team, other, sign: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), w.alias("w"), (sign * w * target).alias("b"), (sign * w).alias("c"))
    both = games.select(F.explode(F.array(way("home", "away", 1), way("away", "home", -1))).alias("s")).select("s.*")
    return stored(both.groupBy("team", "opponent").agg(F.sum("w").alias("w"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.count("*").alias("n")), "graph-edges")[0]


def nodes(found: DataFrame) -> DataFrame:
    """A row to a team: its ``degree`` and sums ``b``, ``c`` and ``n`` over its edges."""
    return found.groupBy("team").agg(F.sum("w").alias("degree"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("n").alias("n"))


def solve(links: DataFrame, teams: DataFrame, ridge: float, *sides: str, scaled: bool = True, tolerance: float = 1e-12, rounds: int = 500) -> DataFrame:
    """``teams`` (team, degree and each right side) and for each side ``x_<side>``, the solution of (degree + ridge) x - sum of w * x of opponents = side.

    Conjugate gradients, ``scaled`` by the diagonal (better where degrees differ much) or not (better for a ridge near 0: sides that sum to 0 over each part of the graph then
    keep solutions that do); all sides go through the same joins, each with its own steps. A side is done when its residual is ``tolerance``
    of what it was; more than ``rounds`` are an error. Without a ridge the sides must sum to 0 over each part of the graph.
    """
    spark = teams.sparkSession
    d = F.col("degree") + ridge
    z = d if scaled else F.lit(1.0)
    state, old = teams, None
    for c in sides:
        state = state.withColumns({f"x_{c}": F.lit(0.0), f"r_{c}": F.col(c).cast("double")}).withColumn(f"p_{c}", F.col(f"r_{c}") / z)
    first: dict[str, float] = {}
    for _ in range(rounds):
        met = links.join(state.select(F.col("team").alias("opponent"), *[f"p_{c}" for c in sides]), "opponent")
        met = met.groupBy("team").agg(*[F.sum(F.col("w") * F.col(f"p_{c}")).alias(f"m_{c}") for c in sides])
        products, done = stored(state.join(met, "team", "left").withColumns({f"q_{c}": d * F.col(f"p_{c}") - F.coalesce(f"m_{c}", F.lit(0.0)) for c in sides}), "graph-products")
        if old:
            discard(spark, old)
        old = done
        r, p, q = ({c: F.col(f"{k}_{c}") for c in sides} for k in "rpq")
        s = products.agg(*[a.alias(f"{k}_{c}") for c in sides for k, a in (("rr", F.sum(r[c] * r[c] / z)), ("pq", F.sum(p[c] * q[c])), ("rq", F.sum(r[c] * q[c] / z)), ("qq", F.sum(q[c] * q[c] / z)))]).first()
        step, turn = {}, {}
        for c in sides:
            rr, pq, rq, qq = (s[f"{k}_{c}"] or 0.0 for k in ("rr", "pq", "rq", "qq"))
            start = first.setdefault(c, rr)
            step[c] = rr / pq if pq > 0 and rr > tolerance**2 * start else 0.0
            turn[c] = max(0.0, rr - 2 * step[c] * rq + step[c] ** 2 * qq) / rr if step[c] else 0.0
        if not any(step.values()):
            return products.drop(*[f"{k}_{c}" for k in "rpqm" for c in sides])
        state = products.withColumns({f"x_{c}": F.col(f"x_{c}") + F.lit(step[c]) * p[c] for c in sides} | {f"r_{c}": r[c] - F.lit(step[c]) * q[c] for c in sides})
        state = state.withColumns({f"p_{c}": F.col(f"r_{c}") / z + F.lit(turn[c]) * p[c] for c in sides}).drop(*[f"{k}_{c}" for k in "qm" for c in sides])
    raise ArithmeticError(f"not within {tolerance} after {rounds} rounds")


def centred(found: DataFrame, x: Column) -> DataFrame:
    """team and ``rating``: x less its mean."""
    mean = found.agg(F.avg(x).alias("_mean"))
    return found.select("team", x.alias("_x")).crossJoin(F.broadcast(mean)).select("team", (F.col("_x") - F.col("_mean")).alias("rating"))  # one row


def rounds_rating(links: DataFrame, rounds: int = 100, tolerance: float = 0.001, against: bool = False, at_once: int = 5) -> DataFrame:
    """team and ``rating``: from 0, each round makes it the mean margin plus the mean rating of opponents, until no team moves by ``tolerance`` or after ``rounds``; then centred.

    ``against`` subtracts the opponents' ratings, the sign of an older form of this rating. ``tolerance`` 0 does all rounds. ``at_once`` rounds are one plan, whose
    last values are stored; the round that ends it is told from their moves, so the result is the same for any number of them.
    """
    spark, sign = links.sparkSession, -1.0 if against else 1.0
    met_by = links.where("team <> opponent").select("team", "opponent", "w")
    state, path = nodes(links).select("team", "degree", "b", F.lit(0.0).alias("x0")), None
    while rounds > 0:
        n = min(at_once, rounds)
        for i in range(n):
            met = met_by.join(state.select(F.col("team").alias("opponent"), f"x{i}"), "opponent").groupBy("team").agg(F.sum(F.col("w") * F.col(f"x{i}")).alias("m"))
            state = state.join(met, "team", "left").withColumn(f"x{i + 1}", (F.col("b") + sign * F.coalesce("m", F.lit(0.0))) / F.col("degree")).drop("m")
        state, fresh = stored(state, "graph-rounds")
        if path:
            discard(spark, path)
        path = fresh
        moves = state.agg(*[F.max(F.abs(F.col(f"x{i + 1}") - F.col(f"x{i}"))) for i in range(n)]).first()
        still = next((i + 1 for i, m in enumerate(moves) if m is None or m < tolerance), None)
        rounds = 0 if still else rounds - n
        state = state.select("team", "degree", "b", F.col(f"x{still or n}").alias("x0"))
    return centred(state, F.col("x0"))
