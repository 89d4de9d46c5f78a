"""As-of, interval, nearest and cascading joins: an equality on the key, then one aggregate, window or segmented scan inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.times import within_minutes
from rookery.operators import scans


def _timeline(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, kept: list[str], tie: str) -> DataFrame:
    """Rows of both sides in one table: key, time ``_t``, ``_side`` (0 right, 1 left), ``_tie``, and either row as a struct. Null keys and times of the right side match nothing."""
    row, own = F.struct(*kept), F.struct(*left.columns)
    r = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), row.alias("_right"))
    l = left.select(F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(1).alias("_side"), own.alias("_left"))  # noqa: E741
    return l.unionByName(r, allowMissingColumns=True)


def _latest(line: DataFrame, *order: str, name: str = "_right") -> DataFrame:
    """``name``: the last row of the right side so far. A key's time line is cut into runs, so a hot key is many tasks' work."""
    return scans.scan(line.withColumn("_seen", F.col("_right")), ["_key"], list(order), {name: scans.last("_seen")}).drop("_seen")


def asof(left: DataFrame, quotes: DataFrame, key: str, at: str, ts: str, value: str, tie: str, left_id: str, fallback: bool = True) -> DataFrame:
    """Every row of ``left`` with its latest quote at or before ``at``; with ``fallback``, else its latest quote at any time.

    Both sides lie on one time line, read in order, run by run, so no pair of them is formed; the fallback is one row to a key.
    """
    line = _timeline(left, quotes, key, at, ts, [value, ts], tie)
    found = _latest(line, "_t", "_side", "_tie").where("_side = 1").select("_key", "_left", "_right")
    best = F.col("_right")
    if fallback:
        known = quotes.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(value, ts), F.struct(ts, tie)).alias("_any"))
        found, best = found.join(known, "_key", "left"), F.coalesce("_right", "_any")
    found = found.withColumns({"_best": best, "on_time": F.col("_right").isNotNull()})
    return found.select(*[F.col("_left")[c].alias(c) for c in left.columns], F.col("_best")[value].alias(value), F.col("_best")[ts].alias(ts), "on_time")


def asof_week(left: DataFrame, ratings: DataFrame, key: str, week: str, rating_week: str, value: str) -> DataFrame:
    """The latest rating of a week at or before the row's; of several of that week the greatest. Repeated rows stay apart."""
    found = asof(left, ratings.where(F.col(value).isNotNull()), key, week, rating_week, value, value, key, fallback=False)
    return found.select(*left.columns, value)


def in_window(left: DataFrame, quotes: DataFrame, key: str, kick: str, ts: str, before: int = 60, after: int = 5) -> DataFrame:
    """Quotes from ``before`` minutes before a kickoff to ``after`` minutes after it. The bounds are a parameter, as jobs differ on them.

    Time is cut into slots as long as a window, which thus lies in two of them: the join is an equality on key and slot.
    """
    slot = lambda x: F.floor(F.unix_micros(x) / F.lit(max(1, before + after) * 60_000_000))
    edge = lambda minutes: F.col(kick) + F.make_dt_interval(mins=F.lit(minutes))
    starts = left.withColumn("_slot", F.explode(F.array_distinct(F.array(slot(edge(-before)), slot(edge(after))))))
    return starts.join(quotes.withColumn("_slot", slot(F.col(ts))), [key, "_slot"]).where(within_minutes(F.col(ts), F.col(kick), before, after)).drop("_slot")


def window_or_all(left: DataFrame, quotes: DataFrame, key: str, kick: str, ts: str, left_id: str, before: int = 60, after: int = 5) -> DataFrame:
    """The quotes of a kickoff's window, or all its quotes if the window is empty; ``inside`` tells which."""
    near = in_window(left, quotes, key, kick, ts, before, after).withColumn("inside", F.lit(True))
    empty = left.join(near.select(left_id).distinct(), left_id, "left_anti")
    return near.unionByName(empty.join(quotes, key).withColumn("inside", F.lit(False)))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, left_id: str, tie: str) -> DataFrame:
    """The row of ``right`` nearest in time, of those as near the one of the smallest ``tie``: the last one before or the first one after on a common time line."""
    kept = [c for c in right.columns if c != key]
    first = right.groupBy(F.col(key).alias("_k"), F.col(ts).alias("_ts")).agg(F.min_by(F.struct(*kept), F.struct(tie)).alias("_row")).select(F.col("_k").alias(key), "_row.*")  # of one time the smallest tie
    line = _timeline(left, first, key, at, ts, kept, tie)
    line = _latest(line.withColumn("_back", -F.unix_micros("_t")), "_t", "_side", name="_a")
    found = _latest(line, "_back", "_side", name="_b").where("_side = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col(c)[ts]) - F.unix_micros(F.col("_left")[at]))
    ranked = lambda c: F.when(F.col(c).isNotNull() & F.col("_left")[at].isNotNull(), F.struct(gap(c).alias("gap_us"), F.col(c)[tie].alias("tie"), F.col(c).alias("row")))
    found = found.withColumn("_best", F.least(ranked("_a"), ranked("_b"))).where("_best is not null")
    return found.select(*[F.col("_left")[c].alias(c) for c in dict.fromkeys((left_id, key, at))], *[F.col("_best.row")[c].alias(c) for c in kept], F.col("_best.gap_us").alias("gap_us"))


def cascade(left: DataFrame, tiers: list[DataFrame], left_id: str, value: str) -> DataFrame:
    """The first tier's match of each row; ``tiers`` have left_id and value, in order of precedence."""
    every = None
    for rank, t in enumerate(tiers):
        t = t.select(left_id, F.col(value).alias("_value"), F.lit(rank).alias("tier"))
        every = t if every is None else every.unionByName(t)
    best = every.where("_value is not null").groupBy(left_id).agg(F.min(F.struct("tier", "_value")).alias("b"))
    return left.join(best, left_id, "left").select(*[left[c] for c in left.columns], F.col("b._value").alias(value), F.col("b.tier").alias("tier"))


def lone_candidate(left: DataFrame, right: DataFrame, on: list[str], at: str, date: str, left_id: str, value: str, days: int) -> DataFrame:
    """The match within ``days`` days where there is just one."""
    near = left.join(right, on).where(F.abs(F.datediff(F.col(at), F.col(date))) <= days)
    found = near.groupBy(left_id).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
    return left.join(found, left_id, "left")
