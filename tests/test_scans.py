"""Segmented scans against plain loops: hot keys, many keys, nulls, ties, nothing."""

import datetime
import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rookery.operators import asof, bets, scans, windows


def plain(rows):
    """Total, peak of it, greatest and latest value of each row (k, i, x) by key and order."""
    out, state = {}, defaultdict(lambda: [0, None, None, None])
    for k, i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = state[k]
        s[0] += x or 0
        s[1] = s[0] if s[1] is None else max(s[1], s[0])
        s[2] = x if s[2] is None else s[2] if x is None else max(s[2], x)
        s[3] = s[3] if x is None else x
        out[k, i] = tuple(s)
    return out


def scanned(df, blocks):
    running = {"sum": scans.total("x"), "top": scans.most("x"), "now": scans.last("x")}
    return scans.scan(df, ["k"], ["i"], running, {"peak": "sum"}, blocks=blocks)


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 500])
def test_running_values_match_a_loop(spark, blocks):
    rng = random.Random(blocks)
    keys = [None, 0, 0, 0, 0, 1, 2, *range(3, 40)]
    rows = [(rng.choice(keys), i, rng.choice([None, *range(-9, 10)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(5)
    got = {(r.k, r.i): (r.sum, r.peak, r.top, r.now) for r in scanned(df, blocks).collect()}
    assert got == plain(rows)


def test_nothing_and_one_row(spark):
    assert scanned(spark.createDataFrame([], "k int, i int, x int"), 4).count() == 0
    assert [tuple(r) for r in scanned(spark.createDataFrame([(None, 1, None)], "k int, i int, x int"), 4).select("sum", "peak", "top", "now").collect()] == [(0, 0, None, None)]


def test_one_key_is_many_tasks_work(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("i"), (F.hash("id") % 10).alias("x"))
    runs = [r["count"] for r in scans.runs(df, ["k"], ["i"]).groupBy("_run").count().collect()]
    assert len(runs) == 65 and max(runs) < 20_000 / 16
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in scanned(df, None).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(tasks) == 8 and max(tasks) < 20_000 / 4


def test_repeated_rows_stay_and_share_a_run(spark):
    df = spark.createDataFrame([(1, 5, 1)] * 300 + [(1, 6, 2)] * 3, "k int, i int, x int")
    got = sorted((r.i, r.sum) for r in scanned(df, 8).collect())
    assert got == [(5, n) for n in range(1, 301)] + [(6, 302), (6, 304), (6, 306)]


def test_a_ledger_of_one_key_folds_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["win", "loss", "push", None]), float(rng.randint(1, 50))) for i in range(3000)]
    df = spark.createDataFrame([("all", *r) for r in rows], "k string, i int, result string, stake double")
    got = {r.i: (r.x, r.equity, r.peak, r.drawdown) for r in bets.backtest(df, ["k"], ["i"]).collect()}
    equity = peak = 0.0
    for x, (i, result, stake) in enumerate(rows, 1):
        equity += {"win": 0.909 * stake, "loss": -stake}.get(result, 0.0)
        peak = max(peak, equity)
        assert got[i] == pytest.approx((x, equity, peak, peak - equity), abs=1e-6)


def test_a_bankroll_of_one_key_and_its_ruin(spark):
    rng = random.Random(4)
    rows = [(i, 0.02, rng.choice([-1.0, 0.9, None])) for i in range(2000)] + [(2000, 1.0, -1.0), (2001, 0.5, 3.0)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, i int, share double, outcome double")
    got = {r.i: r.bankroll for r in windows.bankroll(df, ["k"], ["i"], "share", "outcome").collect()}
    left = 1000.0
    for i, share, outcome in rows:
        left *= 1 + share * (outcome or 0.0)
        assert got[i] == pytest.approx(left, rel=1e-9)
    assert got[2001] == 0.0


def test_joins_of_one_hot_key_match_a_search(spark):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    quotes = [(i, 7, rng.randrange(50_000), float(i)) for i in range(4000)] + [(9000 + i, 8, 10 * i, float(-i)) for i in range(5)] + [(9100, 7, None, 1.0), (9101, None, 5, 1.0)]
    kicks = [(i, 7, rng.randrange(-100, 51_000)) for i in range(2000)] + [(5000, 8, 25), (5001, 9, 25), (5002, None, 25), (5003, 7, None)]
    q = spark.createDataFrame([(i, g, None if t is None else at(t), v) for i, g, t, v in quotes], "quote_id int, game int, ts timestamp, line double")
    k = spark.createDataFrame([(i, g, None if t is None else at(t)) for i, g, t in kicks], "kick_id int, game int, kick timestamp")
    lines = defaultdict(list)
    for i, g, t, v in quotes:
        if g is not None and t is not None:
            lines[g].append((t, i, v))
    for x in lines.values():
        x.sort()
    late, close = {}, {}
    for i, g, t in kicks:
        x = lines[g] if g is not None else []
        n = 0 if t is None else bisect_right(x, (t, 10**9))
        late[i] = (x[n - 1][2], True) if n else (x[-1][2], False) if x else (None, False)
        if t is not None and x:
            close[i] = min((abs(a - t), b) for a, b, _ in x)[1]
    found = asof.asof(k, q, "game", "kick", "ts", "line", "quote_id", "kick_id")
    assert {r.kick_id: (r.line, r.on_time) for r in found.collect()} == late
    assert {r.kick_id: r.quote_id for r in asof.nearest(k, q, "game", "kick", "ts", "kick_id", "quote_id").collect()} == close
