"""Closing quotes by stream and correction against the batch form."""

import datetime
import random

from rookery.streaming import closing
from rookery.streaming.quotes import stream

START = datetime.datetime(2024, 1, 1)
QUOTES = "quote_id bigint, game bigint, ts timestamp, line double"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def landed(spark, tmp_path, rows, files):
    size = -(-len(rows) // files)
    for i in range(files):
        part = [(q, g, at(t), v) for q, g, t, v in rows[i * size : (i + 1) * size]]
        spark.createDataFrame(part, QUOTES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def drain(df, name, path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def plain(rows, kicks):
    out = {}
    for g, k in kicks:
        fit = [(t, q, v) for q, game, t, v in rows if game == g and t <= k]
        out[g] = (max(fit)[2], at(max(fit)[0])) if fit else (None, None)
    return out


def test_stream_and_correction_equal_the_batch_form_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    kicks = [(g, 60 * g + 30) for g in range(12)] + [(50, 100), (51, 90_000)]  # one without quotes, one far ahead
    rows = [(i, rng.choice([*range(12), 51, 99]), rng.randrange(800), float(i)) for i in range(600)]
    rows.sort(key=lambda r: r[2] + rng.randrange(-40, 40))  # nearly in order, some too late
    rows[550:550] = [rows.pop(5), rows.pop(20)]  # and some far too late
    landed(spark, tmp_path, rows, 10)
    kick = spark.createDataFrame([(g, at(m)) for g, m in kicks], "game bigint, kick timestamp")
    closed = drain(closing.closing(stream(spark, f"{tmp_path}/in", QUOTES), kick, live=10 * 86_400), "closed", f"{tmp_path}/c")
    quotes = spark.read.schema(QUOTES).parquet(f"{tmp_path}/in")
    late = {r.game for r in closing.late_games(closed, quotes, kick).collect()}
    done = {r.game: (r.line, r.ts) for r in closed.collect()}
    want = plain(rows, kicks)
    assert done and late and len(late) < 14 and 51 in late and 99 not in done  # some closed in time, some did not
    assert all(done[g] == want[g] for g in done if g not in late)
    for found in (closing.corrected(closed, quotes, kick), closing.batch_closing(quotes, kick)):
        assert {r.game: (r.line, r.ts) for r in found.collect()} == want


def test_a_restart_closes_no_game_twice(spark, tmp_path):
    kick = spark.createDataFrame([(1, at(10)), (2, at(500))], "game bigint, kick timestamp")
    landed(spark, tmp_path, [(1, 1, 5, 1.0), (2, 1, 9, 2.0), (3, 2, 100, 3.0)], 1)
    df = closing.closing(stream(spark, f"{tmp_path}/in", QUOTES), kick)
    out = f"{tmp_path}/out"
    run = lambda: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    landed(spark, tmp_path, [(4, 2, 700, 4.0)], 1)
    run()
    run()
    got = sorted((r.game, r.line, r.seen) for r in spark.read.parquet(out).collect())
    assert got in ([(1, 2.0, 2)], [(1, 2.0, 2), (2, 3.0, 2)])


def test_latest_quotes_are_told_once_and_forgotten_after_their_time_to_live(spark, tmp_path):
    landed(spark, tmp_path, [(1, 1, 0, 1.0), (2, 1, 5, 2.0), (3, 1, 3, 3.0), (4, 2, 600, 4.0), (5, 3, 700, 5.0), (6, 1, 701, 6.0)], 6)
    got = drain(closing.latest_with_ttl(stream(spark, f"{tmp_path}/in", QUOTES)), "latest_ttl", f"{tmp_path}/c", "update")
    rows = sorted((r.game, r.quote_id, r.seen) for r in got.collect())
    assert [r[:2] for r in rows] == [(1, 1), (1, 2), (1, 6), (2, 4), (3, 5)]
    assert dict((q, s) for _, q, s in rows)[6] == 1  # started anew


def test_the_latest_of_a_batch_is_found_by_arrays():
    import numpy as np
    import pandas as pd

    micros, latest = closing._tools()
    us = micros(pd.Series([at(5), at(7), at(7), at(9), at(7)]))
    ids = np.array([9, 4, 8, 1, 6])
    assert us[1] - us[0] == 120_000_000
    assert latest(us, ids, us <= us[1]) == 2 and latest(us, ids, us == us) == 3
    assert latest(us, ids, us < 0) is None
