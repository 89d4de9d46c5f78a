"""Closing quotes of games as a stream, and the correction for what came too late for it.

State holds one quote of a game: the latest at or before its kickoff so far, and how many quotes it has seen. A game's timer fires once the watermark has passed its
kickoff and a grace; the closing quote is then emitted, and the state goes. Quotes that come later than that are dropped
by the stream, and so are quotes of games whose time to live is over. The correction finds the games of which more quotes have landed than the stream had seen,
or which it has not closed, and computes just these anew from what landed: with them the result is that of the batch form, in whatever order quotes came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.operators.asof import asof

CLOSED = "game bigint, line double, ts timestamp, quote_id bigint, seen bigint"
_STATE = "line double, at bigint, quote_id bigint, seen bigint, kick bigint"


def _tools():
    """Functions of their own, so that they travel with a step to workers that lack this module."""

    def micros(times) -> np.ndarray:
        """Microseconds since 1970. Arrays, not series: a batch holds few quotes of a game, and there are as many batches as games."""
        return times.to_numpy("datetime64[us]").astype("int64")

    def latest(us: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> int | None:
        """The place of the latest quote that fits, of equal times that of the greatest number; None where none fits."""
        if not fit.any():
            return None
        at = (fit & (us == us[fit].max())).nonzero()[0]
        return int(at[ids[at].argmax()])

    return micros, latest


def closing(quotes: DataFrame, kicks: DataFrame, late: str = "10 minutes", grace: int = 60, live: int = 14 * 86_400) -> DataFrame:
    """A stream of CLOSED from a stream of quotes (game, ts, quote_id, line) and a table of kickoffs (game, kick), one to a game.

    A game closes ``grace`` seconds after its kickoff by the watermark, ``late`` behind the latest quote; one whose kickoff is more than ``live`` seconds ahead of its first quote closes at that
    time to live. ``line`` is null where no quote came at or before the kickoff. Of equal times the greatest quote_id counts. Games without a kickoff are left out.
    """
    import pandas as pd

    _micros, _latest = _tools()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            line, at, quote_id, seen, _ = state.get
            state.remove()
            yield pd.DataFrame({"game": [key[0]], "line": [None if at is None else line], "ts": [pd.NaT if at is None else pd.Timestamp(at, unit="us")], "quote_id": pd.array([quote_id], "Int64"), "seen": [seen]})
            return
        line, at, quote_id, seen, kick = state.get if state.exists else (None, None, None, 0, None)
        for batch in batches:
            if not len(batch):
                continue
            us, start = _micros(batch["ts"]), _micros(batch["kick"])
            first, seen = int(us.min()), seen + len(batch)
            kick = int(start[0]) if kick is None else kick
            top = _latest(us, batch["quote_id"].to_numpy(), us <= start)
            if top is not None and (at is None or (int(us[top]), int(batch["quote_id"].iat[top])) > (at, quote_id)):
                line, at, quote_id = batch["line"].iat[top], int(us[top]), int(batch["quote_id"].iat[top])
                line = None if pd.isna(line) else float(line)
            if not state.exists:
                kick = min(kick, first + live * 1_000_000)
            state.update((line, at, quote_id, seen, kick))
        if kick is None:  # nothing but empty batches
            return
        state.setTimeoutTimestamp(max(kick // 1000 + grace * 1000, state.getCurrentWatermarkMs() + 1))
        yield from ()

    both = quotes.select("game", "ts", "quote_id", "line").withWatermark("ts", late).join(kicks.select("game", "kick"), "game")
    return both.groupBy("game").applyInPandasWithState(step, CLOSED, _STATE, "append", "EventTimeTimeout")


def latest_with_ttl(quotes: DataFrame, late: str = "10 minutes", live: int = 3600) -> DataFrame:
    """The latest quote of each game whenever a newer one comes (update mode); a game without quotes for ``live`` seconds by the watermark is forgotten and starts anew."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was = old = state.get if state.exists else (None, None, None, 0)
        for batch in batches:
            if not len(batch):
                continue
            top = batch.assign(us=batch["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "quote_id"]).iloc[-1]
            line, at, quote_id, seen = was
            new = at is None or (int(top.us), int(top.quote_id)) > (at, quote_id)
            was = (None if pd.isna(top.line) else float(top.line), int(top.us), int(top.quote_id), seen + len(batch)) if new else (line, at, quote_id, seen + len(batch))
        if was[1] is None:
            return
        state.update(was)
        state.setTimeoutTimestamp(max(was[1] // 1000 + live * 1000, state.getCurrentWatermarkMs() + 1))
        if was[:3] != old[:3]:
            yield pd.DataFrame({"game": [key[0]], "line": [was[0]], "ts": [pd.Timestamp(was[1], unit="us")], "quote_id": [was[2]], "seen": [was[3]]})

    return quotes.select("game", "ts", "quote_id", "line").withWatermark("ts", late).groupBy("game").applyInPandasWithState(step, CLOSED, "line double, at bigint, quote_id bigint, seen bigint", "update", "EventTimeTimeout")


def late_games(closed: DataFrame, landed: DataFrame, kicks: DataFrame) -> DataFrame:
    """Games with a kickoff of which more quotes have landed than the stream had seen, or which it has not closed: one count of what landed, no quotes."""
    counts = landed.where(F.col("ts").isNotNull()).groupBy("game").agg(F.count("*").alias("_n")).join(kicks.select("game"), "game", "left_semi")
    return counts.join(closed.select("game", "seen"), "game", "left").where(F.col("seen").isNull() | (F.col("seen") != F.col("_n"))).select("game")


def corrected(closed: DataFrame, landed: DataFrame, kicks: DataFrame) -> DataFrame:
    """game, line and ts: what the stream has closed, with its late games computed anew from their landed quotes alone, and null for kickoffs without any quote."""
    late = late_games(closed, landed, kicks)
    again = batch_closing(landed.join(late, "game", "left_semi"), kicks.join(late, "game", "left_semi"))
    fine = closed.join(late, "game", "left_anti").select("game", "line", "ts")
    silent = kicks.select("game").join(landed.where(F.col("ts").isNotNull()).select("game"), "game", "left_anti").select("game", F.lit(None).cast("double").alias("line"), F.lit(None).cast("timestamp").alias("ts"))
    return fine.unionByName(again).unionByName(silent)


def batch_closing(landed: DataFrame, kicks: DataFrame) -> DataFrame:
    """The same from all quotes at once."""
    return asof(kicks.select("game", "kick"), landed, "game", "kick", "ts", "line", "quote_id", "game", fallback=False).select("game", "line", "ts")
