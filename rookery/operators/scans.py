"""Running values of one ordered key over many tasks: a segmented scan.

Rows are cut by key and order into runs of about equal size. Inside a run each key's running values start afresh; a run then hands
on the values at its last row, and what was handed on is merged in order and added to the next run's rows. Only the first key of a run can have
begun before it, so what is handed on is one row to a run, whatever the number of keys, and a key of any size is spread like any others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rookery.functions.numbers import Number, col

#: Rows that are looked at for each cut between two runs.
SAMPLED = 16


@dataclass(frozen=True)
class Running:
    """A running value: ``inside`` a run over a window; ``folded``, the values handed on by all runs so far over a window; ``joined``, what a run was handed (null if nothing) and the value inside it."""

    inside: Callable[[WindowSpec], Column]
    folded: Callable[[str, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def total(x: Number) -> Running:
    """The sum so far; nulls add nothing."""
    return Running(lambda w: F.sum(F.coalesce(col(x), F.lit(0))).over(w), lambda name, w: F.sum(name).over(w), lambda before, now: F.coalesce(before, F.lit(0)) + now)


def most(x: Number) -> Running:
    """The greatest value so far."""
    return Running(lambda w: F.max(col(x)).over(w), lambda name, w: F.max(name).over(w), lambda before, now: F.greatest(before, now))


def last(x: Number) -> Running:
    """The latest value that is not null."""
    return Running(lambda w: F.last(col(x), ignorenulls=True).over(w), lambda name, w: F.last(name, ignorenulls=True).over(w), lambda before, now: F.coalesce(now, before))


def _searched(cuts: list[str], row: str, lo: int, hi: int) -> str:
    """The SQL of how many of the ascending ``cuts`` are less than ``row``, by halves."""
    if lo == hi:
        return str(lo)
    half = (lo + hi) // 2
    return f"if({cuts[half]} < {row}, {_searched(cuts, row, half + 1, hi)}, {_searched(cuts, row, lo, half)})"


def runs(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` and ``_run``: rows in the order of keys and ``order`` (nulls first), cut into about ``blocks`` runs (as many as shuffle partitions, but 64 to 256); equal rows are of one run.

    The cuts come from the rows that hash lowest and decide the balance only. At most ``blocks`` of them reach the driver, as text, and stand in the plan as constants.
    """
    blocks = blocks or min(256, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    by = [*keys, *order]
    some = df.select(*by).orderBy(F.xxhash64(*by), *by).limit(SAMPLED * blocks)
    cuts = some.agg(F.sort_array(F.collect_list(F.struct(*by))).alias("_all")).select(F.expr(f"filter(_all, (c, i) -> i % {SAMPLED} = {SAMPLED - 1})").alias("_cuts"))
    texts = cuts.select(F.transform("_cuts", lambda c: F.array(*[F.hex(c[n].cast("string")) for n in by])).alias("_cuts")).first()._cuts
    kinds = [df.schema[n].dataType.simpleString() for n in by]
    found = [", ".join(f"cast(null as {kind})" if x is None else f"cast(cast(x'{x}' as string) as {kind})" for x, kind in zip(c, kinds)) for c in texts]
    return df.withColumn("_run", F.expr(_searched([f"struct({c})" for c in found], "struct(" + ", ".join(f"`{n}`" for n in by) + ")", 0, len(found))))


def scan(df: DataFrame, keys: list[str], order: list[str], running: dict[str, Running], peaks: dict[str, str] | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with running values of each key's rows by ``order``, ascending and nulls first; rows that tie in all of it follow each other in any order.

    ``peaks`` names the greatest value so far of a running ``total``. Null keys are a key. Nothing is gathered: a run is one task's, and a run hands on one row.
    """
    peaks = peaks or {}
    keys_of = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    w = Window.partitionBy("_run", *keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = runs(df, keys, order, blocks).withColumns({"_keys": keys_of, "_place": F.row_number().over(w), **{f"_in_{n}": r.inside(so_far) for n, r in running.items()}})
    inside = inside.withColumns({f"_in_{n}": F.max(f"_in_{of}").over(so_far) for n, of in peaks.items()})

    names = [*running, *peaks]
    ends = inside.groupBy("_run").agg(F.min("_keys").alias("_first"), F.max_by(F.struct("_keys", *[f"_in_{n}" for n in names]), F.struct("_keys", "_place")).alias("_end"))
    ends = ends.select("_run", "_first", "_end.*")
    along = Window.partitionBy("_keys").orderBy("_run")
    up_to, before = (along.rowsBetween(Window.unboundedPreceding, i) for i in (Window.currentRow, -1))
    rise = {f"_in_{n}": F.col(f"_in_{n}") + F.coalesce(F.sum(f"_in_{of}").over(before), F.lit(0)) for n, of in peaks.items()}
    ends = ends.withColumns(rise) if peaks else ends
    ends = ends.withColumns({**{f"_in_{n}": r.folded(f"_in_{n}", up_to) for n, r in running.items()}, **{f"_in_{n}": F.max(f"_in_{n}").over(up_to) for n in peaks}})
    each = Window.orderBy("_run")  # one row to a run
    handed = ends.select("_run", "_first", F.lag(F.struct("_keys", *[f"_in_{n}" for n in names])).over(each).alias("_was")).where(F.col("_was._keys").eqNullSafe(F.col("_first")))
    handed = handed.select(F.col("_run").alias("_at"), "_first", *[F.col(f"_was._in_{n}").alias(f"_was_{n}") for n in names])

    both = inside.join(F.broadcast(handed), (F.col("_run") == F.col("_at")) & F.col("_keys").eqNullSafe(F.col("_first")), "left")  # at most ``blocks`` rows
    out = {n: r.joined(F.col(f"_was_{n}"), F.col(f"_in_{n}")) for n, r in running.items()}
    out |= {n: F.greatest(F.col(f"_was_{n}"), F.col(f"_in_{n}") + F.coalesce(F.col(f"_was_{of}"), F.lit(0))) for n, of in peaks.items()}
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])
