"""Mixing sources to target weights: how often each document is taken.

A document's size is its number of words. Sources in the order of their names (null last) weigh 5, 2, 1 in turn and share all
words; no target is over CAP times its source, and what is over goes to the others by weight. That level is found by
rounds over the table of sources, of which the driver sees three sums. A source's rate is its target by its words:
each document is taken floor(rate) times, and once more by a coin, a hash of its id and text, whose chance is the rest of the rate.

Independent coins leave a source far from its target where few documents or a long one hold its words. So a source's
coins are compared with one threshold that is set by words: of its documents in the order of their coins those are taken
once more whose running words come nearest to the rest of the target. The running words are a segmented scan, so a source may hold any share of the rows.

Null texts have size 0; null ids are like any other; rows equal in id and text have equal coins and are told apart by no more
than their order. An empty table gives an empty result; so do sources without words a target of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import numbered, place, stored, table
from rookery.operators import scans

WEIGHTS, CAP, WORD = (5, 2, 1), 3, r"[^\x20\x09-\x0D]+"


def coin(doc_id: Column, text: Column) -> Column:
    """64 bits of a hash of a document, as hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 16)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source of a stored table (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nameless", F.col("source").isNull().cast("int"))
    placed = scans.scan(stored(by_source, "mixing-sources"), [], ["nameless", "source"], {"place": scans.total(F.lit(1))})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    held = stored(placed.select("source", "source_size", weight.cast("long").alias("weight")), "mixing-weights")
    level, full = 0.0, None
    while True:
        over = F.col("source_size") * cap <= F.col("weight") * level
        s = held.agg(F.sum("source_size").alias("all"), F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, F.col("source_size") * cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not s["all"] or s["full"] == full:
            break
        level, full = (s["all"] - (s["held"] or 0)) / s["free"], s["full"]
    return held.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def shares(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of each row of ``docs``: the columns ``kept``, size, source_size, target, copies and taken."""
    names = [f"k{i}" for i in range(len(kept))]
    sizes = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), coin(F.col("doc_id"), F.col("text")).alias("coin"),
    )
    sizes = stored(sizes, "mixing-sizes")
    run = scans.scan(sizes, ["source"], ["coin"], {"so_far": scans.total("size")})
    goal = targets(sizes, weights, cap).withColumnRenamed("source", "of")
    both = run.join(goal, run.source.eqNullSafe(goal.of))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - times * F.col("source_size")
    once_more = (F.col("size") > 0) & (F.col("so_far") - F.col("size") / 2 <= rest)
    copies = (times + once_more.cast("long")).alias("copies")
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, in its own columns."""
    held = numbered(docs, "mixing-rows")
    inner = held.select(*[F.col(place(docs, c)).alias(c) for c in ("doc_id", "text", "source")], "row")
    copies = shares(inner, ("row",), weights, cap).where("copies > 0").select("row", "copies")
    every = held.join(copies.hint("merge"), "row").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return every.drop("row", "copies", "copy").toDF(*docs.columns)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all documents takes."""
    return shares(table(spark, sf_dir, "documents"))


_SIZES = "s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as size, substr(md5(concat(coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))), 1, 16) as coin from documents)"

#: A source is full at a level of its own, CAP times its words by its weight; in the order of these the first level that the sources left cannot reach is the mix's.
ORACLE = f"""with {_SIZES}, n as (select source, cast(sum(size) as bigint) as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s group by 1),
  f as (select *, 3.0 * source_size / weight as full_at, sum(source_size) over () as every from n),
  l as (select *, (every - 3 * coalesce(sum(source_size) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) as level, row_number() over (order by full_at, source nulls last) as place from f),
  t as (select source, source_size, least(3.0 * source_size, weight * (select arg_min(level, place) filter (where level <= full_at) from l))::double as target from n),
  r as (select s.*, sum(size) over (partition by source order by coin rows unbounded preceding) as so_far from s),
  c as (select r.doc_id, r.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as times, r.so_far from r join t on r.source is not distinct from t.source)
  select doc_id, cast(size as bigint) as size, source_size, target, cast(times + (size > 0 and so_far - size / 2 <= target - times * source_size)::int as bigint) as copies, cast(size * (times + (size > 0 and so_far - size / 2 <= target - times * source_size)::int) as bigint) as taken from c"""
