"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A text is the multiset of its paragraphs (its parts between line feeds). Each paragraph
hashes to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors:

* IDENTITY lanes, 32-bit hashes of the whole paragraph under different seeds, summed modulo 2^32.
  They decide equality, in any order of paragraphs.
* SKETCH lanes, +1 or -1 for each run of up to RUN words of the paragraph by a bit of the run's hash,
  summed modulo 2^32. A run starts at every word, so an inserted or deleted word changes RUN runs at most.
  Squared differences of two sums estimate how many runs differ, so likeness is read from fingerprints alone.

As everything is a sum, ``plus`` and ``minus`` insert and delete paragraphs without the
remaining text. Null and empty text are the empty document: one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rookery.llm.common import table
from rookery.operators.windows import ordinal

IDENTITY, SKETCH, RUN = 8, 64, 4
#: At each word: it and up to RUN - 1 more, never across a line feed.
RUNS = r"(?=(\\S+(?:[^\\S\\n]+\\S+){0,%d}))\\S+" % (RUN - 1)
LOW32, FIELDS = (1 << 32) - 1, (1 << 32) + 1


def _lane(x: str) -> str:
    """A sum modulo 2^32, as a signed int."""
    return f"cast(pmod({x} + {1 << 31}L, {1 << 32}L) - {1 << 31}L as int)"


def fingerprint(text: str) -> Column:
    """The fingerprint struct of the text in SQL expression ``text``.

    Each bit of the run hashes is counted in a 32-bit field, two fields to a long, so that no carry reaches another lane.
    """
    text = f"coalesce({text}, '')"
    hashed = ", ".join(f"xxhash64(p, {i}) as h{i}" for i in range(IDENTITY // 2))
    ident = ", ".join(f"aggregate(r.ps, 0L, (a, p) -> (a + {part}) & {LOW32}L)" for i in range(IDENTITY // 2) for part in (f"(p.h{i} & {LOW32}L)", f"shiftrightunsigned(p.h{i}, 32)"))
    counts = f"transform(sequence(0, {SKETCH // 2 - 1}), k -> aggregate(r.hs, 0L, (a, x) -> a + (shiftrightunsigned(x, k) & {FIELDS}L)))"
    sketch = f"transform(flatten(transform({counts}, c -> array(c & {LOW32}L, shiftrightunsigned(c, 32)))), c -> {_lane('2 * c - size(r.hs)')})"
    # the one-element array binds both hashed lists once
    return F.expr(
        f"transform(array(struct(transform(split({text}, '\\n', -1), p -> struct({hashed})) as ps,"
        f" transform(regexp_extract_all({text}, '{RUNS}', 1), x -> xxhash64(x)) as hs)),"
        f" r -> struct(array({ident}) as ident, cast(size(r.hs) as bigint) as runs, {sketch} as sketch))[0]"
    )


def _combined(a: str, b: str, sign: str) -> Column:
    wide = f"pmod(x {sign} y, {LOW32 + 1}L)"
    return F.expr(
        f"struct(zip_with({a}.ident, {b}.ident, (x, y) -> {wide}) as ident, {a}.runs {sign} {b}.runs as runs,"
        f" zip_with({a}.sketch, {b}.sketch, (x, y) -> {_lane(f'cast(x as bigint) {sign} y')}) as sketch)"
    )


def plus(a: str, b: str) -> Column:
    """The fingerprint of both multisets of paragraphs together."""
    return _combined(a, b, "+")


def minus(a: str, b: str) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it must hold."""
    return _combined(a, b, "-")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the estimated share of word runs that two fingerprints have in common; 1 for equal ones."""
    square = lambda x: f"aggregate({x}, 0D, (s, v) -> s + cast(v as double) * v)"
    apart = square(f"zip_with({a}.sketch, {b}.sketch, (x, y) -> {_lane('cast(x as bigint) - y')})")
    both = f"({square(a + '.sketch')} + {square(b + '.sketch')})"
    return F.expr(
        f"case when {a}.ident = {b}.ident then 1D when {both} = 0 then 0D"
        f" else greatest(0D, least(1D, 1D - {apart} / {both})) end"
    )


def as_hex(fp: str) -> Column:
    """Identity lanes, number of runs and sketch lanes as lower-case hex digits."""
    wide = f"transform({fp}.ident, x -> lpad(hex(x), 8, '0'))"
    thin = f"transform({fp}.sketch, x -> lpad(hex(pmod(cast(x as bigint), 4294967296L)), 8, '0'))"
    return F.expr(f"lower(concat(array_join({wide}, ''), lpad(hex({fp}.runs), 8, '0'), array_join({thin}, '')))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its fingerprint struct in column ``fp``; other columns stay."""
    return docs.withColumn("fp", fingerprint("text"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, and the text and fp of the next row in descending doc_id (after the last: the first).

    Null ids come last; rows of one id follow each other by descending text. Ids are cut into ranges at their
    quantiles, several to each shuffle partition, and each range's window sees a copy of the first row after
    it, so only that row crosses ranges. A table of one row is followed by itself. Ids that are no whole numbers
    (strings, say) stand in their own order, for which each distinct one is given its rank.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    kind = docs.schema["doc_id"].dataType
    rows, at = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    if not isinstance(kind, T.IntegralType):
        ranks = ordinal(docs.select("doc_id").where("doc_id is not null").distinct(), [], ["doc_id"], "at")
        rows, at = rows.join(ranks, "doc_id", "left"), F.col("at")
    rows = rows.select("doc_id", "text", F.coalesce(at, F.lit(lowest)).cast("bigint").alias("at"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    # cuts are numbers, at most 4 to a shuffle partition; rows at a cut lie in the range above it
    bucket = F.expr(f"size(filter(array({', '.join(f'{c}L' if c > lowest else f'cast({lowest + 1} - 1 as bigint)' for c in cuts)}), c -> c <= at))") if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    tops = rows.groupBy("bucket").agg(F.max("at").alias("at"))  # at most one row to a range
    order = Window.orderBy(F.desc("bucket"))
    tops = tops.select(F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("before"), "at")
    heads = rows.drop("bucket").join(F.broadcast(tops), "at").groupBy("before", "at").agg(F.max("text").alias("text"))
    heads = heads.select(F.lit(None).cast(kind).alias("doc_id"), "text", "at", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    every = fingerprints(rows.withColumn("ghost", F.lit(0)).unionByName(heads))
    window = Window.partitionBy("bucket").orderBy("ghost", F.desc("at"), F.desc("text"))
    return every.select("doc_id", "text", "fp", "ghost", F.lead("text").over(window).alias("next_text"), F.lead("fp").over(window).alias("next_fp")).where("ghost = 0").drop("ghost")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their texts edited with the next document's head."""
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("bigint"))
    half = "cast(floor(n_chars / 2) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    rows = rows.withColumn("edited_fp", fingerprint("edited"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
