"""SimHash near-dedup over a byte-position inverted index.

A text's fingerprint is the bitwise majority of its word shingles' hashes. Two fingerprints that differ in at most
BITS = 4 bits share at least 8 - 4 = 4 of their 8 positional bytes. The inverted index posts each distinct
fingerprint under positional bytes taken three at a time: under 20 of the 56 triples of positions, chosen so that any
four positions hold one of them, so every pair with four shared bytes meets in some posting list. Pairs
that meet are tallied (shared positional bytes, at least 4), counted once, under their first common triple, and verified bit by bit.

A posting list of more than LONG_LIST fingerprints is not paired up. Its members differ only in the 40 bits outside the
triple, and two of them are within four bits just if some point is within two bits of both; so each member is sent
to the 821 points within two bits of it, and all members at a point are linked to the smallest of them.
That is linear in the list and loses no connection.

Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are one node, whatever
their number. Components are found over fingerprints by alternating star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import numbered, picked, place, raw_text, space_words, stored, table

SHINGLE, BITS, LONG_LIST = 4, 4, 512
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one: within a group of positions, or two of a group and one of the next."""
    inside = lambda t, g: sum(x in g for x in t)
    return [t for t in combinations(range(8), 3) if any(inside(t, g) == 3 or inside(t, g) == 2 and inside(t, h) == 1 for g, h in zip(_GROUPS, (*_GROUPS[1:], _GROUPS[0])))]


TRIPLES = triples()


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = space_words(text)
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hashes = [xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(lo, min(n, lo + (1 << 16)))]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, and fingerprint ``fp`` of every row, as a stored table; a column ``row`` is kept."""
    names = ["doc_id", "hash", *(["row"] if "row" in docs.columns else [])]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([simhash(t) for t in raw_text(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], [*names, "fp"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), *names[2:])
    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in names)
    return stored(keyed.mapInArrow(run, f"{kinds}, fp bigint"), "simhash")


def _byte(fp: str, i: int) -> str:
    return f"(shiftrightunsigned({fp}, {8 * i}) & 255)"


def _mask(t: tuple[int, ...]) -> int:
    return sum(1 << i for i in t)


def postings(nodes: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each fingerprint under its 20 triples of positional bytes."""
    keys = [f"(shiftleft({k}L, 24) | shiftleft({_byte('fp', a)}, 16) | shiftleft({_byte('fp', b)}, 8) | {_byte('fp', c)})" for k, (a, b, c) in enumerate(TRIPLES)]
    return nodes.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))


def _verified() -> Column:
    """The join condition: within BITS, at least 8 - BITS shared positional bytes, and under the pair's first common triple."""
    x = "(l.fp ^ r.fp)"
    shared = " + ".join(f"if({_byte(x, i)} = 0, {1 << i}, 0)" for i in range(8))
    first = " ".join(f"when ({shared}) & {_mask(t)} = {_mask(t)} then {k}" for k, t in enumerate(TRIPLES))
    return F.expr(f"l.key = r.key and l.fp < r.fp and bit_count({x}) <= {BITS} and bit_count({shared}) >= {8 - BITS} and case {first} end = shiftright(l.key, 24)")


def _points() -> list[tuple[int, list[int]]]:
    """Of each triple, the differences of at most BITS / 2 bits outside its bytes."""
    found = []
    for k, t in enumerate(TRIPLES):
        free = [1 << (8 * i + j) for i in range(8) if i not in t for j in range(8)]
        some = [0, *(sum(c) for n in range(1, BITS // 2 + 1) for c in combinations(free, n))]
        found.append((k, [x - (1 << 64) if x >= 1 << 63 else x for x in some]))
    return found


def links(nodes: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints that connect all that differ in at most BITS bits, as a stored table."""
    spark = nodes.sparkSession
    posted = postings(nodes)
    long_lists = stored(posted.groupBy("key").count().where(F.col("count") > LONG_LIST).select("key"), "simhash-long")
    any_long = bool(long_lists.take(1))
    short = posted.join(long_lists, "key", "left_anti") if any_long else posted
    pairs = short.alias("l").join(short.alias("r"), _verified()).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    if any_long:
        points = spark.createDataFrame(_points(), "triple int, apart array<bigint>")  # 20 rows of 821 numbers
        sent = posted.join(long_lists, "key", "left_semi").withColumn("triple", F.expr("cast(shiftright(key, 24) as int)")).join(F.broadcast(points), "triple")
        sent = sent.select("key", "fp", F.explode("apart").alias("apart")).select("key", "fp", F.expr("fp ^ apart").alias("point"))
        # a point has at most as many members as there are points around it
        met = sent.groupBy("key", "point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).where(F.size("members") > 1)
        starred = met.select("a", F.explode("members").alias("b")).where("a < b")
        pairs = pairs.union(starred.distinct())
    return stored(pairs, "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is connected to, ``least``, for all nodes of edges ``a`` < ``b``; those that are the smallest themselves are left out.

    Large-star then small-star contractions, each round stored, until the edges no longer change.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stored(small.union(small_least.select("m", "b")).distinct().toDF("a", "b"), "simhash-stars")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("least"))


def grouped(prints: DataFrame) -> DataFrame:
    """Of each distinct fingerprint: ``fp``, and ``first``, the smallest (doc_id, hash, and row where there is one) of its component, null ids last. ``prints`` must be stored."""
    key = ["doc_id", "hash", *(["row"] if "row" in prints.columns else [])]
    nodes = stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *key)).alias("first"), F.min("doc_id").alias("low")), "simhash-nodes")
    found = components(links(nodes.select("fp")))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", "low", F.coalesce("least", "fp").alias("component"))
    roots = named.groupBy("component").agg(F.min("first").alias("first"), F.min("low").alias("low"))
    return named.select("fp", "component").join(roots, "component").select("fp", "first", F.col("low").alias("component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable; null ids count only where there is no other) of every row."""
    prints = fingerprints(docs)
    return prints.join(grouped(prints).select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, that of the smallest doc_id (a null id only where there is no other), in its own columns.

    Of rows of that doc_id the one of the smallest text hash stays, of equal rows one. Only row numbers are grouped, never texts.
    """
    held = numbered(docs, "simhash-rows")
    prints = fingerprints(held.select(F.col(place(docs, "doc_id")).alias("doc_id"), F.col(place(docs, "text")).alias("text"), "row"))
    return picked(held, grouped(prints).select("first.row").distinct(), docs)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
