"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of its notice's words. A match holds at least CONTAINMENT of them. Blocks, as sets of words, are of two kinds:

* lines. Of each line the closest template gives a label (of equal ones the one with more words, then the greatest label).
* stretches of a text's word sequence, wherever its lines break, of at most a template's words / CONTAINMENT words.
  Every stretch over the threshold is found; of overlapping ones a label is dropped only if another holds all
  its matched words and more of its own template's, or more words. These are the notices, in columns of their own.

The join is exact and never compares all pairs: template words are ordered by how often the whole corpus has them, rarest
first; a match must hold one of the template's first ``size - need + 1`` words (prefix filter), must have ``need``
words at least (length filter), and after the first shared word both sides must have enough words left
(positional filter). Survivors are verified on their whole sets. Stretches are joined as tiles of STRIDE * 4 words, of which
each answers for the stretches that start in its second quarter, so a tile is bounded however long the text.

Null and empty texts have no words, an empty table gives an empty result. Texts of any length are read whole; other columns,
whatever their names, do not matter. Rows of a repeated doc_id are scanned each for itself.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import alnum_words, raw_text, stored, table

CONTAINMENT = 0.8
# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Labels and the wording of common notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "Released into the public domain under CC0 1.0 Universal"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission"),
)


def template_words() -> list[tuple[str, list[bytes]]]:
    return [(label, sorted(set(alnum_words(text.encode())))) for label, text in TEMPLATES]


def _span(text: str) -> int:
    """The most words a stretch of a notice may have."""
    return math.ceil(len(alnum_words(text.encode())) / CONTAINMENT)


STRIDE = max(_span(text) for _, text in TEMPLATES)


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often all texts have each word of a small vocabulary."""

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for raw in raw_text(batch):
                total.update(w for w in alnum_words(raw) if w in vocabulary)
        words = [w.decode() for w in total]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in counted.collect()}  # at most a row to a word of the templates


def places(words: list[bytes], phrases=PHRASES) -> tuple[list[int], list[str]]:
    """First words of all places of all phrases, sorted, and the labels found."""
    line = b" " + b" ".join(words) + b" "
    found, labels = [], set()
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at, seen, n = line.find(needle), 0, 0
        while at >= 0:
            n += line.count(b" ", seen, at)  # words since the last place
            seen = at
            found.append(n)
            labels.add(label)
            at = line.find(needle, at + 1)
    return sorted(found), sorted(labels)


def tiles_of(words: list[bytes], rank: dict[bytes, int]) -> list[dict]:
    """Tiles of a word sequence that hold a template word in their second quarter: the template words' places and ranks, and the set of ranks."""
    at = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
    by_stride = defaultdict(list)
    for i, r in at:
        by_stride[i // STRIDE].append((i, r))
    out = []
    for q in by_stride:
        held = [x for k in range(q - 1, q + 3) for x in by_stride.get(k, ())]
        out.append({"tile": q, "places": [i for i, _ in held], "words": [r for _, r in held], "ranks": sorted({r for _, r in held})})
    return out


def notices(tile: int, places: list[int], words: list[int], wanted: list[tuple[str, frozenset, int, int]]) -> list[tuple[str, float]]:
    """label and containment of the notices that start in a tile's second quarter; ``wanted`` has label, ranks, need and span of the templates to look for."""
    found = []
    for label, ranks, need, span in wanted:
        mine = [(i, r) for i, r in zip(places, words) if r in ranks]
        for k, (start, _) in enumerate(mine):
            inside = [(i, r) for i, r in mine[k : k + span] if i < start + span]
            held = frozenset(r for _, r in inside)
            if len(held) >= need:
                found.append((label, start, inside[-1][0], held, len(held) / len(ranks)))
    own = [x for x in found if x[1] // STRIDE == tile]
    above = lambda a, b: a[1] <= b[2] and b[1] <= a[2] and a[3] >= b[3] and (len(a[3]) > len(b[3]) or a[4] > b[4])
    return sorted({(x[0], x[4]) for x in own if not any(above(y, x) for y in found)})


def blocks_of(docs: DataFrame, rank: dict[bytes, int], prefixes: set[bytes]) -> DataFrame:
    """doc_id, the phrase results, the lines with a prefix word (their number of distinct words, and their template words as ranks in order), and the tiles of texts with one."""

    def run(batches):
        import pyarrow as pa

        numbers_of = pa.list_(pa.int32())
        kind = pa.list_(pa.struct([("words", pa.int32()), ("ranks", numbers_of)]))
        tile_kind = pa.list_(pa.struct([("tile", pa.int32()), ("places", numbers_of), ("words", numbers_of), ("ranks", numbers_of)]))
        for batch in batches:
            n_words, n_base, first, last, labels, blocks, tiles = [], [], [], [], [], [], []
            for raw in raw_text(batch):
                every, held = [], []
                for line in raw.split(b"\n"):
                    words = alnum_words(line)
                    every += words
                    if not prefixes.isdisjoint(words):
                        distinct = set(words)
                        held.append({"words": len(distinct), "ranks": sorted(rank[w] for w in distinct if w in rank)})
                tiles.append([] if prefixes.isdisjoint(every) else tiles_of(every, rank))
                starts, found = places(every)
                n_words.append(len(every)), n_base.append(len(starts)), labels.append(",".join(found)), blocks.append(held)
                first.append(starts[0] if starts else None), last.append(starts[-1] if starts else None)
            numbers = [pa.array(v, pa.int64()) for v in (n_words, n_base, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(labels, pa.string()), pa.array(blocks, kind), pa.array(tiles, tile_kind)], NAMES)

    names = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {names}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, blocks array<struct<words:int,ranks:array<int>>>, tiles array<struct<tile:int,places:array<int>,words:array<int>,ranks:array<int>>>")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks", "tiles"]


def joined(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """The set-similarity join: ``blocks`` (row, block, words, ranks) with ``templates`` (template, label, ranks, need), as row, block, template, label, shared words and size; pairs repeat for each prefix word they share."""
    left = blocks.select("row", "block", "words", "ranks", F.posexplode("ranks").alias("at", "rank"))
    right = templates.select("template", "label", F.col("ranks").alias("wanted"), "need", F.posexplode(F.expr("slice(ranks, 1, size(ranks) - need + 1)")).alias("from", "rank"))
    pairs = left.join(right, "rank").where("words >= need and least(size(wanted) - from, size(ranks) - at) >= need")
    shared = F.size(F.array_intersect("ranks", "wanted"))
    return pairs.select("row", "block", "template", "label", "need", shared.alias("shared"), F.size("wanted").alias("size")).where("shared >= need")


def matches(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """row, block, label, containment and shared words of the join; of a label's templates the closest."""
    return joined(blocks, templates).groupBy("row", "block", "label").agg(F.max(F.struct(F.col("shared") / F.col("size"), "shared")).alias("how")).select("row", "block", "label", F.col("how.col1").alias("containment"), "how.shared")


def found_notices(base: DataFrame, templates: DataFrame, wanted: list[tuple[str, frozenset, int, int]]) -> DataFrame:
    """row, distinct labels and greatest containment of the notices in the tiles of ``base``."""
    tiles = base.select("row", F.explode("tiles").alias("t")).select("row", F.col("t.tile").alias("block"), "t.places", "t.words", "t.ranks")
    near = joined(tiles.select("row", "block", F.size("ranks").alias("words"), "ranks"), templates)
    near = near.groupBy("row", "block").agg(F.collect_set("template").alias("templates"))  # at most all templates

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, labels, shares = [], [], []
            for r in batch.to_pylist():
                for label, share in notices(r["block"], r["places"], r["words"], [wanted[k] for k in sorted(r["templates"])]):
                    rows.append(r["row"]), labels.append(label), shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(labels, pa.string()), pa.array(shares, pa.float64())], ["row", "label", "share"])

    seen = tiles.join(near, ["row", "block"]).select("row", "block", "places", "words", "templates").mapInArrow(run, "row bigint, label string, share double")
    return seen.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("notice_labels"), F.max("share").alias("notice_score"))


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Phrases, template matches of lines (``labels``, ``score``), and notices wherever lines break (``notice_labels``, ``notice_score``) of every row of ``docs``."""
    spark = docs.sparkSession
    wanted = template_words()
    vocabulary = {w for _, words in wanted for w in words}
    counts = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows, prefixes, back = [], set(), {i: w for w, i in rank.items()}
    for k, (label, words) in enumerate(wanted):
        ranks = sorted(rank[w] for w in words)
        need = math.ceil(containment * len(ranks) - 1e-9)
        prefixes |= {back[r] for r in ranks[: len(ranks) - need + 1]}
        rows.append((k, label, ranks, need))
    templates = spark.createDataFrame(rows, "template int, label string, ranks array<int>, need int")
    sought = [(label, frozenset(ranks), need, _span(text)) for (_, label, ranks, need), (_, text) in zip(rows, TEMPLATES)]
    base = stored(blocks_of(docs, rank, prefixes).withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    held = base.select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.words", "b.ranks")
    # a block's label is its closest template's; its other matches are wordings that this one contains
    closest = matches(held, templates).groupBy("row", "block").agg(F.max(F.struct("containment", "shared", "label")).alias("m"))
    found = closest.select("row", "m.label", "m.containment").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = base.drop("blocks", "tiles").join(found, "row", "left").join(found_notices(base, templates, sought), "row", "left").drop("row")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("notice_labels", F.lit("")).alias("notice_labels"), F.coalesce("notice_score", F.lit(0.0)).alias("notice_score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return scan(table(spark, sf_dir, "documents"))
