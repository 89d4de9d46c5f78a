"""Packing by cutting-stock column generation.

Documents become subword ids and one end id. Each document's ids are cut into full sequences
and a rest; rests are the stock problem's items. Their lengths, rounded up to STEP, form a
histogram whose size does not depend on the corpus. A linear program over patterns (multisets of
lengths that fit a sequence) is solved by column generation: the master's duals price lengths and an unbounded
knapsack by dynamic programming finds the pattern of the best reduced cost. Patterns are used
the rounded-down number of times, and what is left is filled greedily by the same knapsack. Spark then ranks the
pieces of each length and hands the ranks to the patterns' places.

Null and empty texts are the end id alone. Rows of a repeated doc_id are packed each for itself.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.llm.common import stored, table
from rookery.llm.subwords import encoder_of

WIDTH, STEP, END = 2048, 8, 1
#: Ranks are counted within blocks of about this many pieces, so a frequent length is no single group.
BLOCK_ROWS = 4_096
#: Texts encoded at once.
SLICE = 512


def cut(docs: DataFrame, tokenizer: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """The pieces of every row: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer)
        for batch in batches:
            texts, out = [t or "" for t in batch.column("text").to_pylist()], []
            for first in range(0, len(texts), SLICE):
                flat, counts = encoder.ids(texts[first : first + SLICE])
                lo = 0
                for row, n in enumerate(counts.tolist(), first):
                    data = flat[lo : lo + n].astype("<u4").tobytes() + int(end).to_bytes(4, "little")
                    lo += n
                    for s in range(0, n + 1, width):
                        piece = data[4 * s : 4 * (s + width)]
                        out.append((row, s, len(piece) // 4, crc32(piece), n + 1))
            if out:
                rows, *rest = (pa.array(v, pa.int64()) for v in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1..len(value) of greatest value within the capacity: its value and the count of each size."""
    sizes = np.flatnonzero(value > 1e-12) + 1
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        s = sizes[: np.searchsorted(sizes, c, side="right")]
        worth[c] = worth[c - 1]
        if len(s):
            got = value[s - 1] + worth[c - s]
            k = int(got.argmax())
            if got[k] > worth[c] + 1e-12:
                worth[c], last[c] = got[k], s[k]
    count, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if last[c]:
            count[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(worth[capacity]), count


def cutting_stock(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and their numbers of uses that cover the demand for sizes 1..len(demand) in bins of len(demand), no more and no less.

    The restricted master is solved by the revised simplex method, which starts from one pattern to a
    size and keeps the basis inverse; each pivot brings in the pattern that the knapsack prices best, until none is worth
    more than a sequence or, as at a degenerate vertex, as many pivots as there are sizes have changed nothing.
    """
    m = len(demand)
    sizes = np.flatnonzero(demand) + 1
    left, found = demand.copy(), []
    if len(sizes):
        basis = np.zeros((len(sizes), len(sizes)))
        basis[np.arange(len(sizes)), np.arange(len(sizes))] = m // sizes
        inverse, x = np.diag(1.0 / (m // sizes)), demand[sizes - 1] / (m // sizes)
        still = 0
        while still <= len(sizes):
            value = np.zeros(m)
            value[sizes - 1] = inverse.sum(0)
            worth, count = knapsack(value, m)
            if worth <= 1 + 1e-7:
                break
            column = inverse @ count[sizes - 1]
            ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            still = 0 if (worth - 1) * ratio[out] > 1e-9 * max(1.0, x.sum()) else still + 1
            x = x - ratio[out] * column
            x[out] = ratio[out]
            basis[:, out] = count[sizes - 1]
            inverse[out] /= column[out]
            rest = np.delete(np.arange(len(sizes)), out)
            inverse[rest] -= np.outer(column[rest], inverse[out])
        for j, uses in enumerate(np.floor(np.maximum(x, 0) + 1e-6).astype(int)):
            pattern = np.zeros(m, np.int64)
            pattern[sizes - 1] = basis[:, j].astype(int)
            uses = min(int(uses), *(left[pattern > 0] // pattern[pattern > 0]).tolist())
            if uses > 0:
                found.append((pattern, uses))
                left = left - uses * pattern
    while left.any():  # the largest sizes first; each round uses up a size
        pattern, room = np.zeros(m, np.int64), m
        for s in np.flatnonzero(left)[::-1] + 1:
            pattern[s - 1] = min(left[s - 1], room // s)
            room -= pattern[s - 1] * s
        uses = int((left[pattern > 0] // pattern[pattern > 0]).min())
        found.append((pattern, uses))
        left = left - uses * pattern
    return found


@dataclass(frozen=True)
class Places:
    """Of each size: the first rank that each of its patterns takes, the pattern's first sequence, its pieces of the size, and where they stand."""

    ranks: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]

    @classmethod
    def of(cls, patterns: list[tuple[np.ndarray, int]]) -> Places:
        rows, taken, sequence = defaultdict(list), defaultdict(int), 0
        for pattern, uses in patterns:
            before = 0
            for size in np.flatnonzero(pattern)[::-1] + 1:
                n = int(pattern[size - 1])
                rows[int(size)].append((taken[size], sequence, n, before))
                taken[size] += uses * n
                before += n
            sequence += uses
        table = {s: np.array(r, np.int64) for s, r in rows.items()}
        return cls({s: r[:, 0] for s, r in table.items()}, table)

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            here = size == s
            r = rank[here]
            first, start, n, before = self.rows[s][np.searchsorted(self.ranks[s], r, side="right") - 1].T
            sequence[here], slot[here] = start + (r - first) // n, before + (r - first) % n
        return sequence, slot


def pack(pieces: DataFrame, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """``pieces`` (with column ``length``, at most ``width``) with sequence_id and offset. ``pieces`` must be a stored table."""
    sized = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("int"))
    blocks = max(1, pieces.count() // BLOCK_ROWS)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    sized = stored(sized, "pack-sized")
    counted = stored(sized.groupBy("size", "block").count(), "pack-counts")
    demand = np.zeros(width // step, np.int64)
    for size, n in counted.groupBy("size").agg(F.sum("count")).collect():  # one row to a size, at most width / step
        demand[size - 1] = n
    places = Places.of(cutting_stock(demand))
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("size", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("size", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = sized.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["size", "block"]).withColumn("rank", (F.col("rank") + F.col("first")).cast("bigint")).drop("first", "block")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sequence, slot = places.find(batch.column("size").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    names = pieces.columns
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields} | {"sequence_id": "bigint", "slot": "bigint"}
    placed = ranked.select(*pieces.columns, "size", "rank").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("slot")


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all rows of ``docs`` with their sequences."""
    return pack(stored(cut(docs, tokenizer), "pack-pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
