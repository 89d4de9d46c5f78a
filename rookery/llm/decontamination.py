"""Benchmark decontamination: a distributed positional inverted index and offset-adjusted intersections.

A first pass counts the benchmark's words over the whole corpus. Each benchmark window's rarest TERMS words by that
count are its anchors, and a second pass stores their postings: word, document row and positions. The index is joined
with the benchmark's own anchor positions; a posting at ``p`` for an anchor at ``i`` of an item votes for the alignment
``p - i`` of document and item, with ``slop`` also for the ``slop`` alignments before it, as words put in between move later anchors on.
Alignments at which all anchors of some window meet survive. The survivors' documents
are read once more to compare whole windows, which gives exact phrases, and with ``slop`` also proximity matches:
windows whose words all stand, in order, within ``slop`` further positions.

Null and empty texts have no words and no hits. An item shorter than a window is one window; an item without words is
none; items of one id count once, and a null id is the empty string. Rows are identified by doc_id and text, so rows of a
repeated doc_id keep their own results and equal rows have equal ones. Other columns of the table, whatever their names, do not matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import alnum_words, place, plain, raw_text, stored, table

WINDOW, TERMS = 10, 2
#: Further positions of the query's proximity matches.
SLOP = 2
#: Items are sent to the tasks in blocks of about this many words at most; a larger benchmark takes several passes over the documents.
BENCHMARK_WORDS = 5_000_000


class Benchmark:
    """The items' words, of a block of the benchmark."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.items = [(name, words) for name, words in items if words]
        self.vocabulary = {w for _, words in self.items for w in words}

    @classmethod
    def of(cls, benchmark: DataFrame, window: int = WINDOW) -> Benchmark:
        return cls([(r.item_id, alnum_words((r.text or "").encode())) for r in benchmark.select("item_id", "text").collect()], window)

    def windows(self, words: list[bytes]):
        """First positions of an item's windows and their length."""
        n = min(self.window, len(words))
        return range(len(words) - n + 1), n

    def anchors(self, counts: dict[bytes, int], terms: int = TERMS) -> list[tuple[int, int, list[int]]]:
        """(item, first position, places of its rarest words) of every window; an item is named by its place in ``items``."""
        found = []
        for item, (_, words) in enumerate(self.items):
            starts, n = self.windows(words)
            for s in starts:
                places: dict[bytes, int] = {}
                for i in sorted(range(s, s + n), key=lambda i: (counts.get(words[i], 0), words[i], i)):
                    places.setdefault(words[i], i)
                found.append((item, s, list(places.values())[:terms]))
        return found


def term_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Corpus counts of the benchmark's words; at most one row to a word comes back."""

    def run(batches):
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for raw in raw_text(batch):
                total.update(filter(vocabulary.__contains__, alnum_words(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``hash``, which together name a row."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """The positional index: doc_id, hash, n_words and the postings (number and positions) of the numbered words in every row."""
    terms = set(number)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("term", pa.int32()), ("at", pa.list_(pa.int32()))]))
        for batch in batches:
            n_words, postings = [], []
            for raw in raw_text(batch):
                words = alnum_words(raw)
                n_words.append(len(words))
                held: dict[int, list[int]] = {}
                if not terms.isdisjoint(words):
                    for i, w in enumerate(words):
                        if w in number:
                            held.setdefault(number[w], []).append(i)
                postings.append([{"term": t, "at": at} for t, at in held.items()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(n_words, pa.int64()), pa.array(postings, kind)], ["doc_id", "hash", "n_words", "postings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(keyed(docs).mapInArrow(run, f"doc_id {kind}, hash bigint, n_words bigint, postings array<struct<term:int,at:array<int>>>"), "positional-index")


def alignments(indexed: DataFrame, anchors: DataFrame, windows: DataFrame, least: int, slop: int = 0) -> DataFrame:
    """doc_id, hash, item, shift and windows: where all anchors of a window stand at their distances, or up to ``slop`` positions later.

    ``anchors`` has term, item and place; ``windows`` has item and its windows, each with its first position and its
    anchors' places; ``least`` is the smallest number of anchors that a window has.
    """
    posted = indexed.select("doc_id", "hash", F.explode("postings").alias("p")).select("doc_id", "hash", "p.term", "p.at")
    votes = posted.join(anchors, "term").select("doc_id", "hash", "item", "place", F.explode(F.transform("at", lambda p: p - F.col("place"))).alias("shift"))
    if slop:
        votes = votes.withColumn("shift", F.explode(F.sequence(F.col("shift") - slop, F.col("shift"))))
    met = votes.groupBy("doc_id", "hash", "item", "shift").agg(F.collect_set("place").alias("met")).where(F.size("met") >= least)
    whole = F.expr("transform(filter(windows, w -> size(array_except(w.places, met)) = 0), w -> w.first)")
    return met.join(windows, "item").select("doc_id", "hash", "item", "shift", whole.alias("windows")).where(F.size("windows") > 0)


def _phrase(words: list[bytes], wanted: list[bytes], at: int, slop: int) -> tuple[int, int] | None:
    """Where the wanted words stand from ``at`` (exactly, or in order within ``slop`` more positions): first and end."""
    if not slop:
        return (at, at + len(wanted)) if at >= 0 and words[at : at + len(wanted)] == wanted else None
    for first in range(max(0, at - slop), min(at + slop + 1, len(words))):
        if found := _near(words, wanted, first, slop):
            return found
    return None


def _near(words: list[bytes], wanted: list[bytes], first: int, slop: int) -> tuple[int, int] | None:
    """Where the wanted words stand in order, the first of them at ``first``, within ``slop`` more positions: first and earliest end."""
    if first < 0 or first >= len(words) or words[first] != wanted[0]:
        return None
    i, stop = first, min(first + len(wanted) + slop, len(words))
    for w in wanted[1:]:
        i += 1
        while i < stop and words[i] != w:
            i += 1
        if i >= stop:
            return None
    return first, i + 1


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of about BENCHMARK_WORDS words, by hash. Equal items share a block; every item lies in one."""
    letters = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-letters // (8 * BENCHMARK_WORDS)) or 1
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    return [benchmark.where(block == i) for i in range(n)] if n > 1 else [benchmark]


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans that meet or overlap as one, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "stop": e} for s, e in out]


MATCHES = ", ".join(f"{x}spans array<struct<start:int,stop:int>>, {x}items array<string>" for x in ("", "near_"))


def matched(docs: DataFrame, bench: Benchmark, terms: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash and n_words of every row, and of rows with matches of one block of items the merged spans and the item names, exact and near."""
    spark = docs.sparkSession
    counts = term_counts(docs, bench.vocabulary)
    found = bench.anchors(counts, terms)
    places = sorted({(item, i) for item, _, at in found for i in at})
    number = {w: k for k, w in enumerate(sorted({bench.items[item][1][i] for item, i in places}))}
    indexed = index(docs, number)
    anchors = spark.createDataFrame([(number[bench.items[item][1][i]], item, i) for item, i in places], "term int, item int, place int")
    by_item: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for item, s, at in found:
        by_item[item].append((s, at))
    windows = spark.createDataFrame(list(by_item.items()), "item int, windows array<struct<first:int,places:array<int>>>")
    survivors = alignments(indexed, anchors, windows, min((len(at) for *_, at in found), default=1), slop)
    survivors = survivors.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("item", "shift", "windows")).alias("where"))
    if slop:  # loose alignments are many and grow with the documents, so texts and survivors meet by a merge join at every size
        survivors = survivors.hint("merge")
    else:  # stored first, survivors have a known size: few are broadcast, and only many make the texts move
        survivors = stored(survivors, "aligned")
    items, width, key = bench.items, bench.window, ["doc_id", "hash"]
    joined = _same(keyed(docs), survivors, key, "inner").select(*key, "text", "where")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for raw, where in zip(raw_text(batch), batch.column("where").to_pylist()):
                words, hit, named, close, close_named = alnum_words(raw), [], set(), [], set()
                for a in where:
                    name, item = items[a["item"]]
                    name = "" if name is None else str(name)
                    for s in a["windows"]:
                        wanted = item[s : s + width]
                        if slop and (at := _near(words, wanted, a["shift"] + s, slop)):
                            close.append(at)
                            close_named.add(name)
                        if at := _phrase(words, wanted, a["shift"] + s, 0):
                            hit.append(at)
                            named.add(name)
                out.append((_merged(hit), sorted(named), _merged(close), sorted(close_named)))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (span, pa.list_(pa.string())) * 2)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *columns], ["doc_id", "hash", "spans", "items", "near_spans", "near_items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return indexed.select(*key, "n_words"), joined.mapInArrow(run, f"doc_id {kind}, hash bigint, {MATCHES}").dropDuplicates(key)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, terms: int = TERMS, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the merged spans and the items, all of exact matches; with ``slop`` also near_hit, near_items and near_items_sha256, of proximity matches, which exact ones are too.

    Without documents there are no rows, without items no hits. Texts of any length are read whole. An item that two blocks or rows name alike counts once.
    """
    key, checked, words = ["doc_id", "hash"], None, None
    for block in item_blocks(benchmark):
        own, found = matched(docs, Benchmark.of(block, window), terms, slop)
        words, checked = words if words is not None else own, found if checked is None else checked.unionByName(found)
    every = ("spans", "items", "near_spans", "near_items")
    checked = checked.groupBy(*key).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in every))  # as many rows as blocks to a key
    both = _same(words, checked, key, "left")
    count = lambda c: F.coalesce(F.expr(f"size(array_distinct(flatten(transform({c}, s -> sequence(s.start, s.stop - 1)))))"), F.lit(0))
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    digest = lambda c: F.sha2(F.array_join(names(c), ","), 256)
    near = [count("near_spans").cast("bigint").alias("near_hit"), F.size(names("near_items")).cast("bigint").alias("near_items"), digest("near_items").alias("near_items_sha256")]
    return both.select(
        "doc_id",
        "hash",
        "n_words",
        count("spans").cast("bigint").alias("n_hit"),
        F.size(names("items")).cast("bigint").alias("n_items"),
        digest("items").alias("items_sha256"),
        (count("spans") > 0).alias("contaminated"),
        "spans",
        names("items").alias("items"),
        *(near if slop else ()),
    )


def _same(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on keys of which doc_id may be null, keeping the left keys."""
    right = right.withColumnsRenamed({k: f"right_{k}" for k in key})
    return left.join(right, (F.col("doc_id").eqNullSafe(F.col("right_doc_id"))) & (F.col("hash") == F.col("right_hash")), how)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, in their own columns."""
    key = ["doc_id", "hash"]
    hit = stored(find(docs, benchmark).where("contaminated").select(*key).distinct(), "contaminated")
    rows = plain(docs)
    rows = rows.withColumns({"doc_id": F.col(place(docs, "doc_id")), "hash": F.xxhash64(place(docs, "text"))})
    return _same(rows, hit, key, "left_anti").drop(*key).toDF(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, exact and, in the columns near_*, within SLOP further positions."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.drop("hash", "spans", "items")
