"""LM scoring: a smoothed unigram base score, and a causal self-attention model on subword ids.

What the scores are learnt from is counted over all training documents: words for the base score, and, from the distinct words and
their counts, subword ids for the model's shares. The classes of ids come from neighbour counts summed over all ids of all training texts.
The attention weights are fitted in two steps: a first fit on pieces of at most SAMPLE_DOCS training documents, then one pass over
all windows of all training documents, in which each task goes on from the first fit over its own windows and the tasks' weights
are averaged. Scores read whole texts in overlapping windows that score each id once.

Texts are spelt out once: the ids of every text are stored, and the neighbour counts, the pass and the scores read them.

The base score needs each word's count. The most frequent words, at most HEAD whatever the corpus, are sent to the tasks. The
occurrences of all rarer words are joined with the counts by hash, so no task holds the vocabulary.

Null and empty texts are the end alone. Each row is scored for itself. Without training documents all counts are 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import attention
from rookery.llm.common import crc_mod, hash_sample, raw_text, space_words, stored, table
from rookery.llm.subwords import encoder_of

HEAD, SAMPLE_DOCS, PIECE, SLICE = 300_000, 3_000, 2_000, 256
#: Texts are trained on together up to so many characters.
TOGETHER = 500_000
EPOCHS, RATE, PASS_RATE, PASS_BATCH = 4, 0.01, 0.002, 256


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n and hash of all space-separated words, as a stored table."""

    def run(batches):
        import pyarrow as pa

        def flush(total):
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for raw in raw_text(batch):
                total.update(space_words(raw))
            if len(total) > 1_000_000:
                yield flush(total)
                total.clear()
        yield flush(total)

    counted = texts.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.withColumn("hash", F.xxhash64("word")), "lm-words")


def id_counts(counts: DataFrame, tokenizer: str, vocabulary: int) -> np.ndarray:
    """How often the training documents have each subword id; at most a row to an id comes back."""

    def run(batches):
        import pyarrow as pa

        encoder, total = encoder_of(tokenizer, True), np.zeros(vocabulary, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            n, words = n[order], batch.column("word").take(pa.array(order)).to_pylist()
            runs = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1, [len(n)]])  # words of one count make lines of up to 50
            starts = np.concatenate([np.arange(a, b, 50) for a, b in zip(runs, runs[1:])]) if len(n) else runs[:0]
            stops = np.append(starts[1:], len(n))
            flat, sizes = encoder.raw([" ".join(words[a:b]) for a, b in zip(starts.tolist(), stops.tolist())])
            total += np.bincount(flat, np.repeat(n[starts], sizes), vocabulary).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    out = np.zeros(vocabulary)
    for r in counts.select("word", "n").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def pieces(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, a piece of at most ``size`` characters at a place drawn by hash, and whether that is the whole text."""
    text = F.coalesce("text", F.lit(""))
    room = F.greatest(F.lit(1), F.length(text) - size + 1)
    at = (F.pmod(F.xxhash64("doc_id", F.lit(size)), room) + 1).cast("int")
    return texts.select("doc_id", F.substring(text, at, F.lit(size)).alias("text"), (F.length(text) <= size).alias("whole"))


def _windows(encoder, classes: np.ndarray, end: int, texts: list[str], whole: list[bool]):
    """Windows of pieces; only whole texts have their end."""
    flat, counts = encoder.ids(texts)
    ends = np.array(whole, bool)
    flat = np.insert(flat.astype(np.int64), np.cumsum(counts)[ends], end)
    counts = counts + ends
    kept = counts > 0
    return attention.windows(classes[flat], counts[kept])[:3] if kept.any() else None


def _together(texts: list, length=len):
    """Runs of texts, or of their lengths, of at most TOGETHER characters, or one text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + length(t) > TOGETHER:
            yield texts[lo:i]
            lo, size = i, 0
        size += length(t)
    if lo < len(texts):
        yield texts[lo:]


def _id_type(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _packed(flat: np.ndarray, counts: np.ndarray, end: int, kind):
    """Texts' ids as an Arrow column of bytes, each text's followed by the end."""
    import pyarrow as pa

    sizes = counts + 1
    ids, offsets = np.full(int(sizes.sum()), end, kind), np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(ids), bool)
    inside[offsets[1:] - 1] = False
    ids[inside] = flat
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets * kind().itemsize), pa.py_buffer(ids)]).cast(pa.binary())


def _unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The ids that ``_packed`` made a column of, in a row, and how many each text has with its end."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data else np.zeros(0, kind)
    return flat, np.diff(offsets) // kind().itemsize


def _runs(batch, kind):
    """Ids and sizes of a batch's texts, as ``_packed``, in runs of at most TOGETHER characters, or one text."""
    flat, counts = _unpacked(batch.column("ids"), kind)
    lo = at = 0
    for size in map(len, _together(batch.column("chars").to_numpy().tolist(), int)):
        n = int(counts[lo : lo + size].sum())
        yield flat[at : at + n], counts[lo : lo + size]
        lo, at = lo + size, at + n


def spelt(texts: DataFrame, tokenizer: str, vocabulary: int, end: int) -> DataFrame:
    """chars and ids of all texts; a table without text, which has them, stays as it is."""
    if "text" not in texts.columns:
        return texts.select("chars", "ids")

    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer, True)
        for batch in batches:
            for some in _together([t or "" for t in batch.column("text").to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array(list(map(len, some)), pa.int64()), _packed(*encoder.ids(some), end, _id_type(vocabulary))], ["chars", "ids"])

    return texts.select("text").mapInArrow(run, "chars bigint, ids binary")


def neighbours(texts: DataFrame, tokenizer: str, vocabulary: int, end: int, landmark: np.ndarray) -> np.ndarray:
    """How often each id of the training texts follows and precedes each landmark; at most a row to an id, a side and a landmark comes back."""
    shape = (vocabulary, 2, attention.LANDMARKS + 1)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for flat, _ in _runs(batch, _id_type(vocabulary)):
                ids = np.concatenate([[end], flat])
                for side, (own, other) in enumerate(((ids[1:], ids[:-1]), (ids[:-1], ids[1:]))):
                    held = own != end
                    np.add.at(total, (own[held] * 2 + side) * shape[2] + landmark[other[held]], 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["key", "n"])

    rows = spelt(texts, tokenizer, vocabulary, end).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[rows["key"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out.reshape(shape)


def window_pass(texts: DataFrame, tokenizer: str, classes: np.ndarray, weights: dict[str, np.ndarray], end: int) -> DataFrame:
    """A row to a task: how many windows its texts have, and the weights after training on all of them."""

    def run(batches):
        import pyarrow as pa

        own, seen, small = weights, 0, classes.astype(np.uint16)
        for batch in batches:
            for flat, counts in _runs(batch, _id_type(len(classes))):
                found = attention.windows(small[flat], counts)[:3]
                own = attention.train(own, *found, 1, PASS_RATE, batch=PASS_BATCH)
                seen += len(found[0])
        if seen:
            flat = np.concatenate([own[k].ravel() for k in weights]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], ["n", "w"])

    return spelt(texts, tokenizer, len(classes), end).mapInArrow(run, "n bigint, w array<double>")


def fit(texts: DataFrame, tokenizer: str, vocabulary: int, end: int, by_id: np.ndarray, ids: DataFrame | None = None):
    """Classes of all ids, and the attention weights; ``by_id`` has the counts of all training ids, ``ids`` the texts as ``spelt``."""
    ids = texts if ids is None else ids
    encoder = encoder_of(tokenizer, True)
    landmark = attention.landmarks(by_id, end)
    classes = attention.cluster(neighbours(ids, tokenizer, vocabulary, end, landmark), end)
    share = np.bincount(classes, by_id, attention.CLASSES) + 0.01
    weights = attention.start(share / share.sum())
    rows = hash_sample(pieces(texts, PIECE), SAMPLE_DOCS, "doc_id", "text").toPandas()
    found = _windows(encoder, classes, end, rows.text.tolist(), rows.whole.tolist())
    if found is None:
        return classes, weights
    weights = attention.train(weights, *found, EPOCHS, RATE)
    shapes = {k: v.shape for k, v in weights.items()}
    passed = window_pass(ids, tokenizer, classes, weights, end).select("n", F.posexplode("w").alias("at", "w"))
    mean = passed.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
    found = np.zeros(sum(int(np.prod(s)) for s in shapes.values()))
    rows = mean.toPandas()  # a row to a weight
    if len(rows):
        found[rows["at"].to_numpy()] = rows["w"].to_numpy()
        at = 0
        for k, s in shapes.items():
            weights[k] = found[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))
    return classes, weights


def least_of_head(counts: DataFrame, total: int) -> int:
    """The count that at most HEAD words reach: total / HEAD or, as far as the words of each eighth of a doubling still fit, less."""
    by_size = counts.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.min("n").alias("n"), F.count("*").alias("words"))
    least, held = -(-total // HEAD) or 1, 0
    for r in sorted(by_size.collect(), key=lambda r: -r.n):  # a few hundred rows at most
        held += r.words
        if held <= HEAD:
            least = min(least, r.n)
    return least


class _Counts:
    """Counts of the chunks that an encoder remembers; -1 for those outside the head."""

    def __init__(self, encoder, head: dict[str, int]):
        self.encoder, self.head, self.generation, self.n = encoder, head, encoder.generation, 0
        self.count = np.zeros(1 << 20, np.int64)

    def of(self, places: np.ndarray) -> np.ndarray:
        if self.generation != self.encoder.generation:
            self.generation, self.n = self.encoder.generation, min(self.n, self.encoder.KEPT)
        names = self.encoder.names[self.n :]
        while self.n + len(names) > len(self.count):
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.count[self.n : self.n + len(names)] = np.fromiter((self.head.get(w, -1) for w in names), np.int64, len(names))
        self.n += len(names)
        return self.count[places]


def _hashes(chunks: list[str], where: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of some of the chunks."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(chunks[i].encode("utf-8", "surrogatepass"), 42) for i in where.tolist()], np.uint64).view(np.int64)


def _chunks(text: str) -> list[str]:
    """The words of the base score, which ends words at ASCII white space only."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.lower().split()
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").lower().split()]


def score(docs: DataFrame, tokenizer: str, vocabulary: int = 49_408, end: int = 49_407) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    texts = docs.where(crc_mod("doc_id", 7) != 2).select("doc_id", "text")
    counts = word_counts(texts)
    n_docs = texts.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n + n_docs, sums.v + (n_docs > 0)
    scale = float(np.log10(total + distinct + 1))
    least = least_of_head(counts, total)
    frequent = counts.where(F.col("n") >= least).select("word", "n").toPandas()  # at most HEAD rows
    head = dict(zip(frequent["word"].tolist(), frequent["n"].tolist()))
    rare, known_end = least > 1, int(n_docs > 0)
    of_end = float(np.log10(n_docs + 1) - scale)

    def read(batches):
        import pyarrow as pa

        encoder = encoder_of(tokenizer, True)
        counted = _Counts(encoder, head)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for some in (part for run in _together(texts) for part in (run[lo : lo + SLICE] for lo in range(0, len(run), SLICE))):
                chunks, ends = [], []
                for t in some:
                    chunks += _chunks(t)
                    ends.append(len(chunks))
                ends = np.array(ends)
                places = encoder.places(chunks)
                count, starts = counted.of(places), np.concatenate([[0], ends[:-1]])
                common = count >= 0
                sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])  # noqa: E731, B023
                log = np.where(common | (not rare), np.log10(np.maximum(count, 0) + 1.0) - scale, 0.0)
                offsets = np.concatenate([[0], np.cumsum(sums(~common))]) if rare else np.zeros(len(some) + 1)
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_hashes(chunks, np.flatnonzero(~common)) if rare else [], pa.int64()))
                columns = [pa.array(v) for v in (ends - starts + 1, sums(count > 0) + known_end, sums(log) + of_end)]
                ids = _packed(encoder.gather(places), encoder.sizes(places, ends), end, _id_type(vocabulary))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(some)), *columns, tail, pa.array(list(map(len, some)), pa.int64()), ids],
                    ["doc_id", "n_tokens", "n_known", "base_score", "tail", "chars", "ids"],
                )
                at += len(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double"
    found = docs.select("doc_id", "text").mapInArrow(read, f"{columns}, tail array<bigint>, chars bigint, ids binary")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "lm-ids")
    by_id = id_counts(counts, tokenizer, vocabulary)
    by_id[end] = n_docs
    classes, weights = fit(texts, tokenizer, vocabulary, end, by_id, found.where(crc_mod("doc_id", 7) != 2))
    share = np.log((by_id + 1) / np.bincount(classes, by_id + 1, attention.CLASSES)[classes]).astype(np.float32)
    model = attention.Model(weights, classes.astype(np.uint16), share)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [model.score(*r) for r in _runs(batch, _id_type(vocabulary))]
            if scores:
                names = ["doc_id", "n_tokens", "n_known", "base_score", "row"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(np.concatenate(scores))], [*names, "score"])

    scored = found.select("doc_id", "n_tokens", "n_known", "base_score", "row", "chars", "ids").mapInArrow(run, f"{columns}, row bigint, score double")
    if rare:
        tail = found.select("row", F.explode("tail").alias("hash")).join(counts.where(F.col("n") < least).select("hash", "n"), "hash", "left")
        tail = tail.select("row", (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - scale).alias("log"), F.when(F.col("n") > 0, 1).otherwise(0).alias("known"))
        sums = tail.groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
        scored = scored.join(sums, "row", "left").withColumn("base_score", F.col("base_score") + F.coalesce("log", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0)))
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
