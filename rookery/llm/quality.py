"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns each whole text into a fixed vector in one pass. ``fit`` grows complete
trees level by level on quantile bins and keeps them as flat arrays, so ``Forest.score``
walks all rows of a batch through all trees with numpy indexing. Labels are used for fitting
only; doc_id, lang and source never enter a score.

Null and empty texts have the statistics of an empty text and a score like any other.
Without labelled rows, or with labels of one class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import crc_mod, hash_sample, numbered, picked, place, raw_text, stored, table

#: Rows the classifier is fitted on at most: those of the smallest hashes among the labelled.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_HESSIAN, L2 = 120, 4, 64, 0.12, 2.0, 1.0

_SYMBOLS = (b"#", b"$", b"%", b"&", b"*", b"|", b"!", b"=", b"@", b"<", b"{")
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 upper case, 3 digit, 4 space, 5 part of a non-ASCII character, 0 other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text."""
    n = max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) if text else np.zeros(6)
    words = text.lower().split()
    m = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(lines)
    most = counts.most_common(3)
    ended = sum(x.rstrip()[-1:] in b".!?\"'" for x in lines)
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    sizes = [len(x) for x in lines] or [0]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        *(kinds / n),
        *(min(1.0, text.count(x) / m) for x in _SYMBOLS),
        len(counts) / m,
        sum(1 for c in counts.values() if c == 1) / m,
        len(pairs) / max(1, m - 1),
        *((most[i][1] / m if i < len(most) else 0.0) for i in range(3)),
        len(words) / np.sqrt(m * max(1, len(counts))),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()) if len(words) else 0.0,
        float((lengths <= 3).mean()),
        len(lines),
        len(distinct) / max(1, len(lines)),
        sum(map(len, distinct)) / n,
        ended / max(1, len(lines)),
        float(np.mean(sizes)),
        max(sizes) / n,
        len(zlib.compress(text, 1)) / n,
        (text.count(b".") + text.count(b",")) / m,
        sum(x[-1:] in b"#$%&*!" for x in words) / m,
        sum(x.isdigit() for x in words) / m,
    ]


N_STATISTICS = len(statistics(b""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``stats`` of every row; a column ``row`` is kept."""
    names = ["doc_id", *(["row"] if "row" in docs.columns else [])]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat = np.array([statistics(t) for t in raw_text(batch)], np.float32).reshape(-1)
            offsets = pa.array(np.arange(0, len(flat) + 1, N_STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(flat))], [*names, "stats"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, stats array<float>")


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, flattened: ``feature`` and ``threshold`` by tree and inner node, ``leaf`` by tree and leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        rows, out = np.arange(len(x))[:, None], np.empty(len(x))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            at, which = np.zeros((len(part), trees), np.int32), np.arange(trees)[None, :]
            for _ in range(depth):
                at = 2 * at + 1 + (part[rows[: len(part)], self.feature[which, at]] > self.threshold[which, at])
            out[lo : lo + 4096] = self.base + self.leaf[which, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost the logistic loss. Each level's histograms are one bincount over node, feature and bin."""
    inner = (1 << DEPTH) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((1, inner), np.int32), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1)
    cell = bins + np.arange(k) * BINS
    valid = np.array([[b < len(cuts[j]) for b in range(BINS)] for j in range(k)])
    features, thresholds, leaves, margin = [], [], [], np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int32), np.full(inner, np.inf)
        for level in range(DEPTH):
            nodes, first = 1 << level, (1 << level) - 1
            index = ((at - first)[:, None] * (k * BINS) + cell).ravel()
            gs, hs = (np.bincount(index, np.repeat(v, k), nodes * k * BINS).reshape(nodes, k, BINS).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[~(valid[None] & (hs >= MIN_HESSIAN) & (ht - hs >= MIN_HESSIAN))] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), BINS)
                if gain[i, j, c] > 1e-9:
                    feature[first + i], threshold[first + i] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        gs, hs = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf = RATE * gs / (hs + L2)
        margin += leaf[at - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def train(stats: DataFrame, labels: DataFrame) -> Forest:
    """A forest from at most SAMPLE_ROWS labelled rows outside the held-out third. Labels that contradict each other on an id count by their mean."""
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    labelled = stats.where(crc_mod("doc_id", 3) != 1).join(labels, "doc_id")
    rows = hash_sample(labelled, SAMPLE_ROWS, "doc_id", "stats").select("stats", "quality").toPandas()
    x = np.array(rows.stats.tolist(), np.float32).reshape(-1, N_STATISTICS)
    return fit(x, (rows.quality.to_numpy(float) >= 0.5).astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = stored(with_statistics(docs), "quality-stats")
    forest = train(stats, labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = forest.score(batch.column("stats").flatten().to_numpy().reshape(-1, N_STATISTICS))
            added = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *added], ["doc_id", "held_out", "score", "predicted"])

    kept = stats.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "stats")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def high_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, in their own columns. Statistics are taken once, for the training and the scores."""
    held = numbered(docs, "quality-rows")
    stats = stored(with_statistics(held.select(F.col(place(docs, "doc_id")).alias("doc_id"), F.col(place(docs, "text")).alias("text"), "row")), "quality-stats")
    forest = train(stats.select("doc_id", "stats"), labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = forest.score(batch.column("stats").flatten().to_numpy().reshape(-1, N_STATISTICS))
            yield batch.select(["row"]).filter(pa.array(score >= 0.5))

    return picked(held, stats.select("row", "stats").mapInArrow(run, "row bigint"), docs)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
