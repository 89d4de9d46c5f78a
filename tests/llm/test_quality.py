import zlib

import numpy as np

from rookery.llm import quality

SF = "/root/testdata/sf0.01"


def walked(forest, x):
    """Each row through each tree, node by node."""
    out = []
    for row in x:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_flat_arrays_score_like_walked_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_STATISTICS)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = quality.fit(x, y)
    assert np.allclose(forest.score(x), walked(forest, x))
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95


def test_held_out_accuracy_and_contract(spark):
    rows = quality.op4_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    both = rows[rows.held_out].merge(labels.dropna(subset=["quality"]), on="doc_id")
    ones, zeros = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    auc = (ones[:, None] > zeros[None]).mean() + 0.5 * (ones[:, None] == zeros[None]).mean()
    assert auc > 0.9


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels.quality) * (quality.crc_mod("doc_id", 3) == 1).cast("int") + labels.quality * (quality.crc_mod("doc_id", 3) != 1).cast("int"))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 100_000, "c")], "doc_id bigint, text string, stats string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    kept = quality.high_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() in (0, 4)
    none = spark.createDataFrame([], docs.schema)
    assert quality.classify(none, labels).count() == 0 and quality.high_quality(none, labels).count() == 0
    assert quality.classify(docs, spark.createDataFrame([], labels.schema)).count() == 4
