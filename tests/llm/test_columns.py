"""Columns whose names hold dots or are those of the operators' own."""

import pytest

from rookery.llm import common, decontamination, quality, secrets, simhash


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "h", i, "p") for i, t in enumerate(["one two three four five six", "one two three four five six", None, "", "token = abcdefgh12345678", "q w e r t y u i o p"])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, hash string, row int, `a.b` string")


def test_row_operators_keep_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, "q w e r t y u i o p")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 2, 4, 5]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [0, 1, 2, 3, 4]
    for found in (simhash.deduplicate(docs), decontamination.clean(docs, bench), secrets.redact(docs), quality.high_quality(docs, labels)):
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        assert all(r["a.b"] == "p" and r.row == r.doc_id for r in found.collect())


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://h:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
