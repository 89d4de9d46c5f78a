from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rookery.llm import common, quality

from .test_decontamination import brute as leaks
from .test_secrets import brute as pattern_spans
from .test_simhash import brute_groups, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage is given and returns."""
    docs, out = common.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = common.stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, found)
        docs = found
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "pack"]
    for name, (before, after) in stages.items():
        if name != "pack":
            assert before.columns == after.columns and before.dtypes == after.dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages["quality"]
    kept = {r.doc_id for r in quality.classify(before, common.table(spark, SF, "labels")).collect() if r.predicted}
    assert rows(after) == sorted((tuple(r) for r in before.collect() if r.doc_id in kept), key=repr)
    assert 0 < len(kept) < before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    every = before.collect()
    least = brute_groups({r.doc_id: brute_print(r.text) for r in every})
    assert rows(after) == sorted((tuple(r) for r in every if least[r.doc_id] == r.doc_id), key=repr)


def test_documents_with_benchmark_windows_go(spark, stages):
    before, after = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    held = " ".join(t or "" for _, t in items).lower()
    every = before.collect()
    # brute force on those that could hold a window, to keep this short
    some = [(r.doc_id, r.text) for r in every if sum(w in held for w in (r.text or "").lower().split()) >= 1]
    hit = {d for d, found in leaks(some[:60], items[:15], 10).items() if found[4]}
    kept = {r.doc_id for r in after.collect()}
    assert not hit & kept and kept <= {r.doc_id for r in every}
    assert rows(after) == sorted((tuple(r) for r in every if r.doc_id in kept), key=repr)


def test_secrets_are_replaced_and_no_document_goes(stages):
    before, after = stages["secrets"]
    was, now = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert set(was) == set(now)
    for d, r in now.items():
        assert pattern_spans(r.text) == "" or pattern_spans(was[d].text) != ""
        if pattern_spans(was[d].text):
            assert "[SECRET]" in r.text
        assert r.n_chars == len(r.text or "")


def test_packing_holds_every_id(stages):
    before, after = stages["pack"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got: dict = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty_table_and_extra_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, row int"
    for name, data in (("none", []), ("few", [(1, None, None, None, None, "h", 1), (2, "", "en", "s", 0, "h", 2), (2, "", "en", "s", 0, "h", 2), (None, "some words here", "en", "s", 15, None, None)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            common.table(spark, SF, t).write.parquet(f"{folder}/{t}.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "sequence_id", "offset"} <= set(found.columns)
        assert found.count() <= len(data)


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert Path(corpus_pipeline.__file__).parent == Path(__spark_entry__.__file__).parent
