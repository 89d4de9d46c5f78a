import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rookery.llm import packing, subwords

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "Hello, WORLD!! it's 3.14", "été ÉTÉ İstanbul ß", "a\x1cb\x85c d", "<|endoftext|> <|x|>", "x" * 3000, "don't-stop... (ok)", "日本語 テキスト", "a,b;c:d e.g. U.S.A.", "I'm you're 42nd", "﻿bom \x00nul"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return t


def test_encoder_equals_the_tokenizer(spark, tokenizer):
    texts = [*ODD, *(r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    encoder = subwords.Encoder(PATH)
    for limit in (subwords.Encoder.LIMIT, 50):
        encoder.LIMIT, encoder.KEPT = limit, 20
        for lo in range(0, len(texts), 17):
            part = texts[lo : lo + 17]
            flat, counts = encoder.ids(part)
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
            assert counts.tolist() == [len(w) for w in want]
            assert flat.tolist() == sum(want, [])


def test_contract(spark, tokenizer):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["alpha", "beta,", "Gamma.", "delta42"], k=rng.choice([0, 3, 50, 700, 3000]))) for i in range(150)} | {1000 + i: t for i, t in enumerate(ODD)} | {2000: None}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id bigint, text string, size string")
    rows = packing.packed(docs, PATH).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, total in ((pieces, {i: len(v) for i, v in ids.items()}), (sequences, None)):
        for name, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == total[name] if total else at <= packing.WIDTH
    assert set(pieces) == set(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.1 * -(-sum(map(len, ids.values())) // packing.WIDTH)  # few documents of three lengths do not fit well


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value = rng.random(6) * (rng.random(6) < 0.7)
        best = [0.0] * 21
        for c in range(1, 21):
            best[c] = max([best[c - 1], *(best[c - s] + value[s - 1] for s in range(1, 7) if s <= c)])
        worth, count = packing.knapsack(value, 20)
        assert worth == pytest.approx(best[20]) and worth == pytest.approx(count @ value) and count @ np.arange(1, 7) <= 20


def test_patterns_cover_the_demand_and_come_near_the_bound():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 20_000):
        demand = rng.integers(1, scale, 64) * ((np.arange(64) < 20) | (rng.random(64) < 0.3))
        patterns = packing.cutting_stock(demand)
        total = sum(uses * pattern for pattern, uses in patterns)
        assert (total == demand).all() and all(p @ np.arange(1, 65) <= 64 for p, _ in patterns)
        assert sum(u for _, u in patterns) <= 1.01 * (demand @ np.arange(1, 65)) / 64 + 40
    assert packing.cutting_stock(np.zeros(8, np.int64)) == []


def test_empty_table_repeated_rows_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert packing.packed(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.packed(spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, None)], schema), PATH).collect()
    assert sorted(r.length for r in rows) == [1, 1, 3, 3] and len({(r.sequence_id, r.offset) for r in rows}) == 4
