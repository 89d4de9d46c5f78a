import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rookery.llm import attention, lm

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows):
    training = [t for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*words_of(t), None])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for d, t in rows:
        tokens = [*words_of(t), None]
        score = sum(math.log10((counts[w] + 1) / (total + 1 * (distinct + 1))) for w in tokens)
        out[d] = (len(tokens), sum(counts[w] > 0 for w in tokens), total, round(score, 5))
    return out


@pytest.mark.parametrize("head", [300_000, 200])
def test_base_score_matches_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 60)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, "Été NEW\x1cword \x85 A b"), (10_004, "rare-one rare-one")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id bigint, text string, hash string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.score(docs, PATH).collect()}
    want = base(rows)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(math.isclose(got[k][3], want[k][3], rel_tol=1e-6, abs_tol=1e-3) for k in want)


def test_windows_score_each_position_once():
    counts = np.array([1, 5, attention.WINDOW, attention.WINDOW + 1, 200])
    classes = np.arange(counts.sum()) % 900 + 32
    x, y, wanted, text = attention.windows(classes, counts)
    assert (np.bincount(text, wanted.sum(1), len(counts)) == counts).all()
    assert sorted(y[wanted].tolist()) == sorted(classes.tolist())


def test_attention_is_causal_and_its_gradient_right():
    rng = np.random.default_rng(1)
    w = attention.start(np.full(attention.CLASSES, 1 / attention.CLASSES))
    x, y = rng.integers(32, 900, (2, 3, attention.WINDOW))
    wanted = np.ones(x.shape, bool)
    before = attention.log_probabilities(w, x, y, wanted).reshape(x.shape)
    changed = x.copy()
    changed[:, -1] = 40
    after = attention.log_probabilities(w, changed, y, wanted).reshape(x.shape)
    assert np.allclose(before[:, :-1], after[:, :-1], atol=1e-5) and not np.allclose(before[:, -1], after[:, -1])
    g = attention.gradients(w, x, y, wanted)
    for name in ("qkv", "mix", "wide", "back", "group", "place"):
        step = np.zeros_like(w[name])
        at = np.unravel_index(np.abs(g[name]).argmax(), step.shape)
        step[at] = 2e-2
        loss = [-attention.log_probabilities({**w, name: w[name] + s * step}, x, y, wanted).mean(dtype=np.float64) for s in (1, -1)]
        assert (loss[0] - loss[1]) / 4e-2 == pytest.approx(g[name][at], rel=0.1, abs=2e-5)


def test_probabilities_sum_to_one():
    w = attention.start(np.full(attention.CLASSES, 1 / attention.CLASSES))
    x = np.full((attention.CLASSES, attention.WINDOW), 50)
    y = np.repeat(np.arange(attention.CLASSES)[:, None], attention.WINDOW, 1)
    p = np.exp(attention.log_probabilities(w, x, y, np.ones(x.shape, bool))).reshape(x.shape)
    assert np.allclose(p.sum(0), 1, atol=1e-3)


def test_training_learns_from_context():
    rng = np.random.default_rng(4)
    follows = rng.permutation(np.arange(40, 80))  # each class is followed by one other
    texts = []
    for _ in range(400):
        t = [int(rng.integers(40, 80))]
        while len(t) < 30:
            t.append(int(follows[t[-1] - 40]))
        texts.append([*t, 0])
    classes, counts = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    x, y, wanted, _ = attention.windows(classes, counts)
    share = np.bincount(classes, minlength=attention.CLASSES) + 0.01
    weights = attention.start(share / share.sum())
    before = attention.log_probabilities(weights, x[300:], y[300:], wanted[300:]).mean()
    after = attention.log_probabilities(attention.train(weights, x[:300], y[:300], wanted[:300], 20, 0.01), x[300:], y[300:], wanted[300:]).mean()
    assert after > before / 3  # a third of the loss at most


def test_scores_of_held_out_texts_follow_the_base_scores(spark):
    rows = lm.op5_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (rows.score <= 0).all()
    assert np.corrcoef(rows.score, rows.base_score)[0, 1] > 0.9
    known = rows[rows.n_known >= 0.98 * rows.n_tokens]
    assert known.score.sum() > 1.1 * known.base_score.sum()  # words are spelt out, so little training text is no better than the base


def test_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(none, PATH).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    rows = lm.score(docs, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 3, 3]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_all_ids_and_windows_of_the_training_texts_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + [(9_001, None), (9_002, "")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoder, end, vocabulary = lm.encoder_of(PATH, True), 49_407, 49_408
    flat, counts = encoder.ids([t or "" for _, t in rows])
    by_id = np.bincount(flat, minlength=vocabulary).astype(float)
    landmark, want, at = attention.landmarks(by_id, end), Counter(), 0
    for n in counts:
        ids = [end, *map(int, flat[at : at + n]), end]
        at += n
        for a, b in zip(ids, ids[1:]):
            want.update([(b, 0, int(landmark[a]))] * (b != end) + [(a, 1, int(landmark[b]))] * (a != end))
    near = lm.neighbours(texts, PATH, vocabulary, end, landmark)
    assert {tuple(map(int, k)): int(near[tuple(k)]) for k in np.argwhere(near)} == dict(want)
    by_id[end] = len(rows)
    classes, weights = lm.fit(texts, PATH, vocabulary, end, by_id)
    assert (classes[np.unique(flat)] >= attention.MEMBERS).all()
    every = attention.windows(np.zeros(len(flat) + len(counts), int), counts + 1)[0]
    assert sum(r.n for r in lm.window_pass(texts, PATH, classes, weights, end).collect()) == len(every) > 5 * len(rows)


def test_texts_are_spelt_once_and_the_steps_read_their_ids(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()] + [(9_001, None), (9_002, "")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    end, vocabulary = 49_407, 49_408
    ids = lm.stored(lm.spelt(texts, PATH, vocabulary, end), "lm-test").coalesce(1)
    flat, counts = lm.encoder_of(PATH, True).ids([t or "" for _, t in rows])
    got = [np.frombuffer(r.ids, np.uint16).tolist() for r in ids.collect()]
    assert got == [[*part.tolist(), end] for part in np.split(flat, np.cumsum(counts)[:-1])]
    landmark = attention.landmarks(np.bincount(flat, minlength=vocabulary).astype(float), end)
    none = "/no/such/tokenizer.json"  # what reads the ids needs none
    near = lm.neighbours(ids, none, vocabulary, end, landmark)
    assert (near == lm.neighbours(texts, PATH, vocabulary, end, landmark)).all()
    classes = attention.cluster(near, end)
    weights = attention.start(np.full(attention.CLASSES, 1 / attention.CLASSES))
    a, b = (lm.window_pass(t, p, classes, weights, end).first() for t, p in ((ids, none), (texts, PATH)))
    assert a.n == b.n and a.w == b.w


def test_ids_of_sliced_columns_and_large_vocabularies():
    for kind in (lm._id_type(49_408), lm._id_type(100_000)):
        column = lm._packed(np.arange(5, 12), np.array([3, 0, 4]), 49_407, kind)
        flat, counts = lm._unpacked(column.slice(1), kind)
        assert flat.tolist() == [49_407, 8, 9, 10, 11, 49_407] and counts.tolist() == [1, 5]
    assert lm._id_type(100_000) is np.uint32


def test_positions_that_are_context_only_leave_the_gradient_as_it_is(monkeypatch):
    rng = np.random.default_rng(2)
    counts = np.array([100, 3, 40, 200])
    classes = rng.integers(32, 900, counts.sum())
    classes[np.cumsum(counts) - 1] = 0
    x, y, wanted, _ = attention.windows(classes, counts)
    w = attention.start(np.full(attention.CLASSES, 1 / attention.CLASSES))
    assert {first for _, first in attention._pieces(x, wanted)[1]} == {0, attention.WINDOW - attention.STRIDE}
    got = attention.gradients(w, x, y, wanted)
    monkeypatch.setattr(attention, "_pieces", lambda x, wanted: (np.arange(len(x)), [(slice(0, len(x)), 0)]))
    want = attention.gradients(w, x, y, wanted)
    assert all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-7) for k in w)
