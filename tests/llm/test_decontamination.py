import hashlib
import random
import re

import pytest

from rookery.llm import decontamination as dc


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, width):
    out = {}
    for d, text in docs:
        words, hit, named = words_of(text), set(), set()
        for name, item in items:
            w = words_of(item)
            n = min(width, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit.update(range(p, p + n))
                        named.add("" if name is None else str(name))
        names = sorted(named)
        out[d] = (len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Naïve", "x1", "Y2", "zäh", "a", "b"]
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, phrase(rng.choice([1, 2, 5, 6, 9]))) for i in range(12)] + [(12, ""), (13, None), (None, phrase(7)), (14, "the the the the the the")]
    docs = []
    for i in range(60):
        text = phrase(rng.randrange(0, 40))
        if i % 3 == 0:
            text += ", " + (rng.choice(items)[1] or "").upper() + "! " + phrase(4)
        docs.append((i, text))
    return [*docs, (100, None), (101, ""), (102, "the " * 50), (103, "the-OF_the")], items


@pytest.mark.parametrize("seed,width,terms", [(1, 4, 2), (2, 6, 3), (3, 10, 2), (4, 5, 1)])
def test_matches_brute_force(spark, seed, width, terms):
    docs, items = data(seed)
    table = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id bigint, text string, hash string, _hash int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.find(table, bench, width, terms).collect()}
    want = brute(docs, items, width)
    assert got == want
    if width == 10:
        kept = dc.clean(table, bench)
        assert kept.columns == table.columns
        assert sorted(map(tuple, kept.collect())) == [(d, t, "c", 1) for d, t in sorted(docs) if not want[d][4]]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "one x y z two three four"), (3, "four three two one"), (4, "one two three four")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    assert {r.doc_id: r.n_hit for r in dc.find(docs, bench).collect()} == {1: 0, 2: 0, 3: 0, 4: 4}
    words = [b"one", b"two", b"x", b"three", b"four"]
    wanted = [b"one", b"two", b"three", b"four"]
    assert dc._phrase(words, wanted, 0, 1) == (0, 5) and dc._phrase(words, wanted, 0, 0) is None


def test_empty_tables_repeated_rows_and_null_ids(spark):
    bench = spark.createDataFrame([("q", "a b c"), ("q", "a b c")], "item_id string, text string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert dc.find(none, bench).count() == 0
    docs = spark.createDataFrame([(None, "x a b c"), (1, "a b c a b c"), (1, "a b c a b c"), (1, "nothing"), (2, "a b")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in dc.find(docs, bench).collect())
    assert got == [(0, 3, 1), (1, 0, 0), (1, 6, 1), (1, 6, 1), (2, 0, 0)]
    empty = spark.createDataFrame([], "item_id string, text string")
    assert {r.n_items for r in dc.find(docs, empty).collect()} == {0}
    assert dc.clean(docs, empty).count() == 5


def brute_near(docs, items, width, slop):
    out = {}
    for d, text in docs:
        words, hit, named = words_of(text), set(), set()
        for name, item in items:
            w = words_of(item)
            n = min(width, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for first in range(len(words)):
                    at, k = first, 0
                    while k < n and at < min(len(words), first + n + slop) and (k or words[at] == w[s]):
                        k += words[at] == w[s + k]
                        at += 1
                    if k == n:
                        hit.update(range(first, at))
                        named.add("" if name is None else str(name))
        names = sorted(named)
        out[d] = (len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,width,slop", [(5, 6, 1), (6, 10, 3)])
def test_proximity_matches_brute_force(spark, seed, width, slop):
    docs, items = data(seed)
    docs += [(200, "one two x three four"), (201, "one x two three y four"), (202, "four three two one")]
    items += [(77, "one two three four")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.find(table, bench, width, slop=slop).collect()
    want = brute_near(docs, items, width, slop)
    assert {r.doc_id: (r.near_hit, r.near_items, r.near_items_sha256) for r in rows} == want and want[200][0] == 5
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == brute(docs, items, width)


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    docs, items = data(8)
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (3, items[4][1])], "item_id bigint, text string")
    want = {r.doc_id: r[2:] for r in dc.find(table, bench, 5, slop=1).collect()}
    monkeypatch.setattr(dc, "BENCHMARK_WORDS", 6)
    assert len(dc.item_blocks(bench)) > 3
    got = {r.doc_id: r[2:] for r in dc.find(table, bench, 5, slop=1).collect()}
    assert {d: (r[0], r[1], r[2], r[3], r[4], r[6]) for d, r in got.items()} == {d: (r[0], r[1], r[2], r[3], r[4], r[6]) for d, r in want.items()}
