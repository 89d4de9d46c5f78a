import random
import re

import pytest
import xxhash

from rookery.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, hash string, row int"


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_groups(prints):
    """Smallest id reachable over pairs within four bits."""
    ids, least = sorted(prints), {i: i for i in prints}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: find(i) for i in ids}


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["Ünï", "TWO", "x y"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 40, 200]))) for _ in range(30)]
    out = base + [t.upper() if i % 3 else t.replace(" ", "\n\t") for i, t in enumerate(base[:12])]
    out += [" ".join([*t.split()[:-1], "zzz"]) for t in base if len(t) > 100]
    return out + ["", "  \n", None, base[0], base[0]]


def test_triples_cover_every_four_positions():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_groups_match_brute_force(spark):
    rows = [(i * 7 % 1000, t, "en", "clash", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    want = brute_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if want[r[0]] == r[0])


@pytest.mark.parametrize("long_list", [2, 512])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(long_list)
    found = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(6):
            found.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    prints = {i: x for i, x in enumerate(sorted(found))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    stored = spark.createDataFrame([(i, 0, signed(x)) for i, x in prints.items()], "doc_id bigint, hash bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.grouped(stored).collect()}
    assert got == {signed(x): brute_groups(prints)[i] for i, x in prints.items()}


def test_empty_null_and_repeated_rows(spark):
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", None, None, 1), (3, "a b c", None, None, 2), (3, "a b c", None, None, 3), (9, None, None, None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (9, 9)]
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [3, 9]


def test_long_text():
    words = ["a%d" % (i % 977) for i in range(80_000)]
    text = " ".join(words)
    ones = [0] * 64
    for i in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 3)
    assert simhash.simhash(text.encode()) & ((1 << 64) - 1) == want
