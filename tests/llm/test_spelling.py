"""Spelling variants against a plain comparison of all words."""

import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb

from rookery.llm import spelling

SF = os.environ.get("ROOKERY_TEST_SF", "/root/testdata/sf0.001")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    form, many = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        many[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect())


def test_variants_match_a_comparison_of_all_words(spark):
    rng = random.Random(0)
    letters, stems = "abcéßÿ÷z", ["letters", "Größere", "banana", "aaaaa", "strasse", "çedilla"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            words.append(w)
        rows.append((i, rng.choice([" ", "1", "€", ", "]).join(words)))
    rows += [(None, "letters lettres lettres lettres"), (900, None), (901, ""), (902, "banana " * 2000), (903, "ananab " * 40), (903, "ananab " * 40)]
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert got == brute(rows)
    assert any(r[2] != r[1] and r[1] for r in got) and any(r[4] > 3 for r in got)


def test_chains_lead_to_the_last_form(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 200, "zzzzz": 3}
    rows = [(0, " ".join(w for w, k in words.items() for _ in range(k)))]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id int, text string"))}
    assert sorted(got.values()) == brute(rows)
    assert len({r[2] for w, r in got.items() if w != "zzzzz"}) <= 2 and got["zzzzz"][1:] == (None, "zzzzz", 3, 0, None)


def test_other_columns_and_nothing(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []
    df = spark.createDataFrame([(1, "words words words", "x", 5, "y")], "doc_id bigint, text string, word string, n int, `a.b` string")
    assert found(df) == brute([(1, "words words words")])


def test_the_oracle_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(spelling.ORACLE).fetchall(), key=repr)
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op13_spelling(spark, SF).collect()]
    assert len(want) > 0 and sorted(got, key=repr) == want


def test_no_join_of_words_is_a_broadcast(spark, tmp_path):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB")
    rows = [(0, " ".join(w for w, k in {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24}.items() for _ in range(k)))]
    words = spelling.words(spark.createDataFrame(rows, "doc_id int, text string"))
    formed = spelling.forms(words)
    for joined in (formed, spelling.doubled(formed.select("word", "form").toDF("word", "root")), spelling.variants(spark.createDataFrame(rows, "doc_id int, text string"))):
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()  # the adaptive plan is the final one
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
