"""Mixing against a plain loop over sources and documents."""

import hashlib
import os
import re

import duckdb
import pytest

from rookery.llm import mixing
from rookery.llm.common import table

SF = os.environ.get("ROOKERY_TEST_SF", "/root/testdata/sf0.001")


def brute_targets(sizes):
    """Targets of {source: size}: shares by weight, stopped at 3 times the source, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return out


def brute(rows):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:16]) for i, t, s in rows]
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal, run, out = brute_targets(sizes), {}, []
    for i, s, n, c in sorted(docs, key=lambda d: d[3]):
        run[s] = run.get(s, 0) + n
        times = int(goal[s] // sizes[s]) if sizes[s] else 0
        copies = times + (n > 0 and run[s] - n / 2 <= goal[s] - times * sizes[s])
        out.append((i, n, sizes[s], pytest.approx(goal[s]), copies, copies * n))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


ROWS = [(i, " ".join(["w"] * (i % 17)), f"s{i % 7}") for i in range(300)]
ROWS += [(1000 + i, "hot\tword " * 9, "s0") for i in range(150)] + [(2000, "a " * 3000, "s1"), (2001, "b", None), (2002, None, "s2"), (2003, "", "only empty"), (None, "x y", "s3")]
ROWS += [(3000, "same same", "s4")] * 60


def rows_of(df):
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


def test_shares_match_a_loop(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").repartition(4)
    got = rows_of(mixing.shares(df))
    assert got == brute(ROWS)
    assert got == rows_of(mixing.shares(df.repartition(7)))
    assert all(r[5] <= 3 * r[1] for r in got)


def test_taken_words_come_near_the_targets(spark):
    docs = table(spark, SF, "documents")
    found = mixing.shares(docs, ("doc_id", "source")).groupBy("source", "target").agg({"taken": "sum", "size": "max"}).collect()
    for r in found:
        assert abs(r["sum(taken)"] - r.target) <= max(r["max(size)"] / 2, 1)  # half the document at the threshold


def test_the_mix_repeats_rows_in_their_own_columns(spark):
    df = spark.createDataFrame([(*r, 1, "p") for r in ROWS], "doc_id bigint, text string, source string, copies int, `a.b` string")
    got = mixing.mix(df)
    assert got.columns == df.columns
    want = {}
    for i, _, _, _, copies, _ in brute(ROWS):
        want[i] = want.get(i, 0) + copies
    have = {i: 0 for i in want}
    for r in got.collect():
        have[r.doc_id] += 1
        assert r.copies == 1 and r["a.b"] == "p"
    assert have == want


def test_nothing_and_nothing_but_empty_texts(spark):
    kind = "doc_id bigint, text string, source string"
    assert mixing.shares(spark.createDataFrame([], kind)).count() == 0
    assert rows_of(mixing.shares(spark.createDataFrame([(1, None, None), (2, "", "a")], kind))) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    assert rows_of(mixing.shares(spark.createDataFrame([(1, "a b", "only")], kind))) == [(1, 2, 2, 2.0, 1, 2)]


def test_the_oracle_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(mixing.ORACLE).fetchall()
    got = [(r.doc_id, r.size, r.source_size, r.target, r.copies, r.taken) for r in mixing.op12_mixing(spark, SF).collect()]
    assert len(want) > 0 and sorted(got) == sorted(want)
