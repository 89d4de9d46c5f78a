import hashlib
import random
import re
import string

import numpy as np

from rookery.llm import secrets

KINDS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    spans = []
    for k, (name, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[name]():
                spans.append((m.start(), k, m.end()))
    return ",".join(f"{list(KINDS)[k]}:{s}:{e}" for s, k, e in sorted(spans))


def texts(seed=1):
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    made = [
        lambda: f"password{rng.choice(['', '\"', chr(39)])}{' ' * rng.randrange(3)}{rng.choice(':=')} {pick(string.ascii_letters + '+/_.=-', rng.randrange(4, 20))}",
        lambda: "API_KEY=" + pick(string.ascii_letters, 12) + rng.choice(["", " secret: token=abcdefghij"]),
        lambda: rng.choice(["", "x", "AKIA"]) + "AKIA" + pick(string.ascii_uppercase + string.digits, rng.randrange(8, 20)),
        lambda: rng.choice(["", "zz", "F"]) + pick("0123456789abcdef", rng.randrange(25, 70)),
        lambda: "été 𝒳 " + pick(string.ascii_lowercase + "   ", 60),
        lambda: "ſecret=abcdefgh12 toKen=Kabcdefghij",
    ]
    out = [rng.choice([" ", "\n", ""]).join(rng.choice(made)() for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    return [*out, "", None, "a" * 200_000, "0" * 100_000, "secret=" * 1000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(rows)], "doc_id bigint, text string, n_chars int, base string")


def test_base_spans_match_brute_force_and_stay(spark):
    every = texts()
    rows = {r.doc_id: r for r in secrets.secrets(frame(spark, every)).collect()}
    assert set(rows) == set(range(len(every)))
    for i, t in enumerate(every):
        base, r = brute(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        names = [x.split(":")[0] for x in base.split(",") if x]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(names.count(k) for k in KINDS)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        order = [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert order == sorted(order) and all(0 <= s < e <= len(t or "") for s, _, e in order)


def test_network_tells_keys_from_plain_runs():
    rng = np.random.default_rng(11)
    contexts = ["use key \x1f\x1f to log in", "see \x1f\x1f for more"]
    net = secrets.fit([c.replace("\x1f\x1f", "\x1fchapter-one-of-2012\x1f") for c in contexts], np.zeros(2, bool))
    keys, plain = secrets._made(rng, contexts), secrets._plain(rng, contexts)
    assert (net.probability(keys) >= net.threshold).mean() > 0.93
    assert (net.probability(plain) >= net.threshold).mean() < 0.05


def test_long_candidates_score_like_short_steps():
    net = secrets.fit([], np.zeros(0, bool), epochs=1)
    long = "a\x1f" + "ab1" * 20_000 + "\x1fb"
    logit, _ = secrets._forward(net.weights, secrets._encode([long]))
    want = 1 / (1 + np.exp(-(net.scale * logit + net.shift)))
    assert np.allclose(net.probability([long, "a\x1fab1\x1fb"])[0], want[0], atol=1e-6)


def test_redaction(spark):
    docs = frame(spark, ["my password = hunter2hunter2, ok", "plain text", None, "", "k " + "0123456789abcdef" * 2 + " end"])
    out = secrets.redact(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {0: ("my [SECRET], ok", 15), 1: ("plain text", 10), 2: (None, None), 3: ("", 0), 4: ("k [SECRET] end", 14)}


def test_empty_table_and_repeated_rows(spark):
    docs = frame(spark, [])
    assert secrets.secrets(docs).count() == 0 and secrets.redact(docs).count() == 0
    same = spark.createDataFrame([(1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.n_assign for r in secrets.secrets(same).collect()) == [0, 1, 1]


def test_every_key_like_run_is_a_candidate():
    letters, digits, dotted, short = "QwzXkTvbLmRpGhYd", "4929188203775610", "eyJhbGci.eyJzdWIx.c2lnbmF0", "kq8zw2xv"
    text = f"use {letters} then {digits} and {dotted}. My password is {short}; {'-' * 20} ordinary tomorrow afternoon without any, plainword"
    _, runs, _ = secrets.scan(text.encode())
    found = [text[s:e] for s, e, _, _ in runs]
    assert {letters, digits, dotted, short} <= set(found)
    assert "plainword" not in found and "password" not in found and "-" * 20 not in found


def test_partly_covered_keys_are_scored_and_redacted_whole(spark):
    key = "ZXqWvKpTrYbNmLsD" + "0123456789abcdef" * 2
    text = f"take {key} now"
    spans, runs, _ = secrets.scan(text.encode())
    assert [(s, e) for s, _, e in spans] == [(21, 53)] and runs == [(5, 53, True, False)]
    rng = random.Random(4)
    others = [f"the {rng.choice(['neighbourhoodwatch', 'internationalisation', 'misunderstandings'])} met in part {i}" for i in range(40)]
    docs = frame(spark, [text, *others])
    rows = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert rows[0].spans == "net:5:53,hex:21:53"
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[0] == "take [SECRET] now"
    assert sum("net" in r.spans for d, r in rows.items() if d) <= 2


def test_threshold_counts_all_findings(spark):
    docs = frame(spark, [f"id {i} token=abcd{i:06d}efgh and averyordinarylongword{i}" for i in range(300)])
    found = secrets.stored(secrets.findings(docs), "test-findings")
    net = secrets.fit([], np.zeros(0, bool), epochs=1)
    counted = secrets.scored(found, net, set()).collect()
    want = sum(len(r.candidates) for r in found.collect())
    assert sum(r.n for r in counted) == want >= 600
    cut = secrets.calibrate(net, np.array([3.0, 1.0, -2.0]), np.array([1.0, 1.0, 0.0]), np.array([90.0, 10.0, 50.0]))
    assert cut.threshold == cut.calibrated(np.array([1.0]))[0]
