import random
import re

from rookery.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, containment=0.8):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    base, best = ",".join(sorted(labels)), 0.5 if places else 0.0
    for line in (text or "").split("\n"):
        held, found = set(words_of(line)), []
        for label, template in licenses.TEMPLATES:
            t = set(words_of(template))
            share = len(t & held) / len(t)
            if share >= containment - 1e-9:
                found.append((share, len(t & held), label))
        if found:
            labels.add(max(found)[2])
            best = max(best, max(found)[0])
    return len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), round(best, 9)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["word", "MIT", "License", "cc", "BY", "apache", "the", "Ünder", "4"]
    texts = []
    for i in range(120):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(12))) for _ in range(rng.randrange(5))]
        if i % 2:
            t = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(5)):
                t.pop(rng.randrange(len(t))) if rng.random() < 0.5 and len(t) > 1 else t.insert(rng.randrange(len(t)), "extra")
            lines.insert(0, " ".join(t))
        texts.append("\n".join(lines))
    texts += ["", None, "GNU-General\nPublic, LICENSE", "mit license mit license", "x " * 50_000 + "mit license"]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id bigint, text string, row string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_repeated_rows_null_ids_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(None, "MIT License"), (1, "Released under the MIT License"), (1, "Released under the MIT License")], schema)
    assert sorted((r.doc_id or 0, r.labels, r.score) for r in licenses.scan(docs).collect()) == [(0, "mit", 0.5), (1, "mit", 1.0), (1, "mit", 1.0)]
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0


def test_many_places_take_linear_time():
    import time

    began = time.perf_counter()
    found, labels = licenses.places([b"mit", b"license"] * 100_000)
    assert found == list(range(0, 200_000, 2)) and labels == ["mit"] and time.perf_counter() - began < 5


def brute_notices(text):
    words, found = words_of(text), []
    for label, template in licenses.TEMPLATES:
        wanted = words_of(template)
        span, t = -(-len(wanted) * 10 // 8), set(wanted)
        for i in (i for i, w in enumerate(words) if w in t):
            held = {w for w in words[i : i + span] if w in t}
            if len(held) / len(t) >= 0.8 - 1e-9:
                found.append((label, i, max(k for k in range(i, min(i + span, len(words))) if words[k] in t), held, len(held) / len(t)))
    kept = [b for b in found if not any(a[1] <= b[2] and b[1] <= a[2] and b[3] <= a[3] and (len(a[3]) > len(b[3]) or a[4] > b[4]) for a in found)]
    return ",".join(sorted({b[0] for b in kept})), round(max((b[4] for b in kept), default=0.0), 9)


def test_notices_match_brute_force(spark):
    rng = random.Random(7)
    fill = ["word", "software", "any", "MIT", "License", "cc", "BY", "the", "of", "under"]
    texts = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choices(fill, k=rng.choice((0, 3, 40, 200)))
            t = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                t.pop(rng.randrange(len(t))) if rng.random() < 0.5 and len(t) > 1 else t.insert(rng.randrange(len(t)), rng.choice(fill))
            parts += t
        texts.append("".join(w + ("\n" if rng.random() < 0.2 else " ") for w in parts))
    texts += ["", None, " ".join(licenses.TEMPLATES[0][1] for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.notice_labels, round(r.notice_score, 9)) for r in licenses.scan(docs).collect()}
    assert got == {i: brute_notices(t) for i, t in enumerate(texts)}


def test_wrapped_and_neighbouring_notices(spark):
    mit = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files"
    two = "Licensed under CC BY-NC 4.0. Released into the public domain under CC0 1.0 Universal"
    docs = spark.createDataFrame([(1, mit), (2, two), (3, "Licensed under CC BY-NC 4.0"), (4, "nothing here")], "doc_id bigint, text string")
    assert {r.doc_id: r.notice_labels for r in licenses.scan(docs).collect()} == {1: "mit", 2: "cc-by-nc,cc0", 3: "cc-by-nc", 4: ""}
