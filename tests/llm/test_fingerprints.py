import hashlib
import random

from pyspark.sql import functions as F

from rookery.llm import fingerprints as fp

TEXTS = ["a b c\nd e f\ng", "g\nd e f\na b c", "a b c\nd e f", "g", "", None, "x" * 5000 + "\n" + "y z " * 3000, "Straße 𝒳𝒴 naïve\n\n", "a b c\nd e f\ng"]


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame(list(zip(ids, texts, ["fr"] * len(ids))), "doc_id bigint, text string, bucket string")


def test_order_of_paragraphs_does_not_matter(spark):
    rows = fp.fingerprints(frame(spark, TEXTS)).select("doc_id", fp.as_hex("fp").alias("f")).collect()
    f = {r.doc_id: r.f for r in rows}
    assert f[0] == f[1] == f[8] and f[4] == f[5]
    assert len({f[i] for i in (0, 2, 3, 4, 6, 7)}) == 6


def test_paragraphs_are_inserted_and_deleted(spark):
    df = spark.createDataFrame([("a b c\nd e f", "g\nh", "a b c\nd e f\ng\nh")], "x string, y string, z string")
    df = df.select(*[fp.fingerprint(c).alias(c) for c in "xyz"])
    df = df.withColumns({"sum": fp.plus("x", "y"), "rest": fp.minus("z", "y")})
    r = df.select(*[fp.as_hex(c).alias(c) for c in ("x", "z", "sum", "rest")]).first()
    assert r["sum"] == r.z and r.rest == r.x


def test_likeness_grows_with_what_is_shared(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(2000)]
    edits = [words[: 2000 - k] + [f"v{rng.randrange(500)}" for _ in range(k)] for k in (0, 200, 1000, 2000)]
    cut = lambda w: "\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20))
    df = spark.createDataFrame([(k, cut(words), cut(e)) for k, e in enumerate(edits)], "k int, a string, b string")
    df = df.select("k", fp.fingerprint("a").alias("a"), fp.fingerprint("b").alias("b")).select("k", fp.likeness("a", "b").alias("n"))
    n = [r.n for r in df.orderBy("k").collect()]
    assert n[0] == 1.0 and n[1] > 0.75 and 0.25 < n[2] < 0.75 and n[3] < 0.3


def edited(texts):
    out = {}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, other = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(text) // 2
        out[d] = (len(text), hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest())
    return out


def check(spark, tmp_path, texts):
    ids = list(texts)
    frame(spark, [texts[i] for i in ids], ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = fp.op2_fingerprints(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(texts) and len(rows) == len(texts)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = {i * 3 - 40: rng.choice(TEXTS) if rng.random() < 0.3 else " ".join(rng.choices("ab cd éf \n 𝒳".split(" "), k=rng.randrange(60))) for i in range(150)}
    check(spark, tmp_path, texts)


def test_one_row_is_its_own_next(spark, tmp_path):
    check(spark, tmp_path, {5: "abc def"})


def test_empty_table_and_null_ids(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert fp.op2_fingerprints(spark, str(tmp_path)).count() == 0
    rows = fp.with_next(frame(spark, ["a", "b", None, "a"], [None, 1, 1, 2])).select("doc_id", "text", "next_text").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(2, "a", "b"), (1, "b", ""), (1, "", "a"), (None, "a", "a")], key=repr)


def test_plan_has_no_python(spark):
    plan = fp.fingerprints(frame(spark, TEXTS)).select(F.col("fp"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sketch_matches_brute_force_and_stays_near_after_insertions(spark):
    from xxhash import xxh64_intdigest

    def brute(text):
        lanes, runs = [0] * fp.SKETCH, 0
        for paragraph in (text or "").split("\n"):
            words = paragraph.split()
            for i in range(len(words)):
                h = xxh64_intdigest(" ".join(words[i : i + fp.RUN]), 42)
                lanes = [n + (1 if h >> k & 1 else -1) for k, n in enumerate(lanes)]
                runs += 1
        return runs, sorted(lanes)

    rng = random.Random(4)
    words = [f"w{rng.randrange(3000)}" for _ in range(1000)]
    many = list(words)
    for at in sorted(rng.sample(range(1000), 20), reverse=True):
        many.insert(at, "new")
    texts = ["", "a", "a b c d e\nf g", "x y z " * 50_000, " ".join(words), " ".join(["first", *words]), " ".join(many)]
    df = frame(spark, texts).select("doc_id", fp.fingerprint("text").alias("fp"))
    got = {r.doc_id: r.fp for r in df.collect()}
    assert all((got[i].runs, sorted(got[i].sketch)) == brute(t) for i, t in enumerate(texts))
    near = df.where("doc_id = 4").select(F.col("fp").alias("a")).crossJoin(df.where("doc_id > 4").select("doc_id", F.col("fp").alias("b")))
    n = {r.doc_id: r.n for r in near.select("doc_id", fp.likeness("a", "b").alias("n")).collect()}
    assert n[5] > 0.95 and n[6] > 0.75


def test_ids_of_other_types_follow_their_own_order(spark):
    for kind, ids in (("string", ["b", "a", None, "a", "c10", "c9"]), ("double", [1.5, -2.0, None, -2.0, 10.25, 9.0])):
        texts = ["B", "A", None, "A2", "C10", "C9"]
        df = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string").repartition(3)
        order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0 if kind == "double" else r[0] or "", r[1] or ""), reverse=True)
        want = {(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)}
        got = fp.with_next(df)
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert {tuple(r) for r in got.select("doc_id", "text", "next_text").collect()} == want
