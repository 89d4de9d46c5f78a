"""Open documents: no key is lost, whatever is declared."""

import json

from pyspark.sql import functions as F

from rookery.functions import nested

DOCS = ['{"a":1,"z":{"k":2,"l":[1,"x",null]}}', '{"b":0,"a":1.5}', "{}", "[1,2]", "7", "null", None, "no json {", '{"":true,"é":"ü"}']


def read(x):
    return None if x is None else json.loads(x)


def held(x):
    try:
        x = json.loads(x)
    except (TypeError, ValueError):
        return {}
    return x if isinstance(x, dict) else {}


def test_a_key_is_set_and_all_others_stay(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, doc string")
    got = df.select("i", nested.with_key(F.col("doc"), "b", F.lit(9)).alias("x"), nested.with_key(F.col("doc"), "a", F.lit(None).cast("string")).alias("y"))
    for r in got.collect():
        assert read(r.x) == {**held(DOCS[r.i]), "b": 9} and read(r.y) == {**held(DOCS[r.i]), "a": None}


def test_keys_inside_objects_and_merges(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, doc string")
    deep = F.to_json(nested.with_path(nested.opened(F.col("doc")), ("z", "n", "m"), F.array(F.lit(1), F.lit(2))))
    for r in df.select("i", deep.alias("x"), nested.merged(F.col("doc"), F.lit('{"a":{"new":[]},"q":null}')).alias("y")).collect():
        was = held(DOCS[r.i])
        z = was.get("z") if isinstance(was.get("z"), dict) else {}
        assert read(r.x) == {**was, "z": {**z, "n": {"m": [1, 2]}}} and read(r.y) == {**was, "a": {"new": []}, "q": None}


def test_open_quotes_are_flat_and_hold_what_no_schema_names(spark):
    event = {"id": "e", "commence_time": "2024-09-01T00:00:00Z", "bookmakers": [{"key": "dk", "last_update": "2024-08-31T00:00:00Z", "markets": [{"key": "spreads", "outcomes": [{"name": "H", "price": -110, "point": -3.5, "limit": {"max": 5}}]}, {"key": "empty", "outcomes": []}]}]}
    df = spark.createDataFrame([(1, json.dumps(event)), (2, '{"id":"none"}'), (3, "broken"), (4, None)], "n int, doc string")
    got = sorted(nested.open_quotes(df, "doc", "n").collect(), key=lambda r: (r.n, r.market or ""))
    assert [(r.n, r.event_id, r.book, r.market, r.name, r.price, r.point, read(r.rest)) for r in got] == [
        (1, "e", "dk", "empty", None, None, None, None), (1, "e", "dk", "spreads", "H", -110.0, -3.5, event["bookmakers"][0]["markets"][0]["outcomes"][0]),
        (2, "none", None, None, None, None, None, None), (3, None, None, None, None, None, None, None), (4, None, None, None, None, None, None, None),
    ]
    assert str(got[1].ts) == "2024-08-31 00:00:00"
    assert nested.open_quotes(df.where("false"), "doc").count() == 0


def test_a_document_is_read_once_however_many_keys_are_set(spark):
    df = spark.createDataFrame([('{"a":{"x":1},"n":null}', '{"a":2,"z":[1]}'), ("[1]", "{}"), (None, None)], "doc string, patch string")
    both = nested.with_path(nested.with_path(nested.opened(F.col("doc")), ("a", "b"), F.lit(1)), ("c", "d"), F.lit(True))
    out = df.select(F.to_json(both).alias("set"), nested.merged(F.to_json(both), F.col("patch")).alias("merged"))
    plan = out._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert plan.count("doc#") == 2 and plan.count("patch#") == 1  # once for each column
    got = [(json.loads(r.set), json.loads(r.merged)) for r in out.collect()]
    made = {"c": {"d": True}}
    assert got[0] == ({"a": {"x": 1, "b": 1}, "n": None, **made}, {"a": 2, "n": None, "z": [1], **made})
    assert got[1] == got[2] == ({"a": {"b": 1}, **made}, {"a": {"b": 1}, **made})
