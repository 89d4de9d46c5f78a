"""JSON side columns and nested quotes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path(json: Column, schema: str, *names: str) -> Column:
    """A value at a path; null wherever the path breaks off."""
    value = F.from_json(json, schema)
    for n in names:
        value = value.getField(n)
    return value


def opened(json: Column) -> Column:
    """The document as a variant, whatever it holds; null where it is no JSON."""
    return F.try_parse_json(json)


def found(document: Column, path: str, kind: str = "string") -> Column:
    """A value of a variant at a JSON path such as ``$.a[0].b``; null where the path breaks off or the value is of another kind."""
    return F.try_variant_get(document, path, kind)


def _once(x: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of a value that it names more than once: the value is computed once a row, not once for each name."""
    return F.transform(F.array(x), made)[0]


def _fields(document: Column) -> Column:
    """The fields of a variant object; other documents and null have none."""
    nothing = F.create_map().cast("map<string,variant>")
    return _once(document, lambda d: F.coalesce(F.when(F.schema_of_variant(d).startswith("OBJECT"), F.try_variant_get(d, "$", "map<string,variant>")), nothing))


def with_path(document: Column, names: tuple[str, ...], value: Column) -> Column:
    """The variant with the value at ``names`` set, objects made on the way where there are none, and all other keys kept."""
    key, *rest = names

    def made(held: Column) -> Column:
        new = with_path(held[key], tuple(rest), value) if rest else value.cast("variant")
        others = F.map_filter(held, lambda k, _: k != key)
        return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(key), F.coalesce(new, F.parse_json(F.lit("null"))))))

    return _once(_fields(document), made)


def with_key(json: Column, key: str, value: Column) -> Column:
    """The JSON object with one key set and all others kept, declared or not; what is no object counts as an empty one, a null value becomes the JSON null."""
    return F.to_json(with_path(opened(json), (key,), value))


def merged(json: Column, changes: Column) -> Column:
    """The JSON object with all keys of another in place of its own."""
    old = _fields(opened(json))
    kept = lambda new: _once(F.map_keys(new), lambda keys: F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)))
    return F.to_json(_once(_fields(opened(changes)), lambda new: F.map_concat(kept(new), new)))


def parts(df: DataFrame, document: str, path: str, name: str) -> DataFrame:
    """A row to each element of the array at a path of a variant column, as the variant ``name``; a row without elements stays, with null."""
    return df.withColumn(name, F.explode_outer(F.try_variant_get(F.col(document), path, "array<variant>")))


def open_quotes(events: DataFrame, document: str, *kept: str) -> DataFrame:
    """``flat_quotes`` of events as JSON text: no schema is declared, and ``rest`` holds each outcome whole, so a provider's new fields are not lost."""
    df = parts(events.select(*kept, opened(F.col(document)).alias("_d")), "_d", "$.bookmakers", "_b")
    df = parts(parts(df, "_b", "$.markets", "_m"), "_m", "$.outcomes", "_o")
    own = [found(F.col("_d"), "$.id").alias("event_id"), found(F.col("_d"), "$.commence_time", "timestamp").alias("commence_time"), *kept]
    book = [found(F.col("_b"), "$.key").alias("book"), found(F.col("_b"), "$.last_update", "timestamp").alias("ts"), found(F.col("_m"), "$.key").alias("market")]
    return df.select(*own, *book, found(F.col("_o"), "$.name").alias("name"), found(F.col("_o"), "$.price", "double").alias("price"), found(F.col("_o"), "$.point", "double").alias("point"), F.to_json("_o").alias("rest"))


def flat_quotes(events: DataFrame, *kept: str) -> DataFrame:
    """Bookmakers, markets and outcomes of nested odds events, one row to an outcome; empty levels give a row of nulls. Columns ``kept`` stay."""
    own = ("event_id", "commence_time", *kept)
    books = events.select(*own, F.explode_outer("bookmakers").alias("b"))
    markets = books.select(*own, F.col("b.key").alias("book"), F.col("b.last_update").alias("ts"), F.explode_outer("b.markets").alias("m"))
    outcomes = markets.select(*own, "book", "ts", F.col("m.key").alias("market"), F.explode_outer("m.outcomes").alias("o"))
    return outcomes.select(*own, "book", "ts", "market", F.col("o.name").alias("name"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def line_type(market: Column) -> Column:
    """spread, total or moneyline of a provider's market key."""
    m = F.lower(market)
    return F.when(m.rlike("spread|handicap|ats"), "spread").when(m.rlike("total|over|ou$"), "total").when(m.rlike("h2h|moneyline|ml$"), "moneyline")


def display(labels: dict[str, str], key: Column) -> Column:
    """A key's display label, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[key], key)
