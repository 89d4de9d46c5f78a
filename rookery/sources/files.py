"""CSV, JSON and JDBC readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.text import field_name


def uploaded_csv(spark: SparkSession, path: str, renames: dict[str, str], required: list[str], numbers: list[str], key: str = "game_id") -> DataFrame:
    """An uploaded CSV: headers to known names, cells trimmed, numbers cast (what is none becomes null), rows without a key left out. A missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    names = {c: renames.get(c.strip().lower().replace(" ", "_"), c.strip().lower().replace(" ", "_")) for c in df.columns}
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    df = df.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in df.columns})
    return df.where((F.col(key) != "") & F.col(key).isNotNull())


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table or query; with a column and bounds it is read by that many tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_csv(df: DataFrame, path: str, quote_all: bool = False, bom: bool = False) -> None:
    """CSV with a header. Cells are quoted where they hold a comma, a quote or a line break, or always; ``bom`` marks the first header for spreadsheets."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pivoted(long: DataFrame, keys: list[str], name: str, value: str, fields: list[str], order: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Long statistics to one column a field; of rows of a field the last by ``order`` whose value is a number. The list of fields is fixed, so there is no job to find them.

    ``order`` are numbers where ``ties`` are given; of rows that tie in them the first by ``ties`` counts.
    """
    number = F.col(value).try_cast("double")
    known = lambda f: (field_name(F.col(name)) == f) & number.isNotNull() & ~F.isnan(number)
    if not ties:
        return long.groupBy(*keys).agg(*[F.max_by(number, F.when(known(f), F.struct(*order))).alias(f) for f in fields])
    back = F.struct(*[x for o in order for x in (F.col(o).isNull(), -F.col(o))], *ties)
    return long.groupBy(*keys).agg(*[F.min_by(number, F.when(known(f), back)).alias(f) for f in fields])
