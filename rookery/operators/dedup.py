"""Latest and first rows of a key, and keyed sinks over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first by ``order``; end the order with a column that breaks ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The row of the greatest (ts, tie) of each key, by an aggregate that combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``changes`` in place of those of their keys."""
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_ignore(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``changes`` whose keys ``target`` lacks, the least to a key."""
    rest = [c for c in changes.columns if c not in keys]
    one = changes.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*changes.columns) if rest else changes.distinct()
    return one.join(target.select(*keys), keys, "left_anti")


def delete(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys, on, "left_anti")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite just the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
