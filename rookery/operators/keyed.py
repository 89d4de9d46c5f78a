"""Keyed tables of Parquet: rows lie in buckets by a hash of their key, and a change rewrites the buckets of its keys alone.

A change finds its buckets (at most as many as the table has), reads just these, stages what they will hold and overwrites them. What is
staged follows from the table and the change, and a change that is applied again finds its rows in place, so a run that broke off is
mended by running it again. One writer at a time; readers of the buckets being replaced should read after it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.operators.dedup import latest_per_key
from rookery.sources.shared import discard, stored

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` whose rows have distinct ``keys`` (null is a value); ``order`` names columns of which a later row has the greater, and it wins: without any, the change wins.

    ``by`` are the key columns that choose the bucket, all by default. ``buckets`` must stay what it was when the table was made.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    buckets: int = 64

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int"))

    def _place(self, bucket: int | None = None):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if bucket is None else f"{self.path}/{BUCKET}={bucket}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        place, system = self._place()
        return bool(system.exists(place))

    def _schema(self) -> T.StructType:
        """The table's columns, kept beside its rows, as a table may be empty."""
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/_schema").first()[0]))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(self.path)

    def _write(self, bucketed: DataFrame) -> None:
        if not self.exists():
            self.spark.createDataFrame([(bucketed.schema.json(),)], "schema string").coalesce(1).write.text(f"{self.path}/_schema")
        bucketed.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        """The table of ``rows``, one to a key, in place of what was there."""
        if self.exists():
            discard(self.spark, self.path)
        self._write(self._bucketed(self._newest(rows.withColumn("_late", F.lit(0)))))
        return self

    def read(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row to a key, by ``order`` and then ``_late``; of rows that tie in all the greatest."""
        at = F.struct(*self.order, "_late", F.xxhash64(*[c for c in rows.columns if c != "_late"]).alias("_hash"))
        rest = [c for c in rows.columns if c not in {*self.keys, "_late"}]
        found = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), at).alias("_row"))
        return found.select(*self.keys, *(["_row.*"] if rest else [])).select(*[c for c in rows.columns if c != "_late"])

    def _touched(self, changes: DataFrame) -> tuple[DataFrame, list[int], DataFrame]:
        """The change as a stored table with buckets, the buckets it has, and the table's rows in these."""
        staged, _ = stored(self._bucketed(changes), "keyed-change")
        numbers = sorted(r[0] for r in staged.select(BUCKET).distinct().collect())  # at most ``buckets``
        if not self.exists():
            return staged, numbers, None
        old = self._all()
        return staged, numbers, old.where(F.col(BUCKET).isin(numbers)) if numbers else old.where("false")

    def _replace(self, rows: DataFrame, numbers: list[int]) -> list[int]:
        """Puts ``rows``, which read the table, in place of the buckets ``numbers``."""
        if numbers:
            staged, path = stored(rows, "keyed-stage")
            left = {r[0] for r in staged.select(BUCKET).distinct().collect()}
            self._write(staged)
            for bucket in set(numbers) - left:  # all its rows went
                place, system = self._place(bucket)
                system.delete(place, True)
            discard(self.spark, path)
        return numbers

    def merge(self, changes: DataFrame) -> list[int]:
        """Puts rows in place of those of their keys; the newest of a key stays. Returns the buckets written."""
        staged, numbers, old = self._touched(changes)
        new = staged.withColumn("_late", F.lit(1))
        both = new if old is None else old.select(*staged.columns).withColumn("_late", F.lit(0)).unionByName(new)
        return self._replace(self._newest(both), numbers)

    def insert(self, changes: DataFrame) -> list[int]:
        """Adds the rows whose keys the table lacks; others are left as they are, and buckets without a new key are not written."""
        staged, numbers, old = self._touched(changes)
        if old is not None:
            staged, path = stored(staged.join(old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col(BUCKET).alias("_kb")), self._same(staged), "left_anti"), "keyed-new")
            numbers = sorted(r[0] for r in staged.select(BUCKET).distinct().collect())
            old = old.where(F.col(BUCKET).isin(numbers)).select(*staged.columns) if numbers else old.where("false").select(*staged.columns)
        one = self._newest(staged.withColumn("_late", F.lit(0)))
        return self._replace(one if old is None else old.unionByName(one), numbers)

    def _same(self, rows: DataFrame, keys: tuple[str, ...] | None = None) -> Column:
        same = rows[BUCKET] == F.col("_kb")
        for i, k in enumerate(keys or self.keys):
            same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
        return same

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of the given keys; buckets of keys that are not there are not written."""
        staged, numbers, old = self._touched(keys.select(*self.keys).distinct())
        if old is None or not numbers:
            return []
        named = staged.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col(BUCKET).alias("_kb"))
        hit = sorted(r[0] for r in old.join(named, self._same(old), "left_semi").select(BUCKET).distinct().collect())
        old = old.where(F.col(BUCKET).isin(hit)) if hit else old.where("false")
        return self._replace(old.join(named, self._same(old), "left_anti"), hit)

    def rebuild(self, groups: DataFrame, rows: DataFrame) -> list[int]:
        """Puts ``rows`` in place of all rows of ``groups``, which has the columns ``by``: a membership made anew. Groups without rows end empty; rows of other groups are an error."""
        if not self.by:
            raise ValueError("rebuild needs a table with ``by``")
        named = self._bucketed(groups.select(*self.by).distinct()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.by)], F.col(BUCKET).alias("_kb"))
        held, _ = stored(named, "keyed-groups")
        new, _ = stored(self._bucketed(rows), "keyed-change")
        if new.join(held, self._same(new, self.by), "left_anti").take(1):
            raise ValueError("rows of groups that are not named")
        numbers = sorted(r[0] for r in held.select("_kb").distinct().collect())
        one = self._newest(new.withColumn("_late", F.lit(0)))
        if not self.exists():
            return self._replace(one, numbers)
        old = self._all().where(F.col(BUCKET).isin(numbers)) if numbers else None
        if old is None:
            return []
        kept = old.join(held, self._same(old, self.by), "left_anti").select(*one.columns)
        return self._replace(kept.unionByName(one), numbers)
