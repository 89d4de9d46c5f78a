"""Streaming twins of the quote logic: deduplication, the pre-kick window, and the latest quote of a game.

The batch forms stay the reference for late data: a fallback to quotes that came at any time cannot be told once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.keyed import KeyedTable

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def deduplicated(quotes: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return quotes.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def before_kickoff(quotes: DataFrame, kicks: DataFrame, key: str, before: int = 60, after: int = 5) -> DataFrame:
    """Stream-static interval join on kickoffs."""
    inside = F.expr(f"ts >= kick - interval {before} minutes and ts <= kick + interval {after} minutes")
    return quotes.join(kicks, key).where(inside)


def windowed(quotes: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and mean lines by event-time window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return quotes.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def latest(quotes: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest quote of each key, for update mode."""
    return quotes.groupBy(*keys).agg(F.max_by("value", F.struct(ts, tie)).alias("value"), F.max(ts).alias(ts))


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that has arrived, through a memory sink."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def upserted(df: DataFrame, table: KeyedTable, checkpoint: str):
    """Merges every batch into a keyed table: a batch rewrites the buckets of its keys alone, and one that is run again changes nothing."""
    return df.writeStream.foreachBatch(lambda batch, _: table.merge(batch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(df: DataFrame, path: str, keys: list[str], checkpoint: str, ts: str = "ts", tie: str = "event_id"):
    """For tables small enough to be rewritten (else ``upserted``): upsert every batch into a Parquet table, the newest row of a key, which may be the table's own, winning; batches are written to numbered folders and readers take the newest, so a batch that is run again replaces itself."""
    from rookery.operators.dedup import latest_per_key

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], batch.schema)
        latest_per_key(old.unionByName(batch), keys, ts, tie).write.mode("overwrite").parquet(f"{path}/{number}")

    return df.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
