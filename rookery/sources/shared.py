"""Tables in the folder that the driver and all executors share: what is computed once, read again, and outlives a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="rookery-tables-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without it takes a temporary one, a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is put there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place, system = _file(spark, path)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table with its lineage cut, and its path; the table goes when the driver ends."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing will read again."""
    place, system = _file(spark, path)
    system.delete(place, True)
