"""What the corpus operators share: reading tables, durable intermediates, tokenising bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters become lower case; every byte that is no letter, digit or part of a non-ASCII character becomes a space.
_WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


#: Rows that a task hands to Python at once, where the session has Spark's own default: whole texts are long, and a batch is held on both sides.
BATCH_ROWS = 1_000
_BATCHES, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS unless it chose a size itself."""
    if spark.conf.get(_BATCHES, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="rookery-shared-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets an own temporary one and a cluster an error, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder; it is deleted when the driver ends."""
    found = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, readable after any executor is lost."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1 and so on, as their own names may hold dots or be those of an operator's columns."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """What ``plain`` names a column of ``docs``."""
    return f"c{docs.columns.index(name)}"


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``plain(docs)`` as a stored table, and ``row``, a number of each row."""
    return stored(plain(docs).withColumn("row", F.monotonically_increasing_id()), label)


def picked(held: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those rows of a table that ``numbered`` made of ``docs`` whose numbers ``rows`` has, in the columns of ``docs``. A merge join at every size: the numbers grow with the table, so they are never broadcast."""
    return held.join(rows.select("row").hint("merge"), "row", "left_semi").drop("row").toDF(*docs.columns)


def raw_text(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column of an Arrow batch; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def crc_mod(column: str, n: int):
    """crc32 of a column's text form, modulo n; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows of ``df``: those whose hash of ``keys`` is smallest. A count first thins the rows, so no task sends many to the driver."""
    total = df.count()
    place = F.xxhash64(*keys)
    if total > rows:
        df = df.where(F.pmod(place, F.lit(1_000_003)) <= int(1_000_003 * min(1.0, 1.1 * rows / total + 1e-6)))
    return df.orderBy(place, *keys).limit(rows)
