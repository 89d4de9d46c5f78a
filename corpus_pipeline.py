"""The corpus pipeline: ``documents`` to packed training sequences in five stages.

Each stage is written as Parquet into the shared folder and read again as the next one's ``docs``.
All but the last return the columns of ``documents``:

1. ``quality``: documents that the boosted-tree classifier rejects go (score under 0.5).
2. ``near_dedup``: of each group linked by SimHash, the document of the smallest doc_id stays.
3. ``decontaminate``: documents with a benchmark window go.
4. ``secrets``: every span found is replaced by a mark, and ``n_chars`` is counted anew; no document goes.
5. ``pack``: what is left, as pieces of sequences of at most 2048 ids.

Models are trained on the stage's own input (labels come from ``labels``). Null and empty texts pass like
any other; an empty table gives an empty result; further columns of ``documents`` are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm.common import stored, table
from rookery.llm.decontamination import clean
from rookery.llm.packing import packed
from rookery.llm.quality import high_quality
from rookery.llm.secrets import redact
from rookery.llm.simhash import deduplicate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return high_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

#: Stages 1, 2, 4 and 5 are beyond SQL. Tests hold stage 2 and the ids of stage 5 against brute force over the whole input, stage 3 over a part of it, and check what stages 1 and 4 keep and replace.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
