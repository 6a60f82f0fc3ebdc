"""The corpus pipeline: five stages over documents, each written and read again.

documents -> toxicity (rejected ones go) -> near-dedup (one of each group
stays) -> decontamination (holders of benchmark items go) -> mixing (documents
the mix doesn't take go; the copies it takes are rows) -> sharding (columns of
documents, and the shard).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontam, mixing, near_dedup, sharding, toxicity
from fleetlens.llm.storage import checkpoint_dir

TOXIC_AT = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model learns from the documents table and its labels.

    Null and empty texts have no toxic term and stay; repeated rows are scored
    one by one; no documents give none.
    """
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each class; of repeated rows one stays.

    Null and empty texts are one class; rows with a null id come last.
    """
    return near_dedup.drop_near_duplicates(docs, most_idf=math.inf)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts hold none; ids may be null or repeated."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document.

    Null, empty and blank texts have no words, count for nothing in a mix of
    words and are kept as they are. Null is a source of its own.
    """
    return mixing.emit_copies(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard; null texts have 0 bytes. See assign_shards for columns with clashing names."""
    return sharding.assign_shards(docs, keep=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The toxicity model and the signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
