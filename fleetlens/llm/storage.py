"""Cutting lineage in the folder that the cluster shares, names that clash with nothing, and numbers in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir, cut, ship, stored

__all__ = ["checkpoint_dir", "cut", "free_name", "numbered"]


def free_name(df: DataFrame, base: str) -> str:
    """base with as many underscores as no column of df is called, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with position, 1, 2, 3... in the given order over all of them: a range-partitioned sort, then each task counts from its partition's offset.

    The sorted rows are written, so offsets and rows come from one and the same
    partitioning even where a task is run again. Only a count a partition passes
    the driver.
    """
    spark = rows.sparkSession
    part = F.spark_partition_id()
    where = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            own = pa.array(np.arange(at + 1, at + 1 + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "own_"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", part)
    kept = stored(dealt.mapInArrow(run, f"{fields}, part_ int, own_ bigint"), where)
    sizes = sorted((r.part_, r.n) for r in kept.groupBy("part_").agg(F.max("own_").alias("n")).collect())
    offsets = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).astype(int).tolist()
    start = spark.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets, strict=False)], "part_ int, offset_ bigint")
    return kept.join(F.broadcast(start), "part_").withColumn("position", F.col("own_") + F.col("offset_")).drop("part_", "own_", "offset_")
