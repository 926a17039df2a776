"""Intermediate tables, written once to the folder that all executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.session import scratch_path


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package; elsewhere it is installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage; a lost executor costs no more than a read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(kernel):
    """A kernel for mapInArrow that gives free memory back when a task ends: its worker waits for the next with little."""
    def run(batches: Iterator[pa.RecordBatch]):
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()  # what numpy and others took from the C library

    return run


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_numbered(df: DataFrame, keys: list, label: str, part: str = "part") -> DataFrame:
    """Rows dealt by ranges of ``keys``, each with the number of its range, stored."""
    n = partitions_of(df)
    return store(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), label)
