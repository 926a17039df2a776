"""The files of a dataset: names, sizes and times, without their contents."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, paths) -> DataFrame:
    """(file, length, modified): one row per file with at least a byte that the readers find under ``paths``."""
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
                         F.col("_metadata.file_modification_time").alias("modified"))


def literal_paths(files: list[str]) -> list[str]:
    """Listed names, which are URIs, as reader paths: a bracket or star in a name is no pattern."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(name)) for name in files]
