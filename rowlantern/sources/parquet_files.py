"""Parquet: the row number in its file is the record id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.functions.render import row_line, row_object

KEYS = ["file", "record_id"]


def read_parquet_rows(spark: SparkSession, paths) -> DataFrame:
    """All columns of the files plus ``file`` and ``record_id``.

    Filters and column choices made on the result reach the scan.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = spark.read.parquet(*paths)
    except Exception as err:
        raise ValueError(f"cannot read {', '.join(paths)} as Parquet: {_first_line(err)}") from err
    return df.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("record_id"), "*")


def as_records(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as records: ``text`` for searching, ``raw`` as a JSON object."""
    columns = columns or [c for c in rows.columns if c not in KEYS]
    return rows.select(*KEYS, row_line(rows, columns).alias("text"), row_object(rows, columns).alias("raw"))


def read_parquet(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    return as_records(read_parquet_rows(spark, paths), columns)


def _first_line(err: Exception) -> str:
    return str(err).strip().splitlines()[0] if str(err).strip() else type(err).__name__
