"""One entry for every supported file format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowlantern.sources.csv_files import read_csv
from rowlantern.sources.json_files import read_json
from rowlantern.sources.jsonl_files import read_jsonl
from rowlantern.sources.parquet_files import read_parquet

# Supported formats, by lower-cased extension.
FORMATS = ("jsonl", "csv", "json", "parquet")


def format_of(path: str) -> str:
    """``jsonl``, ``csv``, ``json``, ``parquet`` or ``unknown``, by extension only."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return ext if ext in FORMATS else "unknown"


def open_dataset(spark: SparkSession, path: str | list[str], fmt: str | None = None, **options) -> DataFrame:
    """Records of a file, a folder or a list of files in one format.

    Columns: file, record_id, text (what a search sees), raw (the whole record;
    an object for CSV and Parquet), and for text formats byte_offset, byte_len.
    """
    fmt = fmt or format_of(path if isinstance(path, str) else path[0])
    readers = {"jsonl": read_jsonl, "csv": read_csv, "json": read_json, "parquet": read_parquet}
    if fmt not in readers:
        raise ValueError(f"unsupported format: {path}")
    return readers[fmt](spark, path, **options)
