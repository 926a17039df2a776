"""Looking at records: bounded view, full lookup, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlantern.functions import json_text
from rowlantern.functions.render import PREVIEW_CHARS, RAW_CHARS, cut, is_cut
from rowlantern.operators.select import key_columns, select_by_ids



def record_view(records: DataFrame, preview_chars: int = PREVIEW_CHARS, raw_chars: int = RAW_CHARS) -> DataFrame:
    """Preview and detail text, each cut to a number of characters and flagged."""
    return records.select(
        *[c for c in records.columns if c not in ("text", "raw")],
        cut(F.col("text"), preview_chars).alias("preview"),
        is_cut(F.col("text"), preview_chars).alias("preview_truncated"),
        cut(F.col("raw"), raw_chars).alias("raw"),
        is_cut(F.col("raw"), raw_chars).alias("raw_truncated"),
    )


def get_records(records: DataFrame, ids, max_bytes: int | None = None) -> DataFrame:
    """Full text of the asked-for records; with ``max_bytes`` a larger one comes with an error instead."""
    size = F.octet_length("raw").cast("long")
    fits = F.lit(True) if max_bytes is None else size <= max_bytes
    message = F.concat(F.lit("record too large: "), size.cast("string"), F.lit(f" bytes (max {max_bytes})"))
    return select_by_ids(records, ids).select(
        *key_columns(records), F.when(fits, F.col("raw")).alias("raw"), size.alias("bytes"),
        F.when(~fits, message).alias("error"))


def json_validity(records: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``json_ok``: is the record exactly one JSON value?"""
    return json_text.with_json_ok(records, column, "json_ok")
