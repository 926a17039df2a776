"""Writing records out, and turning one format into another."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowlantern.functions.json_text import PathSegment
from rowlantern.operators.jsontree import select_children, subtree
from rowlantern.operators.select import key_columns, select_by_ids
from rowlantern.sinks import framing

cloudpickle.register_pickle_by_value(framing)

# Which format can be written as which, and from what column.
# A pass-through writes records as they were read; jsonl to csv is one, too.
CONVERSIONS = {
    ("jsonl", "jsonl"): "text", ("jsonl", "csv"): "text", ("jsonl", "json"): "text",
    ("csv", "csv"): "text", ("csv", "jsonl"): "raw", ("csv", "json"): "raw",
    ("json", "jsonl"): "raw", ("json", "json"): "raw",
    ("parquet", "jsonl"): "raw", ("parquet", "json"): "raw",
}


def export_records(records: DataFrame, source_format: str, out_format: str, out_path: str, ids=None,
                   ordered: bool = True, mode: str = "errorifexists") -> DataFrame:
    """Write records (all, or those of ``ids``) and return path, format, records_written.

    Hits of a search are records already, so a search exports without a rescan.
    With ``ordered`` part files follow record order (one range shuffle); without
    it each part keeps its own order and nothing is shuffled.
    """
    column = CONVERSIONS.get((source_format, out_format))
    if column is None:
        raise ValueError(f"unsupported conversion: {source_format} to {out_format}")
    if ids is not None:
        records = select_by_ids(records, ids)
    if source_format == "csv" and out_format != "csv":
        records = records.where(F.col("record_id") > 0)  # the header is no data row
    value = F.col(column)
    if source_format == "json" and out_format == "jsonl":
        # A line break inside a JSON value is only layout; one record stays one line.
        value = F.translate(value, "\r\n", "  ")
    keys = key_columns(records)
    return write_values(records.select(*keys, value.alias("value")), keys, out_format, out_path, ordered, mode)


def export_subtree(records: DataFrame, path: list[PathSegment], out_format: str, out_path: str,
                   children: list[PathSegment] | None = None, include_root: bool = False,
                   ordered: bool = True, mode: str = "errorifexists", column: str = "raw") -> DataFrame:
    """Write the value at ``path`` of every record, or the named children under it.

    A scalar is written itself whatever children are named.  A record without
    that path is an error, as a missing path is for one record.
    """
    if out_format not in ("json", "jsonl"):
        raise ValueError("a subtree can be written as json or jsonl only")
    keys = key_columns(records)
    whole = subtree(records, path, "error", column)
    if include_root or not children:
        out = whole.select(*keys, F.lit(0).cast("long").alias("pos"), "value")
    else:
        # A record without the path fails here, whatever its children.
        leaf = whole.where(~F.col("kind").isin("object", "array")).select(*keys, F.lit(0).cast("long").alias("pos"), "value")
        picked = select_children(records, path, children, column)
        fail = F.raise_error(F.concat(F.lit("cannot read children: "), F.col("error"))).cast("string")
        picked = picked.withColumn("text", F.when(F.col("error").isNotNull(), fail).otherwise(F.col("text")))
        out = picked.select(*keys, "pos", F.col("text").alias("value")).unionByName(leaf)
    return write_values(out, [*keys, "pos"], out_format, out_path, ordered, mode)


def write_values(df: DataFrame, order: list[str], out_format: str, out_path: str, ordered: bool, mode: str) -> DataFrame:
    spark = df.sparkSession
    if ordered:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if out_format in ("json", "jsonl"):
        # A record without a value stays a value: it is counted, so it is written.
        df = df.withColumn("value", F.coalesce("value", F.lit("null")))
    # Counted after the shuffle, in the writing tasks themselves.
    written = Observation()
    lines = df.observe(written, F.count("*").alias("n")).select("value")
    if out_format == "json":
        lines = lines.mapInArrow(framing.json_array, "value string")
    lines.write.mode(mode).option("lineSep", "\n").text(out_path)
    if out_format == "json" and written.get["n"] == 0 and mode in ("errorifexists", "error", "overwrite"):
        # Without rows there may be no part at all; an empty export is still an array.
        spark.range(1, numPartitions=1).select(F.lit("[]")).write.mode("overwrite").text(out_path)
    return spark.createDataFrame([(out_path, out_format, written.get["n"])],
                                 "path string, format string, records_written long")
