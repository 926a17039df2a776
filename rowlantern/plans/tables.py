"""The given tables as record datasets, and copies of them in the other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.session import scratch_path
from rowlantern.sinks import export_records
from rowlantern.sources.parquet_files import KEYS, read_parquet_rows

Q = '"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet_rows(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; the text is what is searched and what is shown."""
    return table(spark, sf_dir, "documents").withColumn("raw", F.col("text"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*KEYS, F.col("props").alias("text"), F.col("props").alias("raw"))


def document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one nested JSON record; ``lines`` holds the whole text."""
    tree = F.to_json(F.struct(
        "doc_id", "lang", F.struct("source", "n_chars").alias("meta"), F.split("text", "\n").alias("lines")))
    return table(spark, sf_dir, "documents").select(*KEYS, tree.alias("raw")).withColumn("text", F.col("raw"))


def row_in_part() -> Column:
    """Position of a row in the part file its task writes."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))


def documents_as(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """All documents written as jsonl or as JSON arrays; ``row`` is the place in the file."""
    docs = table(spark, sf_dir, "documents").withColumn("row", row_in_part())
    obj = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text", "row"))
    out = scratch_path(spark, f"documents-{fmt}")
    export_records(docs.select(*KEYS, obj.alias("raw")), "parquet", fmt, out, ordered=False)
    return out


def documents_in_order(spark: SparkSession, sf_dir: str) -> str:
    """All documents written as jsonl, so that the parts in order of their names hold them in order."""
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "documents-in-order")
    export_records(docs.select(*KEYS, F.to_json(F.struct("doc_id", "text")).alias("raw")), "parquet", "jsonl", out)
    return out


def table_as_csv(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> str:
    rows = table(spark, sf_dir, name).withColumn("row", row_in_part()).select(*columns, "row")
    out = scratch_path(spark, f"{name}-csv")
    rows.write.csv(out, header=True, quoteAll=True, escape=Q, ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)
    return out


def field(name: str, column: str = "raw") -> Column:
    return F.get_json_object(column, f"$.{name}").alias(name)
