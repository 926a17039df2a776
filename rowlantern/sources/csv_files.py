"""CSV: records may span lines, and lines may be far apart from the quote that decides them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.functions.render import row_line, row_object
from rowlantern.session import materialise, pin_split_layout
from rowlantern.sources import kernels
from rowlantern.sources.splits import (
    SPLIT_KEY, assemble, attach_splits, carried_splits, overview, scan_pieces, straddling_records)


def read_csv(spark: SparkSession, paths) -> DataFrame:
    """Records of CSV files; record 0 is the header, later ones get a JSON object as ``raw``.

    ``text`` is the record as written.  Missing fields become ``""``, surplus
    ones go to ``__extra__``, blank header cells are named ``col_i``.
    """
    lines = scan_pieces(spark, paths, "\n")
    # The first pass needs text only where a quote occurs, or where the header may be.
    wanted = F.when(F.col("value").contains('"') | (F.col("block_start") == 0), F.col("value").cast("binary"))
    splits = carried_splits(lines, kernels.summarise_csv, wanted, level=0, lengths=True)
    seen = overview(splits)
    if seen.headless:
        _check_headers(splits)
    whole = assemble(lines, splits, seen.n_splits, kernels.assemble_csv)
    if not seen.cut:
        return whole
    heads = splits.where("block_start = 0").select("file", "head", "bom", "file_size")
    pieces = straddling_records(lines, splits, seen.n_splits, "\n").join(heads, "file", "left")
    marked = (F.col("record_id") == 0) & (F.col("bom") > 0)
    at = F.when(marked, 0).otherwise(F.col("byte_offset"))
    located = pieces.select(
        "file", "record_id", at.alias("byte_offset"),
        (F.col("byte_len") + F.when(marked, F.col("bom")).otherwise(0)).alias("byte_len"), "body", "head")
    return whole.unionByName(located.mapInArrow(kernels.objects_from_lines, kernels.RECORDS_DDL))


def read_standard_csv(spark: SparkSession, paths) -> DataFrame:
    """Data records of files that the caller knows to follow RFC 4180, by Spark's own reader alone.

    file, record_id, text, raw as ``read_csv`` numbers them (the header is record
    0 and left out); ``text`` is the fields, tab-joined.  Every file has the same
    header with distinct names.  A row with more or fewer fields ends the query;
    blank lines are no records.  In a file whose lines end with CR LF, that pair
    inside a field is read as LF.  A file is one task, so large files are better
    left to ``read_csv``.
    """
    pin_split_layout(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    # Without pruning every row is measured against the header, whichever columns are asked for.
    read = spark.read.option("columnPruning", "false").csv(
        paths, header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=False)
    names = read.columns
    rows = read.select(F.struct("_metadata.*").alias("_of"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    pieces = rows.select(
        F.col("_of.file_path").alias("file"), F.col("_of.file_block_start").alias("block_start"),
        F.col("_of.file_block_length").alias("block_length"), F.monotonically_increasing_id().alias("seq"),
        row_line(rows, names).alias("text"), row_object(rows, names).alias("raw"))
    splits = materialise(pieces.groupBy(*SPLIT_KEY).agg(F.count("*").alias("n_pieces"), F.min("seq").alias("first_seq")))
    numbered = attach_splits(pieces, splits, splits.count(), [])
    return numbered.select("file", (F.col("piece") + 1).alias("record_id"), "text", "raw")


def _check_headers(splits: DataFrame) -> None:
    """A header record that leaves its first split has no names to give the data rows."""
    bad = splits.groupBy("file").agg(
        F.max((F.col("block_start") == 0) & F.col("head").isNull()).alias("open_head"),
        F.sum("n_starts").alias("records"),
    ).where("open_head and records > 1").select("file").take(1)
    if bad:
        raise ValueError(f"the header record of {bad[0].file} is larger than one file split; "
                         "raise spark.sql.files.maxPartitionBytes")
