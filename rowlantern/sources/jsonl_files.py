"""JSONL: one record per line, numbered and located without moving the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.session import materialise
from rowlantern.sources import kernels
from rowlantern.sources.splits import SPLIT_KEY, attach_splits, piece_bytes, place_lines, scan_pieces


def read_jsonl(spark: SparkSession, paths, locations: bool = True) -> DataFrame:
    """Records of line files: file, record_id, byte_offset, byte_len, text, raw.

    Blank lines count.  Trailing CR/LF is dropped and invalid UTF-8 becomes
    U+FFFD.  With ``locations=False`` the byte columns are left out and every
    step stays inside the JVM.
    """
    lines = scan_pieces(spark, paths, "\n")
    per_split = lines.groupBy(*SPLIT_KEY, "file_size").agg(
        F.count("*").alias("n_pieces"),
        F.sum(piece_bytes()).alias("n_bytes"),
        F.min("seq").alias("first_seq"),
    )
    splits = materialise(place_lines(per_split))
    facts = ["base_id", "base_off", "bom"]
    text = F.rtrim(F.make_valid_utf8("value"), F.lit("\r\n")).alias("text")
    record_id = (F.col("base_id") + F.col("piece")).alias("record_id")
    numbered = attach_splits(lines, splits, splits.count(), facts)
    if not locations:
        out = numbered.select("file", record_id, text)
        return out.withColumn("raw", F.col("text"))

    opens = (F.col("piece") == 0).alias("opens_split")
    wide = numbered.select("file", record_id, text, "base_off", "bom", "file_size", opens,
                           piece_bytes().alias("line_bytes"))
    ddl = ("file string, record_id long, text string, base_off long, bom int, file_size long, "
           "opens_split boolean, line_bytes long, rel_off long")
    placed = wide.mapInArrow(kernels.add_byte_position, ddl)
    marked = (F.col("record_id") == 0) & (F.col("bom") > 0)
    at = F.when(marked, 0).otherwise(F.col("base_off") + F.col("rel_off"))
    size = F.col("line_bytes") + F.when(marked, F.col("bom")).otherwise(0)
    return placed.select(
        "file", "record_id", at.alias("byte_offset"),
        F.least(size, F.col("file_size") - at).alias("byte_len"), "text", F.col("text").alias("raw"))
