"""JSON files: a root array, one value, or several values after each other."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.sources import kernels
from rowlantern.sources.splits import (
    assemble, carried_splits, overview, scan_pieces, straddling_records)

# Where text is cut before the structure is known.  A comma separates elements in
# any root array, also in one without line breaks; where elements stand on lines
# of their own, line breaks make far fewer pieces.
_CUTS = {"commas": ",", "lines": "\n"}
_TRIM = " \t\r\n\x00,"


def read_json(spark: SparkSession, paths, shape: str = "auto", layout: str = "commas") -> DataFrame:
    """Records of JSON files: elements of a root array, else every top-level value.

    ``shape`` may be ``"array"`` or ``"values"`` when the caller knows it, which
    saves looking at the first character of each file.  ``layout="lines"`` reads
    arrays with line breaks between or inside elements faster; it is right for
    any JSON, but a file without line breaks would be one piece.
    """
    if shape == "values":
        return _records(spark, paths, _CUTS["lines"], False)
    if shape not in ("auto", "array"):
        raise ValueError(f"shape: {shape}")
    sep = _CUTS[layout]
    pieces, splits, seen = _first_pass(spark, paths, sep, True)
    if shape == "array" or not seen.others:
        return _second_pass(pieces, splits, seen, sep, True)
    heads = splits.where("block_start = 0")
    values = read_json(spark, _paths(heads.where(F.col("head").isNull() | (F.col("head") != F.lit(b"[")))), "values")
    if not seen.arrays:
        return values
    return values.unionByName(_records(spark, _paths(heads.where(F.col("head") == F.lit(b"["))), sep, True))


def _paths(heads: DataFrame) -> list[str]:
    """One row per file of a mixed folder; Spark's own file index on the driver holds the same list."""
    return [as_path(r.file) for r in heads.select("file").toLocalIterator()]


def _first_pass(spark, paths, sep, array_file):
    pieces = scan_pieces(spark, paths, sep)
    splits = carried_splits(
        pieces, kernels.summarise_json(sep.encode()), F.col("value").cast("binary"), level=int(array_file))
    return pieces, splits, overview(splits)


def _records(spark, paths, sep, array_file):
    return _second_pass(*_first_pass(spark, paths, sep, array_file), sep, array_file)


def _second_pass(pieces, splits, seen, sep, array_file):
    whole = assemble(pieces, splits, seen.n_splits, kernels.assemble_json(sep.encode(), array_file))
    if not seen.cut:
        return whole
    text = F.trim(F.make_valid_utf8(F.col("body").cast("string")), F.lit(_TRIM))
    cut = straddling_records(pieces, splits, seen.n_splits, sep).select(
        "file", "record_id", "byte_offset",
        F.octet_length(F.trim(F.col("body").cast("string"), F.lit(_TRIM))).cast("long").alias("byte_len"),
        text.alias("text"), text.alias("raw"))
    return whole.unionByName(cut)


def as_path(uri: str) -> str:
    """A listed file as a path to load: undo URI escapes, protect glob characters."""
    return escape_globs(unquote(uri))


def escape_globs(path: str) -> str:
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)
