"""Capped search that stops reading: files are opened in order, in growing groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlantern.functions.render import PREVIEW_CHARS, cut
from rowlantern.functions.search_text import needles
from rowlantern.operators.search import MAX_HITS, TOP_K, first_in_order, search
from rowlantern.session import materialise
from rowlantern.sources.files import list_files, literal_paths
from rowlantern.sources.open import format_of, open_dataset

# Bytes of the first group; each later group ends where twice as much has been read.
FIRST_BYTES = 1 << 30
KEYS = ["file", "record_id"]


def file_groups(spark: SparkSession, paths, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """(file, length, step): files in order of their name, dealt to steps of doubling size.

    A file belongs to the step in which its first byte lies, so a step exceeds its
    size by one file at most.  The window has one row per file.
    """
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    listed = list_files(spark, paths).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    rounds = F.floor(F.log2(F.col("start") / F.lit(float(first_bytes)))).cast("int") + 1
    return listed.select("file", "length", F.when(F.col("start") < first_bytes, 0).otherwise(rounds).alias("step"))


def first_hits(spark: SparkSession, paths, query: str, max_hits: int = MAX_HITS, case_sensitive: bool = False,
               fmt: str | None = None, first_bytes: int = FIRST_BYTES, preview_chars: int = PREVIEW_CHARS,
               **options) -> DataFrame:
    """The rows of ``search_hits`` over ``open_dataset``, reading no group of files after the cap is passed.

    Record ids are numbers within a file, so a group of files is a dataset of its
    own.  A group's hits are written before the next group is opened; at most the
    names of one group are in the driver, where the reader needs them.  A frequent
    word is found in the first group; one that never occurs costs a whole scan.
    """
    if max_hits < 0:
        raise ValueError("max_hits must not be negative")
    needles(query)
    fmt = fmt or format_of(paths if isinstance(paths, str) else paths[0])
    groups = materialise(file_groups(spark, paths, first_bytes))
    found, known = None, 0
    for step in sorted(r.step for r in groups.select("step").distinct().collect()):
        names = [r.file for r in groups.where(F.col("step") == step).select("file").collect()]
        records = open_dataset(spark, literal_paths(names), fmt, **options)
        place = [c for c in ("byte_offset", "byte_len") if c in records.columns]
        hits = search(records, query, case_sensitive).select(
            *KEYS, *place, cut(F.col("text"), preview_chars).alias("preview"))
        missing = max_hits + 1 - known
        if missing <= TOP_K:
            hits = hits.orderBy(*KEYS).limit(missing)
        hits = materialise(hits)
        found = hits if found is None else found.unionByName(hits)
        known += hits.count()
        if known > max_hits:
            break
    if found is None:
        raise ValueError(f"no files: {paths}")
    return first_in_order(found, KEYS, max_hits)
