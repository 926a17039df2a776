"""Pages of records: by key, by row number, by hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlantern.operators.search import first_in_order
from rowlantern.operators.select import key_columns

# Page sizes when the caller names none.
PAGE_SIZE = 10
HITS_PAGE_SIZE = 50


def next_page(records: DataFrame, record_id: int = 0, size: int = PAGE_SIZE, file: str | None = None,
              dense: bool = False) -> DataFrame:
    """``size`` records from ``record_id`` on, with ``next_id`` (NULL at the end) and ``eof``.

    The bound is a filter on the key, so a deep page costs what the first one
    does.  With several files the cursor is the pair of ``file`` and ``record_id``;
    without a file the page starts in the smallest one.  It runs on into the
    next file and ``next_file`` says where.

    ``dense`` promises that no record was filtered out, so ids have no gaps.
    Then only ``size + 1`` ids per file can be on the page, and the rest is
    dropped before its text is rendered.
    """
    keys = key_columns(records)
    last_id = record_id + size if dense else (1 << 63) - 1
    start = F.col("record_id").between(record_id, last_id)
    if file is None and record_id and "file" in keys:
        file = records.agg(F.min("file")).first()[0]
    if file is not None:
        later = F.col("file") > file
        if dense:
            later = later & (F.col("record_id") <= size)
        start = later | ((F.col("file") == file) & start)
    top = records.where(start).orderBy(*keys).limit(size + 1)
    w, all_rows = W.orderBy(*keys), W.partitionBy()
    n = F.row_number().over(w)
    page = top.withColumn("_n", n)
    last = F.max(F.when(F.col("_n") == size + 1, F.struct(*keys))).over(all_rows)
    page = page.withColumn("_next", last).where(F.col("_n") <= size)
    extra = [F.col("_next.file").alias("next_file")] if "file" in keys else []
    return page.select(*records.columns, F.col("_next.record_id").alias("next_id"), *extra,
                       F.col("_next").isNull().alias("eof"))


def page_at(records: DataFrame, offset: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows ``offset .. offset + size - 1`` of each file, by row number, without sorting or skipping."""
    return records.where(F.col("record_id").between(offset, offset + size - 1))


def hits_page(hits: DataFrame, index: int = 0, size: int = HITS_PAGE_SIZE) -> DataFrame:
    """Hits number ``index`` to ``index + size - 1``, with the index of the next page."""
    keys = key_columns(hits)
    page = first_in_order(hits.drop("hit_no", "truncated"), keys, index + size)
    page = page.where(F.col("hit_no") >= index)
    following = F.when(F.col("truncated"), F.lit(index + size).cast("long"))
    return page.withColumn("next_index", following).withColumn("eof", ~F.col("truncated")).drop("truncated")


def hits_after(hits: DataFrame, record_id: int, size: int = HITS_PAGE_SIZE, file: str | None = None) -> DataFrame:
    """The page of hits behind a known one; unlike an index it reads no earlier hits.

    With several files the known hit is named by its file, too; else it is one of the smallest file.
    """
    return next_page(hits, record_id + 1, size, file)
