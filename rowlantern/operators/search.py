"""Full-scan search, capped or not, and search inside a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlantern.functions.render import PREVIEW_CHARS, cut
from rowlantern.functions.search_text import matches, needles
from rowlantern.operators.select import key_columns
from rowlantern.session import materialise

# Fixed value: hits kept by a capped search.
MAX_HITS = 10_000
# Up to here a cap is met by a top-k whose rows (key and preview, about 1 KB) end in one task;
# larger ones number all hits, range by range.
TOP_K = 100_000


def search(records: DataFrame, query: str, case_sensitive: bool = False, column: str = "text") -> DataFrame:
    """All matching records: a filter inside the scan stage, no shuffle, no sort."""
    return records.where(matches(F.col(column), query, case_sensitive))


def search_hits(records: DataFrame, query: str, case_sensitive: bool = False,
                max_hits: int = MAX_HITS, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """The first ``max_hits`` matches in record order, and whether there were more.

    Only keys and previews are sorted: one bounded heap per task up to
    ``TOP_K``, beyond it ranges of hits with a count for each.
    """
    if max_hits < 0:
        raise ValueError("max_hits must not be negative")
    keys = key_columns(records)
    place = [c for c in ("byte_offset", "byte_len") if c in records.columns]
    hits = search(records, query, case_sensitive).select(
        *keys, *place, cut(F.col("text"), preview_chars).alias("preview"))
    return first_in_order(hits, keys, max_hits)


def first_in_order(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First ``n`` rows by ``keys`` with ``hit_no`` and ``truncated``.

    One row more than asked is taken, so "there is more" needs no second scan;
    the window below sees those n + 1 rows only.
    """
    if n > TOP_K:
        rows = numbered(df, keys, "hit_no")
        total = rows.groupBy().agg(F.count("*").alias("hits"))
        return rows.where(F.col("hit_no") < n).join(F.broadcast(total)).withColumn(
            "truncated", F.col("hits") > n).drop("hits")
    top = df.orderBy(*keys).limit(n + 1)
    w = W.orderBy(*keys)
    return (
        top.withColumn("hit_no", F.row_number().over(w).cast("long") - 1)
        .withColumn("truncated", F.count("*").over(W.partitionBy()) > n)
        .where(F.col("hit_no") < n)
    )


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``keys``: within ranges, from a running sum of the ranges' counts.

    The ranged rows are kept in the shared folder, so both passes see the same ranges.
    """
    ranged = materialise(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = ranged.groupBy("_part").agg(F.count("*").alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*keys)).cast("long") - 1
    return ranged.withColumn("_in", within).join(first, "_part").withColumn(
        name, F.col("_first") + F.col("_in")).drop("_part", "_in", "_first")


def search_page(page: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Matches within one page, over preview and detail text; blank text finds nothing."""
    if not query.strip():
        return page.where(F.lit(False))
    needles(query)
    shown = "preview" if "preview" in page.columns else "text"
    hay = F.concat_ws("\n", F.col(shown), F.col("raw"))
    return page.where(matches(hay, query, case_sensitive))
