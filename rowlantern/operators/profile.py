"""What is in a dataset: filters by column, missing values, frequent values, structure."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlantern.operators.jsontree import nodes


def column_filter(rows: DataFrame, condition: Column | str, columns: list[str] | None = None) -> DataFrame:
    """Rows that meet a condition on columns; condition and column choice reach the Parquet scan."""
    found = rows.where(condition)
    return found if columns is None else found.select(*columns)


def missing_rate(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, n_missing, missing_rate) of every column, from one pass with partial counts; NULL counts as missing.

    The rate is rounded to six places and NULL for a dataset without rows.
    """
    columns = columns or rows.columns
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("col"), (F.col("n") - F.col(f"c{i}")).alias("n_missing"), F.col("n"))
                      for i, c in enumerate(columns)])
    return counts.select(F.inline(parts)).select(
        "col", "n_missing", F.when(F.col("n") > 0, F.round(F.col("n_missing") / F.greatest("n", F.lit(1)), 6)).alias(
            "missing_rate"))


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(value, n): the ``k`` most frequent values, ties in order of the value; NULL is a value, and last."""
    counts = rows.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def approx_top_values(rows: DataFrame, column: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """(value, n): frequent values from a mergeable sketch of ``tracked`` counters, whatever the number of values.

    One sketch per task, merged: nothing is shuffled by value, where ``top_values``
    shuffles a row per value.  Counts are exact while no more than ``tracked`` values
    occur; beyond that n is never too small, and too large by at most
    3.5 * rows / tracked.  NULL is a value, its count always exact; ties as in ``top_values``.
    """
    if not 0 < k <= tracked:
        raise ValueError("k must be positive and not above the number of counters")
    name = column.replace("`", "``")
    # NULL rides beside the sketch: its count is always exact.
    seen = rows.agg(F.expr(f"approx_top_k(`{name}`, {tracked}, {tracked})").alias("top"),
                    F.count_if(F.col(f"`{name}`").isNull()).alias("nulls"))
    # All counters, one bounded list, so that ties at the end are met by the order below.
    top = seen.select(F.inline("top")).where("item is not null").select(F.col("item").alias("value"), F.col("count").alias("n"))
    kind = top.schema["value"].dataType
    nulls = seen.where("nulls > 0").select(F.lit(None).cast(kind).alias("value"), F.col("nulls").alias("n"))
    return top.unionByName(nulls).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def json_schema(records: DataFrame, column: str = "raw") -> DataFrame:
    """(path, kind, n): how often a kind of value stands at a path, with ``[*]`` for any index.

    Unreadable records are counted with the path ``NULL`` and the kind ``unknown``.
    """
    found = nodes(records, column=column, preview_chars=0)
    path = F.when(F.col("error").isNull(), F.regexp_replace("path", r"\[[0-9]+\]", "[*]"))
    return found.groupBy(path.alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"))


def merged_schema(records: DataFrame, column: str = "raw") -> str:
    """One type for all JSON texts of a column, as ``from_json`` and ``read_typed`` take it.

    Types are merged in each task and then once more, so one string reaches the
    driver whatever the number of records.  Values of different kinds at one
    place become VARIANT, a place that only holds null STRING.  Texts that are
    not JSON, or repeat a key, are left out; a column without any other text, or
    whose texts are all scalars, has no such type: ValueError.
    """
    found = records.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("type")).first()["type"]

    def named(match):
        return {"OBJECT<": "STRUCT<", "VOID": "STRING"}.get(match.group(), match.group())

    ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b(?!:)", named, found)
    if not ddl.startswith(("STRUCT<", "ARRAY<")):
        raise ValueError(f"no object or array in common: {found}")
    return ddl


def read_typed(records: DataFrame, schema: str | None = None, column: str = "raw", name: str = "value") -> DataFrame:
    """``records`` with the JSON text parsed by ``schema``, else by the merged schema of all of them.

    A text that does not fit is NULL, or has NULL at the place that does not fit.
    """
    return records.withColumn(name, F.from_json(F.col(column), schema or merged_schema(records, column)))
