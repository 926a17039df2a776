"""Counting and locating matches."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlantern.functions import find_all
from rowlantern.functions.search_text import matches, needles, occurrences, quoted
from rowlantern.operators.select import key_columns

cloudpickle.register_pickle_by_value(find_all)


def row_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"))


def hits_by(records: DataFrame, query: str, by: list[str], case_sensitive: bool = False, column: str = "text") -> DataFrame:
    """Hits per group; counts are combined in each task before the shuffle."""
    hit = records.where(matches(F.col(column), query, case_sensitive))
    return hit.groupBy(*by).agg(F.count("*").alias("hits"))


def occurrence_counts(records: DataFrame, query: str, case_sensitive: bool = False, column: str = "text") -> DataFrame:
    return records.select(
        *key_columns(records), occurrences(F.col(column), query, case_sensitive).alias("occurrences"))


def occurrence_total(records: DataFrame, query: str, case_sensitive: bool = False, column: str = "text") -> DataFrame:
    return records.agg(F.sum(occurrences(F.col(column), query, case_sensitive)).alias("occurrences"))


_positions = F.pandas_udf(find_all.all_positions, T.ArrayType(T.LongType()))


def match_spans(records: DataFrame, query: str, case_sensitive: bool = False, column: str = "text") -> DataFrame:
    """One row per match: span_no from 1, start_pos and length in characters.

    A text without the needle is tried with the JSON-quoted needle.  Positions
    come from one linear walk per matching text; the built-in alternative
    (split, then summing the parts before each match) is quadratic in matches.
    """
    (needle,) = needles(query, key_value=False)

    def fold(c: Column) -> Column:
        return c if case_sensitive else F.lower(c)

    hay = fold(F.col(column))
    plain, inquotes = fold(F.lit(needle)), fold(F.lit(quoted(needle)))
    used = F.when(F.contains(hay, plain), plain).when(F.contains(hay, inquotes), inquotes)
    found = records.select(*key_columns(records), hay.alias("_hay"), used.alias("_needle")).where("_needle is not null")
    spans = found.select(
        *key_columns(records), F.length("_needle").cast("long").alias("length"),
        F.posexplode(_positions("_hay", "_needle")).alias("n", "start_pos"))
    return spans.select(*key_columns(records), (F.col("n") + 1).cast("long").alias("span_no"), "start_pos", "length")
