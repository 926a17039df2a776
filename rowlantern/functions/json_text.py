"""Expressions over JSON text that keep document order, repeated keys and every character of a value."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlantern.functions import json_split, strict_json
from rowlantern.functions.render import CUT_MARK, cut

cloudpickle.register_pickle_by_value(json_split)
cloudpickle.register_pickle_by_value(strict_json)

PathSegment = str | int
# How a container is announced in one line.
PREVIEW_KEYS = 6
PREVIEW_STRING = 160


# Kind of a JSON value by its first character.
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null",
          "-": "number", **{str(d): "number" for d in range(10)}}


def kind_of_text(text: Column) -> Column:
    """Kind of a JSON value from its first character."""
    return _kind_of_first(F.substring(F.ltrim(text, F.lit(" \t\r\n\x00")), 1, 1))


def _kind_of_first(c: Column) -> Column:
    # A lookup evaluates its argument once; a chain of conditions would repeat it.
    table = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), F.lit("unknown")))


def text_at(raw: Column, path: Sequence[PathSegment]) -> Column:
    """JSON text of the value at ``path``, as it stands in the record; NULL when the path does not lead anywhere."""
    return raw if not path else located(raw, path)["value"]


def located(raw: Column, path: Sequence[PathSegment]) -> Column:
    """STRUCT<value, error>: the value at ``path`` verbatim, or why the way to it cannot be read."""
    steps = list(path)

    def find(texts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if t is None else json_split.value_at(t, steps) for t in texts]
        return pd.DataFrame(found, columns=["value", "error"], dtype=object)

    # Kept where it stands: the optimiser must not write it into a lambda, where Python cannot be called.
    return F.pandas_udf(find, "value string, error string").asNondeterministic()(raw)


def path_label(path: Sequence[PathSegment]) -> str:
    return json_split.path_text(path)


def value_preview(text: Column, kind: Column) -> Column:
    """``[Array(n)]``, ``{Object(n): k1, k2}``, or the (cut) scalar."""
    keys = F.json_object_keys(text)
    n = F.size(keys)
    listed = F.array_join(F.slice(keys, 1, PREVIEW_KEYS), ", ")
    more = F.when(n > PREVIEW_KEYS, F.lit(f", {CUT_MARK}")).otherwise(F.lit(""))
    shown = F.when(n > 0, F.concat(F.lit(": "), listed, more)).otherwise(F.lit(""))
    return (
        F.when(kind == "array", F.concat(F.lit("[Array("), F.json_array_length(text).cast("string"), F.lit(")]")))
        .when(kind == "object", F.concat(F.lit("{Object("), n.cast("string"), F.lit(")"), shown, F.lit("}")))
        .when(kind == "string", cut(text, PREVIEW_STRING))
        .otherwise(text)
    )


_strictly_json = F.pandas_udf(strict_json.all_json, T.BooleanType())


def with_json_ok(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a flag: is the text exactly one JSON value?

    The built-in parsers stop after the first value, so the text is put in an
    array, followed by a token no value can hold (its own digest): only a text
    that is one complete value leaves that token in second place.  The VARIANT
    parser is strict but also refuses repeated keys, deep and very long values;
    what it refuses and a lenient parser reads, or what looks like a container,
    gets a second opinion.
    """
    raw = F.col(column)
    framed = F.concat(F.lit("["), raw, F.lit(',"'), F.md5(raw), F.lit('"]'))
    strict = F.try_variant_get(F.try_parse_json(framed), "$[1]", "string") == F.md5(raw)
    # Containers may be nested deeper, and texts be longer, than either parser reads.
    beyond = kind_of_text(raw).isin("object", "array") | (F.octet_length(raw) > 10_000_000)
    lenient = F.coalesce(F.json_array_length(framed) == 2, F.lit(False)) | beyond
    flagged = df.withColumn("_strict", F.coalesce(strict, F.lit(False)))
    flagged = flagged.withColumn("_doubt", ~F.col("_strict") & F.coalesce(lenient, F.lit(False)))
    opinion = _strictly_json(F.when(F.col("_doubt"), raw))
    verdict = F.col("_strict") | (F.col("_doubt") & F.coalesce(opinion, F.lit(False)))
    return flagged.withColumn(name, verdict).drop("_strict", "_doubt")
