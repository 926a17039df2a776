"""How rows and values are shown: one text form, one JSON form, bounded views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# View limits and the cut mark.
PREVIEW_CHARS = 300
RAW_CHARS = 40_000
CUT_MARK = "…"

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, with a mark when something was left out."""
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    head = F.left(text, F.lit(limit))
    return F.when(F.length(text) > limit, F.concat(head, F.lit(CUT_MARK))).otherwise(text)


def is_cut(text: Column, limit: int) -> Column:
    return F.length(text) > limit


def cell_text(name: str, dtype: T.DataType) -> Column:
    """One cell as text on one line; NULL shows as ``null``."""
    cell = F.col(f"`{name}`")
    if isinstance(dtype, T.BinaryType):
        shown = F.concat(F.lit("blob(base64:"), F.base64(cell), F.lit(")"))
    elif isinstance(dtype, _NESTED):
        shown = F.to_json(cell, {"ignoreNullFields": "false"})
    else:
        shown = cell.cast("string")
    if not isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        shown = F.translate(shown, "\n\r\t", "   ")
    return F.coalesce(shown, F.lit("null"))


def row_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A whole row as one tab-joined line; this is what a search looks at."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("\t", *[cell_text(c, types[c]) for c in (columns or df.columns)])


def row_object(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A whole row as a JSON object keyed by column, NULLs kept."""
    cells = [F.col(f"`{c}`") for c in (columns or df.columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
