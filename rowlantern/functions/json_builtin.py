"""The direct children of JSON texts by built-in functions, each value as it stands in the text.

``from_json`` reads the values of an object or array as strings.  It may change
them (numbers are written anew, strings lose their quotes and escapes) and it
accepts what is not JSON.  So the text is put together again from the parts:
where that gives the very same text, every part is a slice of it and the text is
JSON; where it does not, the built-ins do not vouch for the record, and it is for
``json_split`` to read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_SCALAR = r'^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|"[^"\\\x00-\x1f]*")$'
PARTS = "array<struct<seg:string,text:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def _quoted(value: Column, plain: Column) -> Column:
    """A string as JSON; in a ``plain`` text, which has no escapes, between its quotes."""
    text = F.to_json(F.array(value))
    return F.when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.substr(text, F.lit(2), F.length(text) - 2))


def _as_written(value: Column, plain: Column) -> Column:
    """A value as it probably stands in the text; what is guessed wrong does not fit in."""
    first, last = F.left(value, F.lit(1)), F.right(value, F.lit(1))
    bare = (F.when(first == "{", last == "}").when(first == "[", last == "]")
            .when((first == "t") | (first == "f"), value.isin("true", "false"))
            .when((first == "-") | first.between("0", "9"), value.rlike(_NUMBER)))
    return F.when(value.isNull(), F.lit("null")).when(bare, value).otherwise(_quoted(value, plain))


def _fitting(text: Column, items: Column, written: Column, marks: str) -> Column:
    again = F.concat(F.lit(marks[0]), F.array_join(written, ","), F.lit(marks[1]))
    return F.when(again == text, items)


def _of_object(text: Column, plain: Column) -> Column:
    def parts(found: Column) -> Column:
        items = F.zip_with(F.map_keys(found), F.map_values(found),
                           lambda k, v: F.struct(k.alias("seg"), _as_written(v, plain).alias("text")))
        return bound(items, lambda held: _fitting(
            text, held, F.transform(held, lambda x: F.concat(_quoted(x["seg"], plain), F.lit(":"), x["text"])), "{}"))

    return bound(F.from_json(text, "map<string,string>"), parts)


def _of_array(text: Column, plain: Column) -> Column:
    def parts(found: Column) -> Column:
        items = F.transform(found, lambda v, i: F.struct(i.cast("string").alias("seg"), _as_written(v, plain).alias("text")))
        return bound(items, lambda held: _fitting(text, held, held["text"], "[]"))

    return bound(F.from_json(text, "array<string>"), parts)


def parts_of(text: Column) -> Column:
    """ARRAY<STRUCT<seg, text>> of the direct children in order, none for a scalar; NULL where nothing vouches for it."""
    first, plain = F.substring(text, 1, 1), ~F.contains(text, F.lit("\\"))
    return (F.when(first == "{", bound(plain, lambda p: _of_object(text, p)))
            .when(first == "[", bound(plain, lambda p: _of_array(text, p))).when(text.rlike(_SCALAR), F.array().cast(PARTS)))
