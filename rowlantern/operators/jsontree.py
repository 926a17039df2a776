"""JSON inside records, for every record of a dataset at once.

Values are handed out as they stand in the record.  What cannot be read comes
as a row with an ``error``, never as a missing row.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlantern.functions import json_split
from rowlantern.functions.json_builtin import PARTS, parts_of
from rowlantern.functions.json_text import PathSegment, kind_of_text, located, path_label, value_preview
from rowlantern.functions.render import CUT_MARK, PREVIEW_CHARS, cut
from rowlantern.functions.search_text import matches
from rowlantern.operators.select import key_columns

# Fixed value: page of children.
CHILD_PAGE = 50
#: Levels below the root that built-in functions open.
LEVELS = 6
_CHILD = "pos long, seg string, kind string, text string, error string"


cloudpickle.register_pickle_by_value(json_split)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _kind(text: str) -> str:
    return json_split.kind_of(text.lstrip(" \t\r\n\x00"))


def _listed(text: str, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """Children number ``first`` to ``last - 1``; behind what could be read, the error if there is one."""
    try:
        for pos, (seg, a, b) in enumerate(islice(json_split.children(text), last)):
            if pos >= first:
                yield pos, seg, json_split.kind_of(text[a:a + 1]), text[a:b], None
    except ValueError as err:
        yield None, None, "unknown", None, f"not JSON: {err}"


def _named(seg: str):
    return lambda part: part["seg"] == seg


def _reached(records: DataFrame, path: Sequence[PathSegment], column: str) -> DataFrame:
    """Keys, ``_raw``, the text ``_at`` the path and whether the built-ins vouch for the way there, ``_sure``."""
    rows = records.select(*key_columns(records), F.col(column).alias("_raw")).withColumn("_at", F.col("_raw")).withColumn(
        "_sure", F.lit(True))
    for seg in path:
        rows = rows.withColumn("_parts", parts_of(F.col("_at")))
        wanted = "[" if isinstance(seg, int) else "{"
        found = F.filter("_parts", _named(str(seg)))
        rows = rows.withColumn("_sure", F.col("_sure") & (F.col("_at").isNull() | F.col("_parts").isNotNull())).withColumn(
            "_at", F.when(F.substring("_at", 1, 1) == wanted, F.get(found, F.lit(0))["text"])).drop("_parts")
    return rows


def _with_second_opinion(rows: DataFrame, keys: list[str], schema: str,
                         unfold: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """The rows in ``_rows`` where the built-ins are ``_sure``; for other records what ``unfold`` makes of ``_raw``."""
    names = [part.split()[0] for part in schema.split(", ")]
    kind = f"array<struct<{','.join(part.replace(' ', ':') for part in schema.split(', '))}>>"

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(names, row)) for row in unfold(t)] for t in texts], dtype=object)

    rows = rows.select(*keys, F.when(F.col("_sure"), F.col("_rows")).cast(kind).alias("_rows"),
                       F.when(~F.col("_sure"), F.col("_raw")).alias("_doubtful"))
    rows = rows.withColumn("_more", F.pandas_udf(read, kind).asNondeterministic()(F.col("_doubtful")))
    return rows.select(*keys, F.inline(F.coalesce("_rows", "_more")))


def subtree(records: DataFrame, path: Sequence[PathSegment], on_missing: str = "null", column: str = "raw") -> DataFrame:
    """The value at ``path`` of every record, verbatim, with its kind and ``error``.

    ``on_missing``: ``null`` keeps the record with NULL, ``skip`` leaves it out,
    ``error`` fails the query.  A record that is broken on the way to the value
    has an ``error`` and is never left out.  Built-in functions read the records
    that they vouch for; Python sees the others only.
    """
    keys = key_columns(records)
    if path:
        rows = _reached(records, path, column).withColumn(
            "found", located(F.when(~F.col("_sure"), F.col("_raw")), path))
        out = rows.select(*keys, F.when(F.col("_sure"), F.col("_at")).otherwise(F.col("found.value")).alias("value"),
                          F.when(~F.col("_sure"), F.col("found.error")).alias("error"))
    else:
        out = records.select(*keys, F.col(column).alias("value"), F.lit(None).cast("string").alias("error"))
    if on_missing == "error":
        why = F.concat(F.lit(f"no value at {path_label(path) or 'root'}"), F.coalesce(
            F.concat(F.lit(": "), F.col("error")), F.lit("")))
        out = out.withColumn("value", F.coalesce("value", F.raise_error(why).cast("string")))
    elif on_missing == "skip":
        out = out.where(F.col("value").isNotNull() | F.col("error").isNotNull())
    elif on_missing != "null":
        raise ValueError(f"on_missing: {on_missing}")
    return out.select(*keys, "value", F.when(
        F.col("value").isNotNull(), kind_of_text(F.col("value"))).alias("kind"), "error")


def _below(records: DataFrame, path: Sequence[PathSegment], column: str, schema: str, unfold, builtin) -> DataFrame:
    """What ``unfold`` makes of the value at ``path``; a record broken before it gives a row with the error alone.

    ``builtin`` gives the same rows, as an array of structs, from the parts and
    the kind of the value, for the records that the built-ins vouch for: they
    never reach Python.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    steps = list(path)

    def listed(text):
        value, error = json_split.value_at(text, steps)
        if error is not None:
            yield tuple(f"not JSON: {error}" if n == "error" else "unknown" if n == "kind" else None for n in names)
        elif value is not None:
            yield from unfold(value)

    keys = key_columns(records)
    rows = _reached(records, path, column).withColumn("_parts", parts_of(F.col("_at")))
    rows = rows.withColumn("_sure", F.col("_sure") & (F.col("_at").isNull() | F.col("_parts").isNotNull()))
    made = F.when(F.col("_at").isNotNull(), builtin(F.col("_parts"), kind_of_text(F.col("_at")), F.col("_at")))
    return _with_second_opinion(rows.withColumn("_rows", made), keys, schema, listed)


def _rows_of(parts: Column, *more: Column) -> Column:
    """Children as the columns of ``_CHILD``, and ``more``."""
    return F.transform(parts, lambda x, i: F.struct(
        i.cast("long").alias("pos"), x["seg"], kind_of_text(x["text"]).alias("kind"), x["text"],
        F.lit(None).cast("string").alias("error"), *more))


def children(records: DataFrame, path: Sequence[PathSegment] = (), column: str = "raw",
             preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Direct children at ``path``: pos, seg, kind, preview, the value verbatim, and error."""
    listed = _below(records, path, column, _CHILD, _listed, lambda parts, of, text: _rows_of(parts))
    return listed.select(*key_columns(records), "pos", "seg", "kind", cut(F.col("text"), preview_chars).alias("preview"),
                         "text", "error")


def children_page(records: DataFrame, path: Sequence[PathSegment] = (), cursor: int = 0, limit: int = CHILD_PAGE,
                  column: str = "raw") -> DataFrame:
    """Children ``cursor .. cursor + limit - 1`` of every record; ``next_cursor`` is NULL at the end.

    The error of a record that breaks off behind the page is not seen.
    """
    def page(text):
        rows = list(_listed(text, cursor, cursor + limit + 1))
        more = cursor + limit if len(rows) > limit and rows[limit][4] is None else None
        yield from ((*row, more) for row in (rows[:limit] if more else rows))

    def builtin(parts, of, text):
        following = F.when(F.size(parts) > cursor + limit, F.lit(cursor + limit).cast("long"))
        return F.slice(_rows_of(parts, following.alias("next_cursor")), cursor + 1, limit)

    listed = _below(records, path, column, f"{_CHILD}, next_cursor long", page, builtin)
    return listed.select(*key_columns(records), "pos", "seg", "kind", "text", "next_cursor", "error")


def node_summary(records: DataFrame, path: Sequence[PathSegment] = (), max_items: int | None = None,
                 column: str = "raw") -> DataFrame:
    """Kind and number of children; with ``max_items`` counting stops there and ``complete`` is false."""
    def count(text):
        kind = _kind(text)
        try:
            n = sum(1 for _ in islice(json_split.children(text), None if max_items is None else max_items + 1))
        except ValueError as err:
            yield kind, None, False, f"not JSON: {err}"
            return
        over = max_items is not None and n > max_items
        held = kind in ("object", "array")
        yield kind, (max_items if over else n) if held else None, not over, None

    def builtin(parts, of, text):
        n = F.size(parts).cast("long")
        over = F.lit(False) if max_items is None else n > max_items
        counted = F.when(of.isin("object", "array"), n if max_items is None else F.least(n, F.lit(max_items).cast("long")))
        return F.array(F.struct(of.alias("kind"), counted.alias("child_count"), (~over).alias("complete"),
                                F.lit(None).cast("string").alias("error")))

    return _below(records, path, column, "kind string, child_count long, complete boolean, error string", count, builtin)


def select_children(records: DataFrame, path: Sequence[PathSegment], wanted: Iterable[PathSegment],
                    column: str = "raw") -> DataFrame:
    """The named children (keys of an object, indexes of an array), in document order."""
    wanted = list(wanted)
    keys = {w for w in wanted if isinstance(w, str)}
    indexes = {str(w) for w in wanted if not isinstance(w, str)}

    def chosen(text):
        names = keys if _kind(text) == "object" else indexes
        return (row for row in _listed(text) if row[1] in names or row[4] is not None)

    def builtin(parts, of, text):
        names, places = ([F.lit(w) for w in sorted(group)] for group in (keys, indexes))
        asked = F.when(of == "object", F.array(*names).cast("array<string>")).otherwise(
            F.array(*places).cast("array<string>"))
        return F.filter(_rows_of(parts), lambda x: F.array_contains(asked, x["seg"]))

    return _below(records, path, column, _CHILD, chosen, builtin)


def subtree_as_records(records: DataFrame, path: Sequence[PathSegment] = (), column: str = "raw") -> DataFrame:
    """Children become records of their own: ``#i`` or ``key:`` and a one-line preview.

    A scalar becomes one record, null none.  Keys of the parent record are kept
    as ``parent_*``.
    """
    keys = key_columns(records)

    def parts(text):
        kind = _kind(text)
        listed = list(_listed(text)) if kind not in ("object", "array") else _listed(text)
        if kind in ("object", "array") or listed:  # a scalar has no children, so what it lists is an error
            yield from ((*row, kind) for row in listed)
        elif kind != "null":
            yield 0, None, kind, text, None, kind

    def builtin(parts, of, text):
        scalar = F.array(F.struct(
            F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("seg"), of.alias("kind"), text.alias("text"),
            F.lit(None).cast("string").alias("error"), of.alias("of")))
        return F.when(of.isin("object", "array"), _rows_of(parts, of.alias("of"))).when(of != "null", scalar)

    rows = _below(records, path, column, f"{_CHILD}, of string", parts, builtin)
    label = F.when(F.col("of") == "array", F.concat(F.lit("#"), F.col("seg"))).when(
        F.col("of") == "object", F.concat(F.col("seg"), F.lit(":")))
    preview = F.concat_ws(" ", label, value_preview(F.col("text"), F.col("kind")))
    return rows.select(
        *[F.col(k).alias(f"parent_{k}") for k in keys], F.col("pos").alias("record_id"),
        F.coalesce(label, F.lit("")).alias("label"), "kind", preview.alias("preview"), F.col("text").alias("raw"), "error")


def subtree_search(records: DataFrame, path: Sequence[PathSegment], query: str, column: str = "raw") -> DataFrame:
    """Children whose label, preview or value contains the text (no ``key:value`` here), and unreadable records."""
    found = subtree_as_records(records, path, column)
    hay = F.concat_ws("\n", F.col("preview"), F.col("raw"))
    return found.where(matches(hay, query, key_value=False) | F.col("error").isNotNull())


def _grown(path: Column, part: Column, of_array: Column) -> Column:
    """Path of a child, as text."""
    return F.when(of_array, F.concat(path, F.lit("["), part["seg"], F.lit("]"))).when(
        path == "", part["seg"]).otherwise(F.concat(path, F.lit("."), part["seg"]))


def _levels(records: DataFrame, column: str, max_depth: int | None, preview_chars: int) -> DataFrame:
    """Keys, ``_raw``, the nodes of each level in ``_n0``, ``_n1``, ... and whether the built-ins vouch for all, ``_sure``.

    A level is the children of the containers of the level above; what is no
    container leaves the frontier at once.
    """
    nothing = F.lit(None).cast("string")
    last = LEVELS if max_depth is None else min(max_depth, LEVELS)
    rows = records.select(*key_columns(records), F.col(column).alias("_raw")).withColumn(
        "_f", F.array(F.struct(F.lit("").alias("path"), F.lit(0).cast("long").alias("pos"), nothing.alias("seg"),
                               F.col("_raw").alias("text")))).withColumn("_sure", F.lit(True))
    for depth in range(last + 1):
        held = F.col("_f")
        first = lambda n: F.substring(n["text"], 1, 1)
        # A scalar below the root is a slice of a text that was put together again, and needs no second look.
        own = (lambda n: parts_of(n["text"])) if not depth else (
            lambda n: F.when(first(n).isin("{", "["), parts_of(n["text"])).otherwise(F.array().cast(PARTS)))
        rows = rows.withColumn("_f", F.transform(held, lambda n: F.struct(
            n["path"], n["pos"], n["seg"], n["text"], kind_of_text(n["text"]).alias("kind"), own(n).alias("parts"))))
        rows = rows.withColumn("_sure", F.col("_sure") & F.forall("_f", lambda n: n["parts"].isNotNull()))
        if depth == last and max_depth is None:
            rows = rows.withColumn("_sure", F.col("_sure") & F.forall("_f", lambda n: F.size(n["parts"]) == 0))
        stops = max_depth is not None and depth == max_depth
        rows = rows.withColumn(f"_n{depth}", F.transform("_f", lambda n: F.struct(
            n["path"], F.lit(depth).alias("depth"), n["pos"], n["seg"], n["kind"],
            F.when(n["kind"].isin("object", "array"), F.size(n["parts"]).cast("long")).alias("child_count"),
            (cut(n["text"], preview_chars) if preview_chars > 0 else F.lit("")).alias("preview"),
            (~n["kind"].isin("object", "array") if stops else F.lit(True)).alias("expanded"), nothing.alias("error"))))
        rows = rows.withColumn("_f", F.flatten(F.transform(
            F.filter("_f", lambda n: F.size(n["parts"]) > 0), lambda n: F.transform(n["parts"], lambda x, i: F.struct(
                _grown(n["path"], x, n["kind"] == "array").alias("path"), i.cast("long").alias("pos"), x["seg"],
                x["text"])))))
    return rows.select(*key_columns(records), "_raw", "_sure",
                       F.concat(*[f"_n{d}" for d in range(last + 1)]).alias("_rows"))


def nodes(records: DataFrame, max_depth: int | None = None, column: str = "raw",
          preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Every node of every record: path, depth, pos, seg, kind, child_count, preview, expanded, error.

    One narrow pass, to any depth.  Built-in functions open a record level by
    level; records that they do not vouch for, or deeper than LEVELS, are walked
    in Python.  With ``max_depth`` a container there is listed with its child
    count and ``expanded`` false.  A record that cannot be read to the end has,
    behind the nodes that were, a row with its ``error``.
    """
    def listed(text):
        place: list[int] = []  # children read so far of the containers on the way; a container ends behind its children
        try:
            for path, kind, count, start, end in json_split.walk(text):
                depth = len(path)
                del place[depth + 1:]
                place += [0] * (depth + 1 - len(place))
                pos = place[depth]
                place[depth] += 1
                if max_depth is not None and depth > max_depth:
                    continue
                shown = text[start:min(end, start + preview_chars)] + (CUT_MARK if end - start > preview_chars else "")
                expanded = count is None or max_depth is None or depth < max_depth
                yield (json_split.path_text(path), depth, pos, str(path[-1]) if path else None, kind, count,
                       shown if preview_chars > 0 else "", expanded, None)
        except ValueError as err:
            yield "", 0, None, None, "unknown", None, None, False, f"not JSON: {err}"

    rows = _levels(records, column, max_depth, preview_chars)
    return _with_second_opinion(rows, key_columns(records), (
        "path string, depth int, pos long, seg string, kind string, child_count long, preview string, "
        "expanded boolean, error string"), listed)
