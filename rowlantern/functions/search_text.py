"""Search text to Catalyst predicate.

``words``       substring, case-insensitive unless asked otherwise
``key:value``   both sides occur somewhere in the record

A needle also matches in its JSON-escaped form, which matters only when it holds
quotes, backslashes or control characters.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def without_quotes(text: str) -> str:
    """Drop one pair of enclosing quotes; a lone quote character is itself."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return text


def needles(query: str, key_value: bool = True) -> list[str]:
    """The texts that must all occur: one, or two for ``key:value``."""
    query = query.strip()
    if not query:
        raise ValueError("search text is empty")
    key, colon, value = (part.strip() for part in query.partition(":"))
    if key_value and colon and key and value:
        return [without_quotes(key), without_quotes(value)]
    return [query]


def contains(hay: Column, needle: str, case_sensitive: bool = False) -> Column:
    """``hay`` must already be lowered when the search ignores case."""
    def fold(text: str) -> Column:
        return F.lit(text) if case_sensitive else F.lower(F.lit(text))

    found = F.contains(hay, fold(needle))
    escaped = quoted(needle)
    if escaped[1:-1] != needle:
        found = found | F.contains(hay, fold(escaped))
    return found


def matches(hay: Column, query: str, case_sensitive: bool = False, key_value: bool = True) -> Column:
    folded = hay if case_sensitive else F.lower(hay)
    return reduce(lambda a, b: a & b, [contains(folded, n, case_sensitive) for n in needles(query, key_value)])


def occurrences(hay: Column, query: str, case_sensitive: bool = False) -> Column:
    """Non-overlapping occurrences, left to right."""
    (needle,) = needles(query, key_value=False)
    folded = hay if case_sensitive else F.lower(hay)
    n = F.lit(needle) if case_sensitive else F.lower(F.lit(needle))
    removed = F.length(folded) - F.length(F.replace(folded, n, F.lit("")))
    return (removed / F.length(n)).cast("long")
