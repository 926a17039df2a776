"""Periodic runs of words in whole texts, by maximal pairs.

Two occurrences of the same words that can be prolonged neither to the left nor
to the right are a maximal pair.  If their distance q is short against their
common length l, the stretch from the first to the end of the second has period
q and no neighbouring word extends it: with l >= 3 q and l >= 5, the pair is a
run of at least four periods and six words, and every such run is a pair.

Suffixes are sorted by doubling, the intervals of their common prefixes are
walked bottom-up, and each interval keeps its positions in text order, each
with the word to its left as its class.  Occurrences of one string that lie
within a third of its length are evenly spaced, and all but the first of them
have the same left word; so a position meets at most two classes nearby, and
both are found by one search to each side.  Of two intervals that meet, the
smaller is looked up in the larger.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words that both occurrences of a pair share at least: of a run of period 1, all but one.
SHORTEST = LEAST - 1
BLOCK = 9  # positions are kept in blocks of 512
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_SQL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words at each place, until every place differs.

    Empty if no stretch of SHORTEST words occurs twice.
    """
    n = len(codes)
    levels = [codes]
    width = 1
    while width < n:
        last = levels[-1].astype(np.int64)
        ahead = np.zeros(n, np.int64)
        ahead[:n - width] = last[width:]
        _, rank = np.unique(last * (n + 1) + ahead, return_inverse=True)
        levels.append((rank + 1).astype(np.int32))
        width *= 2
        if int(rank.max()) + 1 == n:
            return levels if width > SHORTEST else []
        if width == SHORTEST - 1:
            five = levels[-1][:n - width].astype(np.int64) * (n + 1) + codes[width:]
            if len(np.unique(five)) == len(five):
                return []
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two suffixes that follow each other in ``order``."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        a += step
        b += step
        common += step
    return common


class Interval:
    """Positions that share a prefix, in text order, by blocks."""

    __slots__ = ("blocks", "size")

    def __init__(self, at: int):
        self.blocks, self.size = {at >> BLOCK: [at]}, 1

    def add(self, at: int) -> None:
        block = self.blocks.get(at >> BLOCK)
        if block is None:
            self.blocks[at >> BLOCK] = [at]
        else:
            insort(block, at)
        self.size += 1

    def first(self, low: int, high: int) -> int:
        """The first position from ``low`` to below ``high``, else -1."""
        for k in range(low >> BLOCK, (high - 1 >> BLOCK) + 1):
            block = self.blocks.get(k)
            if block:
                i = bisect_left(block, low)
                if i < len(block):
                    return block[i] if block[i] < high else -1
        return -1


def _meet(a: Interval, b: Interval, common: int, left: list[int], found: dict[tuple[int, int], int]) -> Interval:
    """Join two intervals; note the runs among the maximal pairs of one position of each."""
    if a.size > b.size:
        a, b = b, a
    reach = common // (TIMES - 1)
    for block in a.blocks.values():
        for i in block:
            j = b.first(max(i - reach, 0), i)
            if j >= 0 and left[j] != left[i]:
                _note(j, i, common, found)
            # To the right, all positions nearby have one class.
            j = b.first(i + 1, i + reach + 1)
            while j >= 0 and left[j] != left[i]:
                _note(i, j, common, found)
                j = b.first(j + 1, i + reach + 1)
    for block in a.blocks.values():
        for i in block:
            b.add(i)
    return b


def _note(i: int, j: int, common: int, found: dict[tuple[int, int], int]) -> None:
    # Multiples of a period give the same stretch: the least one counts.
    where = (i, j + common)
    found[where] = min(found.get(where, j - i), j - i)


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``codes`` (numbers from 1), by start, then period."""
    if len(codes) < LEAST:
        return []
    levels = suffix_ranks(codes.astype(np.int32))
    if not levels:
        return []
    order = np.argsort(levels[-1], kind="stable")
    common = common_prefixes(levels, order)
    del levels
    left = [0, *codes[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    deep = common >= SHORTEST
    # Suffixes that share SHORTEST words with a neighbour; a stretch of them is a subtree.
    used = np.flatnonzero(np.append(deep, False) | np.append(False, deep))
    stack: list[tuple[int, Interval]] = []
    for at, ahead in zip(order[used].tolist(), np.append(common, 0)[used].tolist()):
        here = Interval(at)
        while stack and stack[-1][0] > ahead:
            depth, above = stack.pop()
            here = _meet(above, here, depth, left, found)
        if ahead < SHORTEST:
            continue
        if stack and stack[-1][0] == ahead:
            stack[-1] = (ahead, _meet(stack[-1][1], here, ahead, left, found))
        else:
            stack.append((ahead, here))
    return sorted((i, end - i, q) for (i, end), q in found.items())


def numbered_words(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def _find(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        n_words, runs, kept = [], [], []
        for text in batch.column(1):
            words = (text.as_py() or "").encode().split()  # of bytes: white space is x20 and x09 to x0D
            found = find_runs(numbered_words(words))
            n_words.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            if found:
                words = [words[i] for i in kept_words(len(words), found)]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.string())],
            schema=FOUND)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs and its text with each run cut to one period.

    Words are parted by white space and numbered from 0.  A run is a stretch of
    at least LEAST words and TIMES of its smallest period that no neighbouring
    word extends; ``runs`` holds (start, length, period) by start, then period.
    ``collapsed`` has the words that no run contains after its first period,
    joined by one space.  A null or empty text has no words, no runs and an
    empty ``collapsed``; repeated rows are answered each; a null id stays null;
    an empty table gives no rows; other columns are not read.  One narrow pass:
    memory grows with the longest text, not with the table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find, FOUND_SQL)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts of about a tenth of the ids made periodic, by the checksum of the id.

    Let h be the crc32 of the decimal id and g = floor(h / 10).  If h % 10 is 0
    and the text has n > 0 words, word i >= a becomes word a + (i - a) % p with
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, null ids
    and null texts stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    looped_words = F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)))
    made = F.concat_ws(" ", F.slice(looped_words, F.lit(1), n))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & (F.length(F.regexp_replace(text_col, r"[\x20\x09-\x0D]+", "")) > 0)
    return docs.withColumn(text_col, F.when(chosen, made).otherwise(F.col(text_col)))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: how many runs, the run of most periods, and checksums of all runs and of the rest.

    Of runs with equal exponents the first in order of start, then period, counts.
    """
    def more(best, run):
        longer = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | longer, run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), more)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
