"""Removal of byte strings that repeat anywhere: a collection's suffix order, built column by column.

Every repeated string of LENGTH bytes holds an anchor, a string of ANCHOR bytes
with the least hash among the places of a window, at the same place in each of
its occurrences.  So the documents of the construction are the anchors that
repeat, each with the bytes around it that one string may take: at most
LENGTH - ANCHOR before and as many after.  However long the texts, the
construction ends after a fixed number of rounds.

All documents of a bounded bucket get one symbol more each round, from the last
to the first.  Stably sorting the last round's order by the new symbols gives the
order of the suffixes from this symbol on (the symbols in that order are the
round's piece of the Burrows-Wheeler transform); what two neighbours have in
common is one more than the least common prefix between them in the round
before.  Neighbours that share as many symbols as a string has are a repeat.

Anchors whose surroundings are equal as a whole need no construction, only
counting.  An anchor with very many different surroundings is no bucket: its
strings are split by how many bytes they take before the anchor, in halves,
and those of each half share the bytes that all its strings take, so most are
alone; a half of one string is settled by counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlantern.llm.shingles import mixed
from rowlantern.llm.tables import store

LENGTH, ANCHOR = 200, 100
#: Bytes of a string that are not its anchor; as many places has a window, and one more.
SPARE = LENGTH - ANCHOR
#: Documents of one bucket of nodes, and of one node beyond which it is split.
BUCKET = NODE = 20_000
#: Most that is broadcast, as a hash table.
BROADCAST_BYTES = 128 << 20
STEP = 1 << 19  # places hashed at a time
LOW = np.uint64((1 << 20) - 1)

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(1306).integers(1, 1 << 63, 256, dtype=np.uint64)
KEY = "doc_id long, mark long"
KEY_FIELDS = [("doc_id", pa.int64()), ("mark", pa.int64())]
PLACE_SQL = f"{KEY}, pos long, anchor long, around long"
PLACE = pa.schema([*KEY_FIELDS, ("pos", pa.int64()), ("anchor", pa.int64()), ("around", pa.int64())])
PIECE_SQL = f"{KEY}, pos long, node binary, low int, high int, before binary, after binary"
PIECE = pa.schema([*KEY_FIELDS, ("pos", pa.int64()), ("node", pa.binary()), ("low", pa.int32()), ("high", pa.int32()),
                   ("before", pa.binary()), ("after", pa.binary())])
SPAN_SQL = f"{KEY}, start long, end long"
SPAN = pa.schema([*KEY_FIELDS, ("start", pa.int64()), ("end", pa.int64())])


class Rolling:
    """Hashes of all strings of ANCHOR bytes in up to STEP places: differences of a running sum."""

    def __init__(self):
        n = STEP + LENGTH
        self.up = np.cumprod(np.full(n, np.uint64(_BASE)))
        self.down = np.cumprod(np.full(n, np.uint64(pow(_BASE, -1, 1 << 64))))

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[:len(raw)])])
        return mixed((total[ANCHOR:] - total[:-ANCHOR]) * self.down[:len(raw) - ANCHOR + 1])

    def anchors(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of a text: the least hash of each window, the rightmost of equal ones."""
        places, hashes = [], []
        for first in range(0, max(len(raw) - LENGTH + 1, 0), STEP):
            part = self.hashes(raw[first:first + STEP + LENGTH - 1])
            n, width = len(part), SPARE + 1
            # The low bits are the place, counted backwards.
            key = (part & ~LOW) | (LOW - np.arange(n, dtype=np.uint64))
            rows = np.concatenate([key, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
            at = (LOW - (least[np.append(True, least[1:] != least[:-1])] & LOW)).astype(np.int64)
            places.append(at + first)
            hashes.append(part[at])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at, i = np.unique(np.concatenate(places), return_index=True)
        return at, np.concatenate(hashes)[i]


def _sides(at: int, size: int) -> tuple[int, int]:
    return max(at - SPARE, 0), min(at + LENGTH, size)


def _places(only_anchors: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        rolling = Rolling()
        for batch in batches:
            keys = [c.to_pylist() for c in batch.columns[:2]]
            out = [[] for _ in PLACE]
            for doc_id, mark, text in zip(*keys, batch.column(2)):
                data = (text.as_py() or "").encode()
                at, hashes = rolling.anchors(np.frombuffer(data, np.uint8))
                if not len(at):
                    continue
                out[3].append(hashes.astype(np.int64))
                if only_anchors:
                    continue
                around = []
                for p in at.tolist():
                    a, b = _sides(p, len(data))
                    around.append(xxhash.xxh3_64_intdigest(data[a:b], p - a))
                out[0] += [doc_id] * len(at)
                out[1] += [mark] * len(at)
                out[2].append(at)
                out[4] += around
            joined = [np.concatenate(out[k]) if out[k] else np.empty(0, np.int64) for k in (2, 3)]
            if only_anchors:
                yield pa.RecordBatch.from_arrays([pa.array(joined[1], pa.int64())], names=["anchor"])
                continue
            around = np.array(out[4], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(joined[0], pa.int64()),
                pa.array(joined[1], pa.int64()), pa.array(around, pa.int64())], schema=PLACE)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(doc_id, mark, text, places) to the anchors there with the bytes around them."""
    for batch in batches:
        rows = []
        for doc_id, mark, text, places in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3)):
            data = text.as_py().encode()
            for p in places.as_py():
                a, b = _sides(p, len(data))
                node = xxhash.xxh3_128_digest(data[p:p + ANCHOR])
                rows.append((doc_id, mark, p, node, 0, SPARE, data[a:p], data[p + ANCHOR:b]))
            if len(rows) >= BUCKET:
                yield _batch(rows, PIECE)
                rows = []
        yield _batch(rows, PIECE)


def _halves(batches: Iterator[pa.RecordBatch]):
    """Each document to the two halves of its strings, named by the bytes that all strings of the half take."""
    for batch in batches:
        rows = []
        for doc_id, mark, pos, node, low, high, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            middle = (low + high) // 2
            for a, b in (low, middle), (middle + 1, high):
                if len(before) >= a and len(after) >= SPARE - b:
                    taken = before[len(before) - a:len(before) - low] + after[SPARE - high:SPARE - b]
                    name = xxhash.xxh3_128_digest(node + bytes([a, b]) + taken)
                    rows.append((doc_id, mark, pos, name, a, b, before, after))
        yield _batch(rows, PIECE)


def column_wise(nodes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which documents share a string with another one, for each of its places.

    Document i is ``before[i]``, the symbol ``nodes[i]`` and ``after[i]``, with
    w symbols before and after, 0 where there is none.  Returns (documents,
    w + 1) flags: whether the w + 1 symbols from column c on, which always
    include the node, also stand there in another document.
    """
    m, width = before.shape
    columns = [*(before[:, c] for c in range(width)), nodes, *(after[:, c] for c in range(width))]
    order, common = np.arange(m), np.zeros(m + 1, np.int64)
    repeated = np.zeros((m, width + 1), bool)
    for c in range(2 * width, -1, -1):
        symbols = columns[c][order]
        # One symbol more per document: the round's piece of the transform, sorted, is the new order.
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        same = symbols[1:] == symbols[:-1]
        between = np.empty(2 * (m - 1), np.int64)
        between[0::2], between[1::2] = moved[:-1] + 1, moved[1:] + 1
        # Where the symbols differ, the range is not needed: make it short.
        between[0::2][~same] = between[1::2][~same]
        least = np.minimum.reduceat(common, between)[0::2] if m > 1 else np.empty(0, np.int64)
        order = order[moved]
        common = np.zeros(m + 1, np.int64)
        common[1:m][same] = least[same] + 1
        if c <= width:
            alike = common > width
            repeated[order, c] = alike[:-1] | alike[1:]
    return repeated


def _padded(parts: list[bytes], width: int, right: bool) -> np.ndarray:
    """Bytes as symbols from 1, filled up with 0 on the outer side."""
    out = np.zeros((len(parts), width), np.uint16)
    for row, part in zip(out, parts):
        if part:
            codes = np.frombuffer(part, np.uint8)
            if right:
                row[width - len(codes):] = codes
                row[width - len(codes):] += 1
            else:
                row[:len(codes)] = codes
                row[:len(codes)] += 1
    return out


def _bucket_spans(rows: list[tuple]) -> list[tuple]:
    """The bytes that repeated strings cover around each document of whole nodes of one range."""
    low, high = rows[0][4:6]
    width = high - low
    before = [r[6][max(len(r[6]) - high, 0):len(r[6]) - low] for r in rows]
    after = [r[7][SPARE - high:SPARE - low] for r in rows]
    known: dict[bytes, int] = {}
    nodes = np.array([known.setdefault(r[3], len(known)) for r in rows])
    found = column_wise(nodes, _padded(before, width, True), _padded(after, width, False))
    # A string must lie inside its text; equal ones lack the same symbols.
    column = np.arange(width + 1)
    found &= column >= width - np.array([len(b) for b in before])[:, None]
    found &= column <= np.array([len(a) for a in after])[:, None]
    out = []
    for i in np.flatnonzero(found.any(axis=1)).tolist():
        c = np.flatnonzero(found[i])
        # The string from column c on takes high - c bytes before the anchor.
        start = rows[i][2] - (high - int(c[0]))
        out.append((*rows[i][:2], start, rows[i][2] - (high - int(c[-1])) + LENGTH))
    return out


def _spans(batches: Iterator[pa.RecordBatch]):
    """Sorted by range and node: buckets of whole nodes, one after the other."""
    rows: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (row[4:6] != rows[-1][4:6] or len(rows) >= BUCKET and row[3] != rows[-1][3]):
                out += _bucket_spans(rows)
                rows = []
            rows.append(row)
        yield _batch(out, SPAN)
    yield _batch(_bucket_spans(rows) if rows else [], SPAN)


def _merged(batches: Iterator[pa.RecordBatch]):
    """Spans sorted by document and start to one row per document, spans that touch as one."""
    own: list = []
    for batch in batches:
        out = []
        for doc_id, mark, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if not own or own[0] != doc_id or own[1] != mark:
                if own:
                    out.append(tuple(own))
                own = [doc_id, mark, []]
            spans = own[2]
            if spans and start <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], end)
            else:
                spans.append({"start": start, "end": end})
        yield _batch(out, REMOVED)
    yield _batch([tuple(own)] if own else [], REMOVED)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "spans array<struct<start:long,end:long>>"
REMOVED = pa.schema([("own", pa.int64()), ("own_mark", pa.int64()), ("spans", SPANS)])
REMOVED_SQL = f"own long, own_mark long, {SPANS_SQL}"
KEPT_SQL = f"doc_id long, n_bytes long, {SPANS_SQL}, kept binary"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])


def _without(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        n_bytes, spans, kept = [], [], []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode()
            own = [(s["start"], min(s["end"], len(data))) for s in found or ()]
            edges = [0, *(e for span in own for e in span), len(data)]
            n_bytes.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, SPANS),
                                          pa.array(kept, pa.binary())], schema=KEPT)


def few(df: DataFrame, a_row: int, more: Column | None = None) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if it is counted to be small: ``a_row`` and ``more`` bytes a row."""
    size = df.agg(F.coalesce(F.sum(F.lit(a_row) if more is None else more + a_row), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _same_document(keys: DataFrame, rows: DataFrame):
    return rows["doc_id"].eqNullSafe(keys["own"]) & (rows["mark"] == keys["own_mark"])


def _around_anchors(pieces: DataFrame) -> list[DataFrame]:
    """Spans of repeated strings around the documents of the construction."""
    found = []
    while True:
        sizes = pieces.groupBy("node", "low", "high").agg(F.count(F.lit(1)).alias("size"))
        hot = store(sizes.where(F.col("size") > NODE), "repeat-hot")
        if not hot.limit(1).count():
            found.append(pieces)
            break
        wide = few(hot.select("node"), 100)
        found.append(pieces.join(wide, "node", "left_anti"))
        both = pieces.join(wide, "node")
        # Strings of one length before the anchor are equal if they are in one node.
        settled = both.where("low = high").select(
            "doc_id", "mark", (F.col("pos") - F.col("low")).alias("start"), (F.col("pos") - F.col("low") + LENGTH).alias("end"))
        found.append(settled)
        pieces = store(both.where("low < high").select(*PIECE.names).mapInArrow(_halves, PIECE_SQL), "repeat-halves")
    out = []
    for df in found:
        if "node" in df.columns:
            dealt = df.select(*PIECE.names).repartition("node").sortWithinPartitions("low", "high", "node")
            df = dealt.mapInArrow(_spans, SPAN_SQL)
        out.append(df)
    return out


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: its bytes outside strings of LENGTH bytes that occur more than once.

    A string counts wherever else it starts, in the same text too; texts are
    judged as given.  ``spans`` are the removed runs (start, end), ``kept`` the
    other bytes.  Texts under LENGTH bytes, null and empty ones lose nothing;
    repeated rows are occurrences of each other and of their own; a null id
    stays null; an empty table gives no rows; other columns are not read.

    Two hashes of an anchor's bytes and of those around it, 64 bits each,
    decide whether surroundings are equal as a whole; others are compared.
    Only anchors that repeat are joined; texts are read three times, and only
    shuffled where what is asked of them is too much to broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    anchors = rows.mapInArrow(_places(True), "anchor long")
    often = store(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-anchors")
    places = store(rows.mapInArrow(_places(False), PLACE_SQL).join(few(often, 24), "anchor"), "repeat-places")

    kinds = store(places.groupBy("anchor", "around").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "mark", "pos")).alias("at")), "repeat-kinds")
    # Joined by one number; the other one is compared then.
    alike = few(kinds.where("c > 1").select(F.col("anchor").alias("its_anchor"), "around"), 48)
    whole = places.join(alike, "around").where("anchor = its_anchor").select(
        "doc_id", "mark", F.greatest(F.col("pos") - SPARE, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end"))

    several = store(kinds.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-several")
    asked = kinds.join(few(several, 24), "anchor").groupBy("at.doc_id", "at.mark").agg(F.collect_list("at.pos").alias("places"))
    asked = store(asked.select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "places"), "repeat-asked")
    keys = few(asked, 100, 8 * F.size("places"))
    pieces = store(rows.join(keys, _same_document(keys, rows)).select("doc_id", "mark", "text", "places").mapInArrow(
        _pieces, PIECE_SQL), "repeat-pieces")

    spans = whole
    for more in _around_anchors(pieces):
        spans = spans.unionByName(more)
    dealt = spans.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "start")
    removed = store(dealt.mapInArrow(_merged, REMOVED_SQL), "repeat-spans")
    keys = few(removed, 100, 32 * F.size("spans"))
    return rows.join(keys, _same_document(keys, rows), "left").select("doc_id", "text", "spans").mapInArrow(
        _without, KEPT_SQL)


def digests(found: DataFrame) -> DataFrame:
    """One row per document: its bytes, the removed bytes and runs, and a checksum of what is kept."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
