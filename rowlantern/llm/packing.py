"""Packing of documents into training sequences with a bounded number of open windows.

Each task keeps ``windows`` open windows.  A document goes whole into the window
that it fills best; if it fits in none, the fullest window is filled up with its
first tokens and emitted, and what is left of it goes on.  The windows left open
at the end of the tasks are merged, group by group, into full sequences; a last
remainder is laid out in sequences whose lengths are powers of two, so nothing
is padded.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowlantern.llm.tables import lean, store

ENDS = (".", ",")
MARK = "<|"  # special tokens begin with it
CACHED_WORDS, CACHED_BASES, BATCH = 500_000, 500_000, 4096
LAST_LATIN = "\xff"


def _byte_characters() -> list[str]:
    """The printable character by which byte-level tokenizers show each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


SEEN = _byte_characters()
PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()),
    ("ids", pa.binary())])
PIECE_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, sequence long, "
             "offset long, ids binary")


class WordCoder:
    """Token ids of whole texts, remembering those of words.

    The tokenizer's pattern never matches across white space and its
    normalisation looks at nothing beyond it, so a text may be cut at spaces
    and line breaks and its words be encoded by themselves.  Marks of special
    tokens in a text become those tokens, as the library has it by default; a
    word with one is left to the library as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.ends = {"": b"", **{c: self._ids([c])[0] for c in ENDS}}

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        # Words without a last stop or comma, in lower case: the newer and the older half.
        self.bases: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids)
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _merged(self, word: str) -> bytes:
        """Ids of lower-case Latin letters, which normalisation and splitting leave as they are."""
        seen = word if word.isascii() else "".join(map(SEEN.__getitem__, word.encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(seen)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[str]) -> None:
        if len(self.bases) >= CACHED_BASES:
            self.bases, self.older = {}, self.bases
        cut = []
        for w in words:
            # The pattern never matches a letter and a stop together.
            base, end = (w[:-1], w[-1]) if w[-1] in ENDS and w[-2:-1].lower().isalpha() else (w, "")
            if base.isascii():
                base = w if MARK in w else base.lower()
                end = "" if MARK in w else end
            elif base.isalpha() and max(base) <= LAST_LATIN:
                base = base.lower()
            cut.append((w, base, end))
        fresh = []
        for base in {base for _, base, _ in cut}.difference(self.bases):
            if base in self.older:
                self.bases[base] = self.older[base]
            elif base.isalpha() and (base.isascii() or max(base) <= LAST_LATIN):
                self.bases[base] = self._merged(base)
            else:
                fresh.append(base)
        for i in range(0, len(fresh), BATCH):
            self.bases.update(zip(fresh[i:i + BATCH], self._ids(fresh[i:i + BATCH])))
        for w, base, end in cut:
            self.known[w] = self.bases[base] + self.ends[end]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        if len(self.known) >= CACHED_WORDS:
            self.known = {"": b""}
        missing = set(words).difference(self.known)
        if missing:
            self._learn(missing)
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start, ids, doc_tokens):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[:4 * n], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.doc_tokens))

    def __len__(self) -> int:
        return len(self.ids) // 4


class Packer:
    """The open windows of one task; ``add`` gives the sequences that it fills."""

    def __init__(self, size: int, windows: int):
        self.size, self.limit = size, windows
        self.open: list[tuple[int, list[Piece]]] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) > self.size:
            head, piece = piece.cut(self.size)
            yield [head]
        n = len(piece)
        fits = [(self.size - used - n, k) for k, (used, _) in enumerate(self.open) if used + n <= self.size]
        if fits:
            best = min(fits)[1]
            used, held = self.open[best]
            self.open[best] = (used + n, held)
            held.append(piece)
        elif len(self.open) < self.limit:
            self.open.append((n, [piece]))
        else:
            used, held = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            head, rest = piece.cut(self.size - used)
            yield held + [head]
            yield from self.add(rest)
            return
        full = [k for k, (used, _) in enumerate(self.open) if used == self.size]
        for k in full:
            yield self.open.pop(k)[1]


def _rows(sequences, task: int, keep_ids: bool, first: int = 0) -> tuple[list[tuple], int]:
    rows = []
    for held in sequences:
        offset = 0
        for p in held:
            rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, task, first, offset,
                         bytes(p.ids) if keep_ids else None))
            offset += len(p)
        first += 1
    return rows, first


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(PIECE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)


def _pack_task(path: str, end_id: int, size: int, windows: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        # Words come a few at a time, and each core has a worker: threads would only add memory and time.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        packer, own, task, first = Packer(size, windows), coder(path), TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = own.encode(text.as_py() or "") + tail
                    more, first = _rows(packer.add(Piece(doc_id, 0, ids, len(ids) // 4)), task, False, first)
                    rows += more
                yield _batch(rows)
        finally:  # the worker stays for other stages
            own.forget()
        left = [held for _, held in packer.open]
        yield _batch(_rows(left, task, True, first)[0])

    return run


def _merge_task(size: int):
    """Lay the pieces of a group's open windows end to end; cut at full sequences, then at powers of two."""
    def lay(pieces: list[Piece], lengths) -> list[list[Piece]]:
        out, queue = [], pieces[::-1]
        for n in lengths:
            held, room = [], n
            while room:
                p = queue.pop()
                if len(p) > room:
                    p, rest = p.cut(room)
                    queue.append(rest)
                held.append(p)
                room -= len(p)
            out.append(held)
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        groups: dict[int, list[Piece]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                groups.setdefault(r["task"], []).append(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        for task in sorted(groups):
            pieces = groups[task]
            total = sum(map(len, pieces))
            rest = total % size
            powers = [1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]
            yield _batch(_rows(lay(pieces, [size] * (total // size) + powers), task, False)[0])

    return run


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, windows: int = 16, merge: int = 8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of ``size`` tokens (a power of two).

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).
    ``path`` names a tokenizer file that every executor can open.  A document is
    its ids and then ``end_id``; a null text has ``end_id`` alone.  Every
    sequence is full or as long as a power of two.  Repeated rows are packed
    each; a null id stays null; an empty table gives no rows; other columns are
    not read.

    One narrow pass tokenizes and packs; only the open windows, at most
    ``windows * size`` tokens a task, are shuffled, and ``merge`` tasks' windows
    meet in one group.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Written once: both parts below must come from the same run of the first pass.
    pieces = store(rows.mapInArrow(lean(_pack_task(path, end_id, size, windows)), PIECE_SQL), "packed")
    done = pieces.where("ids is null").withColumn("sequence_id", F.col("task") * (1 << 40) + F.col("sequence") * 2)
    group = F.floor(F.col("task") / merge)
    left = pieces.where("ids is not null").withColumn("task", group).repartition("task").sortWithinPartitions(
        "task", "doc_id", "start", "ids_crc32")
    merged = left.mapInArrow(lean(_merge_task(size)), PIECE_SQL).withColumn(
        "sequence_id", F.col("task") * (1 << 40) + F.col("sequence") * 2 + 1)
    return done.unionByName(merged).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
