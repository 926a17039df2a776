"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one last token that ends a
valid encoding of the prefix: the token that fits behind the last token of the
prefix before it.  A list of these last tokens is the whole state.  It grows by
an append without a look back, an edit keeps all entries before it, and walking
it from the end gives the encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters with Unicode's White_Space property; the regex module's \s has four more.
SPACE = r"\t-\r \x85\xa0  -     　"
CACHED_CHUNKS, CACHED_PIECES, CACHED_PAIRS, LONG = 150_000, 300_000, 1_000_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks, with the two questions that the dynamic programme asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        # Finds, at every byte, all tokens that end there; bytes stand as the characters of the same number.
        self.ending = ahocorasick.Automaton()
        for data, token in ranks.items():
            self.ending.add_word(data.decode("latin-1"), (token, len(data)))
        self.ending.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the definition: join the neighbours of lowest rank until none joins."""
        rank, never = self.ranks.get, 1 << 60
        at = list(range(len(data) + 1))
        joint = [rank(data[i:i + 2], never) for i in range(len(data) - 1)]
        while joint and (low := min(joint)) < never:
            i = joint.index(low)
            del at[i + 1], joint[i]
            if i < len(joint):
                joint[i] = rank(data[at[i]:at[i + 2]], never)
            if i:
                joint[i - 1] = rank(data[at[i - 1]:at[i + 1]], never)
        return [self.ranks[data[a:b]] for a, b in zip(at, at[1:])]

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHED_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, last: list[int], data: bytes) -> None:
        """Continue ``last``, the last token of every prefix, to all prefixes of ``data``."""
        done = len(last)
        last += [-1] * (len(data) - done)
        known, base = self._fits, max(0, done + 1 - self.longest)
        for end, (token, n) in self.ending.iter(data[base:].decode("latin-1")):
            end += base
            if end < done or last[end] >= 0:
                continue
            begin = end + 1 - n
            if begin:
                left = last[begin - 1]
                fit = known.get(left << 32 | token)
                if fit or fit is None and self.fits(left, token):
                    last[end] = token
            elif self.reachable(token):
                last[end] = token
        if -1 in last[done:]:
            raise ValueError("the ranks lack single bytes")


class PrefixEncoding:
    """Encoding of one byte string that can be appended to and edited.

    ``last[i]`` is the last token of the encoding of the first ``i + 1`` bytes.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.last, self.data)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start..end; entries before ``start`` are kept.

        Behind the edit old entries are taken up again once as many of them as
        the longest token have come out the same, as nothing older is looked at.
        """
        tail, old = self.data[end:], self.last[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        same, longest = 0, self.vocabulary.longest
        for i in range(0, len(tail), longest):
            self.append(tail[i:i + longest])
            for now, was in zip(self.last[start + len(new) + i:], old[i:]):
                same = same + 1 if now == was else 0
            if same >= 2 * longest:
                self.data, self.last = self.data + tail[i + longest:], self.last + old[i + longest:]
                break

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class TextCoder:
    """Whole texts to ids and back; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.space, self.spaces = re.compile(f"[{SPACE}]"), re.compile(f"[{SPACE}]{{2}}")
        self._chunks: dict[str, tuple[int, ...]] = {}
        # The newer and the older half of the remembered pieces.
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self.digits = {i: str(i) for i in self.vocabulary.bytes_of}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = self._older.get(piece)
            if ids is None:
                data = piece.encode()
                token = self.vocabulary.ranks.get(data)
                whole = token is not None and self.vocabulary.reachable(token)
                ids = (token,) if whole else tuple(PrefixEncoding(self.vocabulary, data).ids())
            if len(piece) <= LONG:
                if len(self._pieces) >= CACHED_PIECES:
                    self._pieces, self._older = {}, self._pieces
                self._pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(i for piece in self.pattern.findall(chunk) for i in self._piece(piece))
        if len(chunk) <= LONG:
            if len(self._chunks) >= CACHED_CHUNKS:
                self._chunks.clear()
            self._chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.spaces.search(text) or self.space.match(text[0]) or self.space.match(text[-1]):
            chunks = self.pattern.findall(text)
        else:  # a match starts at every lone space between other characters
            head, *rest = text.split(" ")
            chunks = [head, *(" " + w for w in rest)]
        out: list[int] = []
        for chunk in chunks:
            ids = self._chunks.get(chunk)
            out += self._chunk(chunk) if ids is None else ids
        return out

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more from the ids of text: only the last matches are encoded anew."""
        starts = [m.start() for m in self.pattern.finditer(text)]
        keep = starts[-3] if len(starts) > 3 else 0
        tail, redo = len(text[keep:].encode()), 0
        while tail > 0:
            redo += 1
            tail -= len(self.vocabulary.bytes_of[ids[-redo]])
        return ids[:len(ids) - redo] + self.encode(text[keep:] + more)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TextCoder:
    return TextCoder(read_ranks(path), pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()),
                     ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: pa.Schema, sql: str, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [of(i, texts[k].as_py() or "") for k, i in enumerate(ids)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, sql)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text, one narrow pass.

    ``path`` names a rank file that every executor can open.  Null texts are
    empty and have no ids; repeated rows are encoded each; an empty table gives
    no rows; other columns are not read.
    """
    return _mapped(docs, id_col, text_col, ENCODED, "doc_id long, ids array<int>",
                   lambda i, text: (i, coder(path, pattern).encode(text)))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256) of the ids of every whole text.

    Encodes as ``encode`` does, decodes the ids, and keeps the digests alone.
    """
    def row(i, text):
        own = coder(path, pattern)
        ids = own.encode(text)
        data = own.decode(ids)
        return (i, len(ids), len(data), hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(data).hexdigest())

    return _mapped(docs, id_col, text_col, DIGESTS,
                   "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string", row)
