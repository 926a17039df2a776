"""Arrow-batch helpers that run inside scan tasks.

A file is read by Spark in splits; a split arrives here as an ordered run of
*pieces* (text between two separators).  Whether a piece opens a record depends
on what came before it: a quote that is still open, or a bracket depth.  One
split cannot know that alone, so the work is done twice:

* ``summarise_*``  reads every split under both possible quote states and emits
  ONE numeric row per split (no text apart from a header record);
* ``assemble_*``   reads the split again, now knowing its true entry state, and
  emits the records that begin and end inside it.

Everything between the two (composing the states along a file) is plain window
SQL over the per-split rows, see ``splits.py``.
"""

from __future__ import annotations

import base64
import json
import re
from json.encoder import encode_basestring as _quote
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = b" \t\r\n\x00"
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANK)] = True
_DELTA = np.zeros(256, dtype=np.int8)
_DELTA[list(b"{[")] = 1
_DELTA[list(b"}]")] = -1

# Bytes after which a new top-level value may start without a blank.
_ENDS_TOKEN = np.zeros(256, dtype=bool)
_ENDS_TOKEN[list(BLANK + b'}],"[')] = True

# Bytes of text that are looked at together: a kernel holds some 40 bytes for each.
CHUNK_BYTES = 1 << 20

_START = pa.struct([
    ("inside", pa.int32()), ("rel", pa.int32()), ("n", pa.int64()),
    ("first_piece", pa.int64()), ("first_byte", pa.int64()), ("first_off", pa.int64()),
    ("last_piece", pa.int64()), ("last_byte", pa.int64()), ("last_off", pa.int64()),
])
_CLOSE = pa.struct([
    ("inside", pa.int32()), ("rel", pa.int32()),
    ("piece", pa.int64()), ("byte", pa.int64()), ("off", pa.int64()),
])
SUMMARY = pa.schema([
    ("file", pa.string()), ("block_start", pa.int64()), ("block_length", pa.int64()),
    ("file_size", pa.int64()), ("first_seq", pa.int64()),
    ("n_pieces", pa.int64()), ("n_bytes", pa.int64()),
    ("out0", pa.int32()), ("out1", pa.int32()), ("delta0", pa.int32()), ("delta1", pa.int32()),
    ("starts", pa.list_(_START)), ("closes", pa.list_(_CLOSE)), ("head", pa.binary()),
])
SUMMARY_DDL = (
    "file string, block_start long, block_length long, file_size long, first_seq long, "
    "n_pieces long, n_bytes long, out0 int, out1 int, delta0 int, delta1 int, "
    "starts array<struct<inside:int,rel:int,n:long,first_piece:long,first_byte:long,first_off:long,"
    "last_piece:long,last_byte:long,last_off:long>>, "
    "closes array<struct<inside:int,rel:int,piece:long,byte:long,off:long>>, head binary"
)


def _known_splits(batch):
    """Split starts of a second pass: ``info`` is set on the first row only."""
    info = batch.column("info")
    marks = np.flatnonzero(np.asarray(info.is_valid()))
    return {m: _facts(info[m].as_py()) for m in marks.tolist()}


def _facts(text):
    facts = json.loads(text)
    head = facts["head"]
    return {**facts, "head": None if head is None else base64.b64decode(head)}


def _new_splits(batch, last):
    """Split starts of a first pass: the split differs from the row before."""
    split, seq = batch.column("split"), batch.column("seq")
    n = batch.num_rows
    moved = np.ones(n, dtype=bool)
    moved[0] = last != split[0].as_py()
    if n > 1:
        moved[1:] = np.asarray(pc.not_equal(split.slice(1), split.slice(0, n - 1)))
    opened = {}
    for i in np.flatnonzero(moved).tolist():
        start, length, size, file = split[i].as_py().split("|", 3)
        opened[i] = {"file": file, "block_start": int(start), "block_length": int(length),
                     "file_size": int(size), "first_seq": seq[i].as_py()}
    return opened, split[n - 1].as_py()


def run_by_split(batches, begin, feed, finish):
    """Drive ``begin/feed/finish`` over the splits of one task, in order."""
    state = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if "info" in batch.schema.names:
            opened = _known_splits(batch)
        else:
            opened, last = _new_splits(batch, last)
        edges = sorted({0, *opened, batch.num_rows})
        for a, b in zip(edges, edges[1:]):
            if a in opened:
                if state is not None:
                    yield from finish(state)
                state = begin(opened[a])
            for part in _portions(batch.slice(a, b - a)):
                yield from feed(state, part)
    if state is not None:
        yield from finish(state)


def _portions(rows):
    """Rows in runs of about ``CHUNK_BYTES`` of text, so memory does not follow the size of a batch."""
    ends = np.cumsum(_lengths(rows.column("value")) + 1)
    a = 0
    while a < rows.num_rows:
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield rows.slice(a, b - a)
        a = b


# --- CSV -----------------------------------------------------------------

_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
# A run of complete fields: quoted ones that close again, or ones without an opening quote.
_FIELD = rb'(?:[ \t]*+"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?![ \t]*+")[^,]*+)'
_COMPLETE = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+")


def quote_open_after(line: bytes, inside: bool) -> bool:
    """Is a quoted field still open at the end of this physical line?

    A quote opens only at a field start (blanks may precede it); inside, a
    doubled quote is a literal one.
    """
    start = 0
    if inside:
        m = _CLOSING.match(line)
        if m is None:
            return True
        start = line.find(b",", m.end()) + 1
        if not start:
            return False
    return _COMPLETE.fullmatch(line, start) is None


def _states_before(quoted, n, inside):
    """Quote state before each of n lines; ``quoted`` lists (index, line)."""
    before = np.zeros(n, dtype=bool)
    at = 0
    for i, line in quoted:
        before[at:i + 1] = inside
        inside = quote_open_after(line, inside)
        at = i + 1
    before[at:] = inside
    return before, inside


def split_fields(record: str) -> list[str]:
    """Fields of one record: any quote toggles, a doubled quote inside is literal."""
    if '"' not in record:
        return record.split(",")
    if record[0] == record[-1] == '"':
        fields = record[1:-1].split('","')
        if record.count('"') == 2 * len(fields):  # every field quoted, no quote within
            return fields
    runs = record.split('"')
    first = runs[0].split(",")
    fields, cur = first[:-1], [first[-1]]
    inside, i = False, 1
    while i < len(runs):
        if inside and runs[i] == "" and i + 1 < len(runs):
            cur.append('"')
            i += 1
            cur.append(runs[i])
        else:
            inside = not inside
            if inside:
                cur.append(runs[i])
            else:
                head, *more = runs[i].split(",")
                cur.append(head)
                for text in more:
                    fields.append("".join(cur))
                    cur = [text]
        i += 1
    fields.append("".join(cur))
    return fields


def header_names(record: str) -> list[str]:
    names = split_fields(record.lstrip("﻿"))
    return [name if name.strip() else f"col_{i}" for i, name in enumerate(names)]


def object_maker(names: list[str]):
    """Function from a data record to a JSON object keyed by the header."""
    keys = [_quote(name) + ":" for name in names]
    unique = len(set(names)) == len(names) and "__extra__" not in names

    def make(record: str) -> str:
        fields = split_fields(record)
        missing = len(keys) - len(fields)
        if unique and missing >= 0:
            if missing:
                fields += [""] * missing
            return "{" + ",".join(map(add, keys, map(_quote, fields))) + "}"
        obj = {name: fields[i] if i < len(fields) else "" for i, name in enumerate(names)}
        if missing < 0:
            obj["__extra__"] = fields[len(names):]
        return json.dumps(obj, ensure_ascii=False, separators=(",", ":"))

    return make


def clean_record(raw: bytes) -> str:
    """Text of a CSV record without its terminator (``\\n`` is already gone)."""
    return (raw[:-1] if raw.endswith(b"\r") else raw).decode("utf-8", "replace")


def _quoted_lines(values):
    for i, v in enumerate(values):
        if v is not None and b'"' in v:
            yield i, v


def summarise_csv(batches):
    def begin(info):
        return {"info": info, "pieces": 0, "bytes": 0, "inside": [False, True],
                "starts": [None, None], "head": [], "head_done": info["block_start"] != 0}

    def feed(st, part):
        n = part.num_rows
        lens = part.column("len").to_numpy().astype(np.int64)
        offs = np.cumsum(lens) - lens + st["bytes"]
        values = part.column("value").to_pylist()
        quoted = list(_quoted_lines(values))
        for h in (0, 1):
            if h == 1 and st["inside"][0] == st["inside"][1]:
                before, after = before0, after0
            else:
                before, after = _states_before(quoted, n, st["inside"][h])
            if h == 0:
                before0, after0 = before, after
                if not st["head_done"]:
                    _collect_head(st, values, before)
            idx = np.flatnonzero(~before)
            if len(idx):
                lo, hi = int(idx[0]), int(idx[-1])
                seen = st["starts"][h]
                if seen is None:
                    seen = st["starts"][h] = {
                        "inside": h, "rel": 0, "n": 0, "first_piece": st["pieces"] + lo,
                        "first_byte": 0, "first_off": int(offs[lo])}
                seen["n"] += len(idx)
                seen.update(last_piece=st["pieces"] + hi, last_byte=0, last_off=int(offs[hi]))
            st.setdefault("next", [None, None])[h] = after
        st["inside"] = list(st["next"])
        st["pieces"] += n
        st["bytes"] += int(lens.sum())
        return ()

    def _collect_head(st, values, before):
        for v, inside in zip(values, before):
            if st["head"] and not inside:
                st["head_done"] = True
                return
            st["head"].append(v)

    def finish(st):
        closed = st["head_done"] or not st["inside"][0]
        head = b"\n".join(st["head"]) if st["head"] and closed else None
        yield _summary_row(st, [int(x) for x in st["inside"]], [0, 0],
                           [s for s in st["starts"] if s], [], head)

    return run_by_split(batches, begin, feed, finish)


def _summary_row(st, out, delta, starts, closes, head):
    info = st["info"]
    return pa.RecordBatch.from_pylist([{
        "file": info["file"], "block_start": info["block_start"],
        "block_length": info["block_length"], "file_size": info["file_size"],
        "first_seq": info["first_seq"], "n_pieces": st["pieces"], "n_bytes": st["bytes"],
        "out0": out[0], "out1": out[1], "delta0": delta[0], "delta1": delta[1],
        "starts": starts, "closes": closes, "head": head,
    }], schema=SUMMARY)


RECORDS = pa.schema([
    ("file", pa.string()), ("record_id", pa.int64()), ("byte_offset", pa.int64()),
    ("byte_len", pa.int64()), ("text", pa.string()), ("raw", pa.string()),
])
RECORDS_DDL = "file string, record_id long, byte_offset long, byte_len long, text string, raw string"


def _emit(file, ids, offs, lens, texts, raws):
    n = len(texts)
    return pa.RecordBatch.from_arrays([
        pa.array([file] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(offs, pa.int64()),
        pa.array(lens, pa.int64()), pa.array(texts, pa.string()), pa.array(raws, pa.string()),
    ], schema=RECORDS)


def assemble_csv(batches):
    def begin(info):
        head = info["head"]
        names = header_names(clean_record(head)) if head is not None else []
        return {"info": info, "make": object_maker(names), "inside": bool(info["entry_inside"]),
                "id": info["base_id"], "off": info["base_off"], "open": None, "open_off": 0}

    def feed(st, part):
        values = part.column("value").to_pylist()
        before, after = _states_before(list(_quoted_lines(values)), len(values), st["inside"])
        records, offs, lens = [], [], []

        def done():
            records.append(b"\n".join(st["open"]))
            offs.append(st["open_off"])
            lens.append(len(records[-1]) + 1)
            st["open"] = None

        for v, inside in zip(values, before):
            if not inside:
                if st["open"] is not None:
                    done()
                st["open"], st["open_off"] = [v], st["off"]
            elif st["open"] is not None:
                st["open"].append(v)
            st["off"] += len(v) + 1
        if not after and st["open"] is not None:
            done()
        st["inside"] = after
        if records:
            yield from _csv_batch(st, records, offs, lens)

    def _csv_batch(st, records, offs, lens):
        texts = [clean_record(r) for r in records]
        ids = list(range(st["id"], st["id"] + len(records)))
        st["id"] += len(records)
        make = st["make"]
        raws = [t if i == 0 else make(t) for i, t in zip(ids, texts)]
        info = st["info"]
        if ids[0] == 0 and info["bom"]:
            offs[0], lens[0] = 0, lens[0] + info["bom"]
        lens[-1] = min(lens[-1], info["file_size"] - offs[-1])
        yield _emit(info["file"], ids, offs, lens, texts, raws)

    # A record still open here continues in the next split: the fragment join completes it.
    return run_by_split(batches, begin, feed, lambda st: ())


def objects_from_lines(batches):
    """Same object form for records that were stitched together across splits."""
    for batch in batches:
        rows = batch.to_pylist()
        texts = [None if r["body"] is None else clean_record(r["body"]) for r in rows]
        raws = [
            t if t is None or r["record_id"] == 0
            else object_maker(header_names(clean_record(r["head"])))(t)
            for r, t in zip(rows, texts)
        ]
        yield pa.RecordBatch.from_arrays([
            batch.column("file"), batch.column("record_id"), batch.column("byte_offset"),
            batch.column("byte_len"), pa.array(texts, pa.string()), pa.array(raws, pa.string()),
        ], schema=RECORDS)


# --- JSON ----------------------------------------------------------------

def _quotes(buf):
    """Positions of unescaped quotes, as a mask (odd backslash runs escape)."""
    quote = buf == 0x22
    slash = buf == 0x5C
    if slash.any():
        # Of each backslash, the place where its run begins.
        at = np.flatnonzero(slash)
        opens = np.r_[True, np.diff(at) > 1]
        begin = at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        odd = at[(at - begin) % 2 == 0] + 1
        quote[odd[odd < len(buf)]] = False
    return quote


def _offsets(values):
    wide = np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], wide)[values.offset:values.offset + len(values) + 1].astype(np.int64)


def _lengths(values):
    return np.diff(_offsets(values))


def _packed(values):
    """Bytes of a binary column end to end, and each value's length plus a separator."""
    offs, data = _offsets(values), values.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offs[0]:offs[-1]], np.diff(offs) + 1


class _Piecewise:
    """Byte-level view of one run of pieces: structure under a given entry state."""

    def __init__(self, values, sep):
        data, self.lens = _packed(values)
        self.ends = np.cumsum(self.lens)
        self.begins = self.ends - self.lens
        self.buf = np.empty(self.ends[-1], np.uint8)
        body = np.ones(self.ends[-1], dtype=bool)
        body[self.ends - 1] = False
        self.buf[body] = data
        self.buf[self.ends - 1] = sep
        quote = _quotes(self.buf)
        self.flips = np.cumsum(quote, dtype=np.int32)
        self.flips_before = self.flips - quote
        self.delta = _DELTA[self.buf]
        self.blank = _IS_BLANK[self.buf]
        self.solid = {}

    def under(self, inside, depth):
        outside = ((self.flips_before + inside) & 1) == 0
        step = np.where(outside, self.delta, np.int8(0))
        after = np.cumsum(step, dtype=np.int32) + np.int32(depth)
        return outside, after - step, after

    def inside_after(self, inside):
        return int((self.flips[-1] + inside) & 1)

    def locate(self, pos):
        piece = int(np.searchsorted(self.ends, pos, side="right"))
        return piece, int(pos - self.begins[piece])

    def first_solid(self, skip_to=0):
        """Per piece: position of its first non-blank byte, or its end when blank."""
        if skip_to not in self.solid:
            solid = ~self.blank
            solid[self.ends - 1] = False
            solid[:skip_to] = False
            at = np.flatnonzero(solid)
            nth = np.searchsorted(at, self.begins)
            first = np.append(at, len(self.buf))[nth]
            self.solid[skip_to] = np.where(first < self.ends - 1, first, -1)
        return self.solid[skip_to]

    def element_starts(self, outside, before, root):
        """Text cut at commas: a piece begins an element if it is not inside one."""
        skip = 0
        if root is not None:
            skip = root + 1
        first = self.first_solid(skip)
        at = self.begins
        ok = (first >= 0) & outside[at]
        pos = first[ok]
        depth = before[at][ok]
        if root is not None and len(pos) and pos[0] < self.ends[0]:
            depth = depth.copy()
            depth[0] = 1
        keep = self.buf[pos] != 0x5D
        return pos[keep], depth[keep]

    def value_starts(self, outside, before):
        """First byte of every token, with the depth it stands at.

        Text cut at line breaks: no token goes on in the next line, so a token
        at the level of the records is where a record begins.
        """
        prev = np.empty(len(self.buf), dtype=np.uint8)
        prev[0] = 0x0A
        prev[1:] = self.buf[:-1]
        opener = (self.delta == 1) | (self.buf == 0x22)
        solid = ~self.blank & (self.buf != 0x2C) & (self.delta != -1)
        pos = np.flatnonzero(outside & solid & (opener | _ENDS_TOKEN[prev]))
        return pos, before[pos]


def _root_bracket(view):
    """Offset of a leading ``[`` when the text opens with one."""
    solid = np.flatnonzero(~view.blank[:-1])
    if len(solid) and view.buf[solid[0]] == 0x5B:
        return int(solid[0])
    return None


def summarise_json(sep):
    def run(batches):
        def begin(info):
            return {"info": info, "pieces": 0, "bytes": 0, "inside": [0, 1], "depth": [0, 0],
                    "starts": [{}, {}], "closes": [{}, {}], "head": None,
                    "lead": info["block_start"] == 0}

        def feed(st, part):
            view = _Piecewise(part.column("value"), sep[0])
            root = _root_bracket(view) if st["lead"] else None
            if st["lead"]:
                solid = np.flatnonzero(~view.blank)
                if len(solid) and not (len(solid) == 1 and solid[0] == len(view.buf) - 1):
                    st["head"] = bytes(view.buf[solid[0]:solid[0] + 1])
                    st["lead"] = False
            for h in (0, 1):
                outside, before, after = view.under(st["inside"][h], st["depth"][h])
                if sep == b",":
                    pos, rel = view.element_starts(outside, before, root if h == 0 else None)
                else:
                    pos, rel = view.value_starts(outside, before)
                _note_starts(st, h, view, pos, rel)
                _note_closes(st, h, view, outside, after)
                st["depth"][h] = int(after[-1])
                st["inside"][h] = view.inside_after(st["inside"][h])
            st["pieces"] += part.num_rows
            st["bytes"] += len(view.buf)
            return ()

        def finish(st):
            yield _summary_row(
                st, st["inside"], st["depth"],
                [s for h in (0, 1) for s in st["starts"][h].values()],
                [c for h in (0, 1) for c in st["closes"][h].values()], st["head"])

        return run_by_split(batches, begin, feed, finish)

    return run


def _note_starts(st, h, view, pos, rel):
    if not len(pos):
        return
    order = np.argsort(rel, kind="stable")
    levels, first, count = np.unique(rel[order], return_index=True, return_counts=True)
    for level, a, n in zip(levels.tolist(), first.tolist(), count.tolist()):
        lo, hi = int(pos[order[a]]), int(pos[order[a + n - 1]])
        piece, byte = view.locate(lo)
        seen = st["starts"][h].setdefault(level, {
            "inside": h, "rel": level, "n": 0, "first_piece": st["pieces"] + piece,
            "first_byte": byte, "first_off": st["bytes"] + lo})
        piece, byte = view.locate(hi)
        seen["n"] += n
        seen.update(last_piece=st["pieces"] + piece, last_byte=byte, last_off=st["bytes"] + hi)


def _note_closes(st, h, view, outside, after):
    """First place where the depth falls to each new low."""
    at = np.flatnonzero(outside & (view.delta == -1))
    if not len(at):
        return
    level = after[at]
    low = np.minimum.accumulate(level)
    fresh = np.flatnonzero(np.r_[True, low[1:] < low[:-1]])
    known = min(st["closes"][h], default=None)
    for i in fresh.tolist():
        rel = int(level[i])
        if known is None or rel < known:
            piece, byte = view.locate(int(at[i]))
            st["closes"][h][rel] = {"inside": h, "rel": rel, "piece": st["pieces"] + piece,
                                    "byte": byte, "off": st["bytes"] + int(at[i])}
            known = rel


def assemble_json(sep, array_file):
    level = 1 if array_file else 0
    strip = BLANK + b","

    def run(batches):
        def begin(info):
            return {"info": info, "inside": info["entry_inside"], "depth": info["entry_depth"],
                    "id": info["base_id"], "off": info["base_off"], "open": None, "open_off": 0,
                    "lead": info["block_start"] == 0, "over": bool(info["closed_before"])}

        def feed(st, part):
            if st["over"]:
                return
            view = _Piecewise(part.column("value"), sep[0])
            root = None
            if st["lead"]:
                root = _root_bracket(view) if sep == b"," else None
                st["lead"] = root is None and bool(view.blank[:-1].all())
            outside, before, after = view.under(st["inside"], st["depth"])
            if sep == b",":
                pos, depth = view.element_starts(outside, before, root)
            else:
                pos, depth = view.value_starts(outside, before)
            end = None
            if array_file:
                ends = np.flatnonzero(outside & (view.delta == -1) & (after == 0))
                end = int(ends[0]) if len(ends) else None
            pos = pos[depth == level]
            if end is not None:
                pos = pos[pos < end]
                st["over"] = True
            st["depth"], st["inside"] = int(after[-1]), view.inside_after(st["inside"])
            settled = st["over"] or (st["depth"] == level and not st["inside"])
            yield from _cut(st, view, pos.tolist(), end, settled)
            st["off"] += len(view.buf)

        def _cut(st, view, pos, end, settled):
            text = view.buf.tobytes()
            stop = len(text) if end is None else end
            bodies, offs = [], []

            def done(body, off):
                body = body.strip(strip)
                if body:
                    bodies.append(body)
                    offs.append(off)

            if st["open"] is not None:
                st["open"].append(text[:pos[0] if pos else stop])
                if pos or settled:
                    done(b"".join(st["open"]), st["open_off"])
                    st["open"] = None
            for k, a in enumerate(pos):
                if k + 1 < len(pos):
                    done(text[a:pos[k + 1]], st["off"] + a)
                elif settled:
                    done(text[a:stop], st["off"] + a)
                else:
                    st["open"], st["open_off"] = [text[a:stop]], st["off"] + a
            if bodies:
                ids = list(range(st["id"], st["id"] + len(bodies)))
                st["id"] += len(bodies)
                texts = [b.decode("utf-8", "replace") for b in bodies]
                yield _emit(st["info"]["file"], ids, offs, [len(b) for b in bodies], texts, texts)

        return run_by_split(batches, begin, feed, lambda st: ())

    return run


# --- JSONL locations -------------------------------------------------------

def add_byte_position(batches):
    """Running byte position of each line inside its split, in scan order."""
    run = 0
    for batch in batches:
        lens = batch.column("line_bytes").to_numpy().astype(np.int64)
        new = np.asarray(batch.column("opens_split").to_numpy(zero_copy_only=False), dtype=bool)
        excl = np.cumsum(lens) - lens + run
        base = np.maximum.accumulate(np.where(new, excl, 0))
        rel = excl - base
        if len(lens):
            run = int(rel[-1] + lens[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(rel, pa.int64())], names=[*batch.schema.names, "rel_off"])
