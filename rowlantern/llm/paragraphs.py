"""Removal of passages that repeat across documents: paragraph MinHash banding.

A paragraph is a line of at least 24 words, or a part between blank lines whose
lines are all shorter.  Paragraphs that share a band of minwise tokens of their
five-word shingles are joined, similarity is verified on the full shingle sets,
and components of alike paragraphs are removed everywhere but in the document of
the smallest id.  Seven bands of two tokens miss a pair at 0.8 with a chance of
8e-4; paragraphs equal in all words are found by name, always.

Passages inside paragraphs repeat word for word: seeds of 16 words start where
the text itself chooses (the smallest hash of four words among 24 places,
rightmost of equal ones), so a passage is cut alike wherever it stands, and
every passage of 39 words holds a whole seed.  A repeated seed grows to both
sides, word by word, as far as the document that keeps it goes on with the same
words; what then has 24 words goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlantern.llm import shingles as sh
from rowlantern.llm.chosen_path import TOKENS, NodeJoin, few
from rowlantern.llm.tables import lean, store

#: Words of a paragraph, and of what is removed, at least.
WORDS = 24
SEED, SPREAD, ANCHOR, SHINGLE = 16, 24, 4, 5
#: Words next to a run that are compared: a longer repeat holds one more whole seed.
REACH = SPREAD
#: Two paragraphs at s meet in a band with a chance of s ** ROWS.
BANDS, ROWS = 7, 2
#: Words that are worked on at once, and bytes of text; a longer word or paragraph is a piece of its own.
CHUNK_WORDS, CHUNK_BYTES = 1 << 16, 1 << 20
# 16 bytes a name, some 100 MB as a hash table.
BROADCAST_NAMES = 2_000_000
# Some 300 bytes each.
BROADCAST_SIDES = 300_000
LARGEST = (1 << 63) - 1
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("name", pa.int64()),
                   ("bands", pa.list_(pa.int64()))])
PIECE_SQL = "doc_id long, start int, words int, name long, bands array<long>"


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = sh.mixed(out * sh.STEP + words[k:len(words) - size + 1 + k])
    return out


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the number of line breaks before each and their first bytes, a slice of bytes at a time."""
    raw = np.frombuffer(data, np.uint8)
    hashes, breaks, places, at, lines = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
    while at < len(raw):
        end = at + CHUNK_BYTES
        if end < len(raw):
            gap = sh.GAPS[raw[end:end + CHUNK_BYTES]]
            while not gap.any() and end + len(gap) < len(raw):  # inside a very long word
                gap = sh.GAPS[raw[end:end + 2 * len(gap)]]
            end = end + int(gap.argmax()) if gap.any() else len(raw)
        part = raw[at:end]
        gap = sh.GAPS[part]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        ends = np.flatnonzero(part == 10)
        hashes.append(sh.word_hashes(data[at:end]))
        breaks.append(lines + np.searchsorted(ends, starts))
        places.append(at + starts)
        lines, at = lines + len(ends), max(end, at + 1)
    return np.concatenate(hashes), np.concatenate(breaks), np.concatenate(places)


def read_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and the number of line breaks before each."""
    return _read((text or "").encode())[:2]


def _texts(batches: Iterator[pa.RecordBatch], text: int):
    """Rows of some texts, their words and line breaks as one array each, and the bounds of each text in them.

    Texts are parted by blank lines, so no paragraph is in two; a long text is alone.
    """
    def read(held, texts):
        words, breaks, places = _read(b"\n\n".join(texts))
        ends = np.cumsum([len(t) + 2 for t in texts])
        return held, words, breaks, np.concatenate([[0], np.searchsorted(places, ends)])

    held, texts, size = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != text]
        for *row, value in zip(*others, batch.column(text)):
            data = (value.as_py() or "").encode()
            if texts and size + len(data) > CHUNK_BYTES // 2:
                yield read(held, texts)
                held, texts, size = [], [], 0
            held.append(row)
            texts.append(data)
            size += len(data)
    if texts:
        yield read(held, texts)


def seed_starts(words: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """First words of the seeds of texts (one text without ``bounds``); none in those shorter than a seed."""
    bounds = np.array([0, len(words)]) if bounds is None else bounds
    if len(words) < SEED:
        return np.empty(0, np.int64)
    # 32 bits of hash, and the smaller number for the later word: the least is the rightmost of equal hashes.
    key = _runs(words, ANCHOR)
    low = np.uint64(0xFFFFFFFF)
    key = (key & ~low) | (low - np.arange(len(key), dtype=np.uint64))
    least, width = key, 1
    while 2 * width <= SPREAD:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:len(least) - (SPREAD - width)], least[SPREAD - width:])
    size = np.diff(bounds)
    # Windows whose seeds lie in one text.
    inside = np.repeat(bounds[1:], size) - np.arange(len(words)) >= SPREAD - 1 + SEED
    chosen = [least[np.flatnonzero(inside[:len(least)])]]
    for i in np.flatnonzero((size >= SEED) & (size < SPREAD - 1 + SEED)):
        chosen.append(key[bounds[i]:bounds[i + 1] - SEED + 1].min(keepdims=True))
    return np.unique((low - (np.concatenate(chosen) & low)).astype(np.int64))


def seed_names(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of all words of each seed, from the shingles that cover it."""
    name = np.zeros(len(starts), np.uint64)
    for k in (*range(0, SEED - SHINGLE, SHINGLE), SEED - SHINGLE):
        name = sh.mixed(name * sh.STEP + grams[starts + k])
    return name


def paragraph_spans(breaks: np.ndarray) -> np.ndarray:
    """(first word, word behind the last) of every paragraph of a text."""
    if not len(breaks):
        return np.empty((0, 2), np.int64)
    step = np.diff(breaks)
    lines = np.concatenate([[0], np.flatnonzero(step > 0) + 1, [len(breaks)]])
    blocks = np.concatenate([[0], np.flatnonzero(step > 1) + 1, [len(breaks)]])
    sizes = np.diff(lines)
    longest = np.maximum.reduceat(sizes, np.searchsorted(lines, blocks[:-1]))
    some, wrapped = sizes >= WORDS, (longest < WORDS) & (np.diff(blocks) >= WORDS)
    spans = np.concatenate([np.stack([lines[:-1], lines[1:]], 1)[some], np.stack([blocks[:-1], blocks[1:]], 1)[wrapped]])
    return spans[np.argsort(spans[:, 0], kind="stable")]


def paragraph_names(words: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """A hash of all words of each paragraph; never that of a seed but by chance."""
    if not len(spans):
        return np.empty(0, np.uint64)
    size, edges = spans[:, 1] - spans[:, 0], np.append(spans.ravel()[:-1], spans[-1, 1]) - spans[0, 0]
    part = words[spans[0, 0]:spans[-1, 1]]
    place = np.arange(spans[0, 0], spans[-1, 1])
    place -= np.repeat(np.concatenate([[spans[0, 0]], spans[:, 0][1:]]), np.diff(np.append(edges[::2], len(part))))
    each = sh.mixed(part + place.astype(np.uint64) * sh.STEP)
    return sh.mixed(np.add.reduceat(each, edges[:-1])[::2] + size.astype(np.uint64) + sh.MIX[0])


def paragraph_bands(grams: np.ndarray, spans: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One row of band hashes for each paragraph; ``grams`` are the shingles of all words."""
    bands = np.empty((len(spans), BANDS), np.uint64)
    # Shingles inside a paragraph, then those across its end, which are left out.
    edges = np.stack([spans[:, 0], spans[:, 1] - SHINGLE + 1], 1).ravel()
    first = 0
    while first < len(spans):
        last = max(first + 1, int(np.searchsorted(spans[:, 1], spans[first, 0] + CHUNK_WORDS)))
        low, high = spans[first, 0], spans[last - 1, 1] - SHINGLE + 1
        part, cuts = grams[low:high], edges[2 * first:2 * last - 1] - low
        for k in range(BANDS):
            band = np.full(last - first, k + 1, np.uint64)
            for seed in seeds[k * ROWS:(k + 1) * ROWS]:
                token = part * seed
                token ^= token >> np.uint64(29)
                token *= sh.MIX[1]
                band = sh.mixed(band * sh.STEP + np.minimum.reduceat(token, cuts)[::2])
            bands[first:last, k] = band
        first = last
    return bands


def _cut(batches: Iterator[pa.RecordBatch]):
    """(doc_id, text) to its seeds, without bands, and its paragraphs."""
    seeds = sh.seeds_of(BANDS * ROWS)
    with np.errstate(over="ignore"):
        for held, words, breaks, bounds in _texts(batches, 1):
            grams, spans, starts = _runs(words, SHINGLE), paragraph_spans(breaks), seed_starts(words, bounds)
            at = np.concatenate([starts, spans[:, 0]])
            who = np.searchsorted(bounds, at, side="right") - 1
            ids = [row[0] for row in held]
            missing = np.array([i is None for i in ids], bool)
            ids = np.array([i or 0 for i in ids], np.int64)
            names = np.concatenate([seed_names(grams, starts), paragraph_names(words, spans)])
            none = np.concatenate([np.ones(len(starts), bool), np.zeros(len(spans) + 1, bool)])
            ends = np.concatenate([np.zeros(len(starts)), np.arange(len(spans) + 1) * BANDS]).astype(np.int32)
            bands = pa.array(paragraph_bands(grams, spans, seeds).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[who], pa.int64(), mask=missing[who]), pa.array((at - bounds[who]).astype(np.int32)),
                pa.array(np.concatenate([np.full(len(starts), SEED), spans[:, 1] - spans[:, 0]]).astype(np.int32)),
                pa.array(names.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, mask=none), bands)], schema=PIECE)


def _batch(schema: pa.Schema, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _tokens(batches: Iterator[pa.RecordBatch]):
    """(text, places: [(start, words, name)]) to the sets of those paragraphs."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("sign", pa.binary()), ("tokens", pa.binary())])
    seeds = sh.seeds_of(TOKENS)
    with np.errstate(over="ignore"):
        for batch in batches:
            rows, held = [], 0
            for text, places in zip(batch.column(0), batch.column(1).to_pylist()):
                words, _ = read_words(text.as_py())
                grams = _runs(words, SHINGLE)
                for p in places:
                    span = np.array([[p["start"], p["start"] + p["words"]]])
                    # Another text under the same id has other words at these places.
                    if span[0, 1] > len(words) or int(paragraph_names(words, span).view(np.int64)[0]) != p["name"]:
                        continue
                    tokens = np.unique(grams[span[0, 0]:span[0, 1] - SHINGLE + 1])
                    rows.append((p["name"], len(tokens), sh.minwise(tokens, seeds).tobytes(), tokens.tobytes()))
                    held += len(tokens)
                if held >= 4 * CHUNK_WORDS:
                    yield _batch(schema, rows)
                    rows, held = [], 0
            yield _batch(schema, rows)


def _some(names: DataFrame) -> DataFrame:
    """With a broadcast hint if these rows of fixed size are counted to be few."""
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def _alike_paragraphs(rows: DataFrame, cut: DataFrame, shared: DataFrame, percent: int, leaf: int,
                      depth: int) -> DataFrame | None:
    """(name, c) of the paragraphs that are alike to one with other words; None if there is none.

    ``shared`` has the names of equal pieces with the document that keeps them, which stands for all.
    """
    single = cut.where("bands is not null").join(_some(shared), "name", "left").where(
        "keeper is null or doc = keeper").select("doc_id", "start", "words", "name", "bands")
    banded = single.select("name", F.explode("bands").alias("node"))
    mixed = store(banded.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "bands")
    nodes = single.select("doc_id", "start", "words", "name", F.posexplode("bands").alias("tree", "node")).join(
        _some(mixed), "node")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "words")
    nodes = store(nodes.groupBy("tree", "node", F.col("name").alias("cid")).agg(F.min(at).alias("at")), "members")
    several = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    several = store(several, "mixed")
    nodes = nodes.join(_some(several), "node")
    places = nodes.groupBy("cid").agg(F.min("at").alias("at")).groupBy(F.col("at.doc_id").alias("own")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.words").alias("words"),
                                F.col("cid").alias("name"))).alias("places"))
    places = store(places, "places")
    texts = rows.join(few(places, "places"), rows["doc_id"].eqNullSafe(F.col("own"))).select("text", "places")
    sets = store(texts.mapInArrow(lean(_tokens), "cid long, n long, sign binary, tokens binary"), "sets")
    counts = sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cid").alias("cids")).first()
    if counts["n"] > counts["cids"]:  # repeated rows
        sets = store(sets.dropDuplicates(["cid"]), "sets")
    join = NodeJoin(percent, leaf, depth)
    comp = join.connect(nodes.select("tree", "node", "cid"), sets.select("cid", "n", "sign"), lambda _: sets)
    return None if comp is None else comp.select(F.col("v").alias("name"), "c")


def repeated_passages(docs: DataFrame, percent: int = 80, leaf: int = 64, depth: int = 3, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, first_doc_id, start, words): runs of words to remove, and where they stay.

    ``start`` counts words (A-Z lower-cased, parted by white space) from 0.  A run
    is a union of overlapping or adjoining paragraphs and word-for-word repeats
    of at least 24 words that also stand in documents of smaller ids, of which
    ``first_doc_id`` is the smallest.  Repeats within one id, passages under 24 words, null, empty and short texts
    give no rows; repeated rows have one id and so are no repeats of each other;
    a null id counts as larger than any; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = store(rows.mapInArrow(lean(_cut), PIECE_SQL), "pieces").withColumn("doc", F.coalesce("doc_id", F.lit(LARGEST)))
    shared = store(cut.groupBy("name").agg(F.min("doc").alias("keeper"), F.max("doc").alias("largest")).where(
        "keeper < largest").select("name", "keeper"), "shared")
    held = store(cut.join(_some(shared), "name").select(
        "doc_id", "start", "words", "name", F.col("keeper").alias("first_doc_id"),
        (F.col("doc") == F.col("keeper")).alias("stays"), F.col("bands").isNull().alias("seed")), "held")
    end = (F.col("start") + F.col("words")).alias("end")
    gone = held.where("not stays").select("doc_id", "first_doc_id", "start", end, "name", "seed")
    spans = gone.where("not seed").drop("name", "seed")
    near = _alike_paragraphs(rows, cut, shared, percent, leaf, depth)
    if near is not None:
        # Every name of a component, with the smallest document that holds one of its paragraphs.
        own = cut.where("bands is not null").join(_some(near), "name").select("doc_id", "doc", "start", "words", "c")
        own = store(own, "alike")
        keeps = own.groupBy("c").agg(F.min("doc").alias("first_doc_id"))
        spans = spans.unionByName(own.join(_some(store(keeps, "keeps")), "c").where("doc <> first_doc_id").select(
            "doc_id", "first_doc_id", "start", end))
    runs = store(_merged(gone.where("seed").drop("seed"), F.min(F.struct("start", "name")).alias("head"),
                         F.max(F.struct("start", "name")).alias("tail")), "runs")
    grown = store(_merged(runs.select("doc_id", "first_doc_id", "start", "end").unionByName(
        _longer(rows, runs, held.where("seed and stays").select("doc_id", "start", "name").distinct()))), "grown")
    size = F.col("end") - F.col("start")
    return _merged(grown.where(size >= WORDS).unionByName(spans)).select(
        "doc_id", "first_doc_id", F.col("start").cast("long").alias("start"), size.cast("long").alias("words"))


def _merged(spans: DataFrame, *more: Column) -> DataFrame:
    """Overlapping or adjoining spans (start, end) of a document as one run."""
    here = Window.partitionBy("doc_id").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = spans.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(here))
    return runs.groupBy("doc_id", "run").agg(
        F.min("first_doc_id").alias("first_doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        *more).drop("run")


def _sides(batches: Iterator[pa.RecordBatch]):
    """(doc_id, text, places) to the words at one side of each place: those next to the seed, 32 bits each."""
    schema = pa.schema([("doc_id", pa.int64()), ("stays", pa.bool_()), ("side", pa.int32()), ("start", pa.int32()),
                        ("name", pa.int64()), ("near", pa.binary())])
    out = np.arange(REACH)
    with np.errstate(over="ignore"):
        for held, words, _, bounds in _texts(batches, 1):
            grams = _runs(words, SHINGLE)
            counts = [len(places) for _, places in held]
            who, ids = np.repeat(np.arange(len(held)), counts), [doc_id for doc_id, _ in held]
            start, name, side, stays = (np.array([p[k] for _, places in held for p in places], t) for k, t in (
                ("start", np.int64), ("name", np.int64), ("side", np.int32), ("stays", bool)))
            # Another text under the same id has other words at this place.
            fits = start + SEED <= (bounds[1:] - bounds[:-1])[who]
            fits[fits] = seed_names(grams, (start + bounds[who])[fits]).view(np.int64) == name[fits]
            who, start, name, side, stays = who[fits], start[fits], name[fits], side[fits], stays[fits]
            for a in range(0, len(who), CHUNK_WORDS // 4):
                few_ = slice(a, a + CHUNK_WORDS // 4)
                low, high, first = bounds[who[few_], None], bounds[who[few_] + 1, None], start[few_, None] + bounds[who[few_], None]
                at = np.where(side[few_, None] == 1, first + SEED + out, first - 1 - out)
                there = (at >= low) & (at < high)
                near = (words[np.where(there, at, low)] >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
                near = np.where(there, near, stays[few_, None].astype(np.uint32))  # no word equals what is beyond the text
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in who[few_].tolist()], pa.int64()), pa.array(stays[few_]), pa.array(side[few_]),
                    pa.array(start[few_].astype(np.int32)), pa.array(name[few_]),
                    pa.array([x.tobytes() for x in near], pa.binary())], schema=schema)


def _reach(batches: Iterator[pa.RecordBatch]):
    """(doc_id, first_doc_id, side, start, near, theirs) to the span of the seed and the same words next to it."""
    schema = pa.schema([("doc_id", pa.int64()), ("first_doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows = []
        for doc_id, first, side, start, near, theirs in zip(*(c.to_pylist() for c in batch.columns)):
            same = np.frombuffer(b"".join(theirs), np.uint32).reshape(len(theirs), -1) == np.frombuffer(near, np.uint32)
            more = int(np.logical_and.accumulate(same, axis=1).sum(axis=1).max())
            if more:
                rows.append((doc_id, first, start - (0 if side else more), start + SEED + (more if side else 0)))
        yield _batch(schema, rows)


def _longer(rows: DataFrame, runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, start, end): the outer seeds of runs with the words that go on alike where they stay.

    ``kept`` has the places (doc_id, start, name) of repeated seeds in the documents that keep them.
    """
    def place(stays, side, of):
        return F.struct(F.lit(stays).alias("stays"), F.lit(side).alias("side"), *[
            F.col(f"{of}{c}").alias(c) for c in ("start", "name")])

    asked = runs.select("doc_id", F.explode(F.array(place(False, 0, "head."), place(False, 1, "tail."))).alias("at"))
    wanted = store(asked.select("at.name").distinct(), "wanted")
    known = kept.join(_some(wanted), "name").select(
        "doc_id", F.explode(F.array(place(True, 0, ""), place(True, 1, ""))).alias("at"))
    places = store(asked.unionByName(known).groupBy(F.col("doc_id").alias("own")).agg(
        F.collect_list("at").alias("places")), "edges")
    texts = rows.join(few(places, "places"), rows["doc_id"].eqNullSafe(F.col("own"))).select("own", "text", "places")
    sides = store(texts.mapInArrow(
        lean(_sides), "doc_id long, stays boolean, side int, start int, name long, near binary"), "sides")
    # One row for each seed and side, whatever the number of its repeats.
    theirs = sides.where("stays").groupBy("name", "side").agg(
        F.first("doc_id").alias("first_doc_id"), F.collect_set("near").alias("theirs"))
    theirs = store(theirs, "theirs")
    rows_of = theirs.agg(F.sum(F.size("theirs"))).first()[0] or 0
    theirs = F.broadcast(theirs) if rows_of <= BROADCAST_SIDES else theirs
    pairs = sides.where("not stays").join(theirs, ["name", "side"]).select(
        "doc_id", "first_doc_id", "side", "start", "near", "theirs")
    return pairs.mapInArrow(lean(_reach), "doc_id long, first_doc_id long, start int, end int")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs; the white space before each goes with it."""
    data, spans = text.encode(), [m.span() for m in WORD.finditer(text.encode())]
    kept, at = [], 0
    for start, words in sorted(runs):
        if start >= len(spans):
            continue
        begin = spans[start - 1][1] if start else 0
        kept.append(data[at:max(at, begin)])
        at = max(at, spans[min(start + words, len(spans)) - 1][1])
    kept.append(data[at:])
    return b"".join(kept).decode().strip()


def _apply(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = [without(t or "", [(r["start"], r["words"]) for r in runs])
                 for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "rest"])


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                  **options) -> DataFrame:
    """``docs`` with all columns and without repeated passages (see ``repeated_passages``).

    ``length_col`` takes the new number of characters.  A document of which
    nothing is left goes; documents without a repeat are passed on untouched.
    """
    runs = repeated_passages(docs, id_col=id_col, text_col=text_col, **options)
    runs = store(runs.groupBy(F.col("doc_id").alias("own")).agg(
        F.collect_list(F.struct("start", "words")).alias("runs")), "runs")
    on = docs[id_col].cast("long").eqNullSafe(F.col("own"))
    clean = docs.join(few(runs.select("own")), on, "left_anti")
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    touched = docs.join(few(runs, "runs"), on).select(rows, F.col(text_col).alias("text"), "runs")
    cut = touched.mapInArrow(lean(_apply), f"row {docs.schema.simpleString()}, rest string").where("rest <> ''")
    put = {text_col: F.col("rest")} | ({length_col: F.length("rest").cast(docs.schema[length_col].dataType)}
                                       if length_col else {})
    return clean.unionByName(cut.select(*[put[c].alias(c) if c in put else F.col("row").getField(c).alias(c)
                                          for c in docs.columns]))
