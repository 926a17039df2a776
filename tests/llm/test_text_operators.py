"""BPE, language, fingerprints, packing, toxicity: against brute force, round trips and held-out rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowlantern.llm import bpe, byte_gru, packing, toxicity, winnowing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "A b", "naïve  café\t", "x" * 30_000, "1234 'll ½ 中文 😀\u0301", "the same", "the same",
       " lead and trail ", "e\u0301 É.,", "Ǆ İ. Σς,", "tab\tand\x1cseparator\x85"]


def docs(spark, texts=ODD, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)] + ([(9, "the same"), (None, "no id")] if texts else [])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "score", "part", "n", "ids", "task", "lang", "id") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, part int")


# --- byte-level BPE ---------------------------------------------------------

@pytest.fixture(scope="module")
def coder():
    return bpe.TextCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def oracle(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks,
                             special_tokens={})


def test_bpe_equals_the_library(spark, coder, oracle):
    got = bpe.digests(docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = oracle.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_random_text_and_appends(coder, oracle):
    rng, letters = random.Random(3), "ab  \n\t\x1c\x85 é中'sd9½😀.,!"
    for _ in range(2000):
        text, more = ("".join(rng.choices(letters, k=rng.randrange(n))) for n in (30, 9))
        assert coder.encode(text) == oracle.encode_ordinary(text)
        assert coder.append(text, coder.encode(text), more) == oracle.encode_ordinary(text + more)


def test_prefix_state_after_edits(coder):
    rng = random.Random(4)
    for _ in range(200):
        data = "".join(rng.choices("theraning in of", k=rng.randrange(400))).encode()
        state = bpe.PrefixEncoding(coder.vocabulary, data)
        a = rng.randrange(len(data) + 1)
        b, new = rng.randrange(a, len(data) + 1), b"xthe"[:rng.randrange(5)]
        state.edit(a, b, new)
        state.append(b"ing")
        assert state.ids() == coder.vocabulary.merged(data[:a] + new + data[b:] + b"ing")


# --- language ---------------------------------------------------------------

def test_gradients_match_differences():
    model = byte_gru.ByteGRU(["a", "b", "c"], 4)
    data = np.random.default_rng(0).integers(0, 256, (6, 5)).astype(np.uint8)
    target = np.array([0, 1, 2, 0, 1])
    _, grad = model.gradients(data, target)
    for name, values in model.p.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), values.shape)
        values[at] += 1e-2
        up = model.gradients(data, target)[0]
        values[at] -= 2e-2
        down = model.gradients(data, target)[0]
        values[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[name][at]) < 1e-3


def test_language_of_held_out_rows(spark):
    rng = random.Random(5)
    said = {"aa": "lorem dolor sit amet", "bb": "kitz wurz schnee bach"}
    rows = [(i, " ".join(rng.choices(said[lang].split(), k=12)), lang)
            for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(200, None, "aa"), (201, "1 2 3 !!", None), (202, "", "bb"), (203, "lorem dolor " * 9000, None),
             (None, "kitz wurz schnee", "bb"), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = byte_gru.identify(df, steps=60).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows[:120])
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by_id[203].lang_pred == "aa" and by_id[None].lang_pred == "bb" and not by_id[None].held_out
    kept = byte_gru.keep_identified(df, steps=60)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_every_language_is_learned(spark):
    # 40 labels, each with a letter of its own; the last has the fewest rows.
    said = {f"l{k:02}": chr(0x4E00 + 97 * k) + chr(0x4E01 + 97 * k) for k in range(40)}
    rows = [(lang, f"{word} " * 20) for k, (lang, word) in enumerate(said.items()) for _ in range(50 - k)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert byte_gru.fit(df, steps=1).labels == sorted(said)
    assert byte_gru.fit(df, per_language=4, languages=2, steps=1).labels == sorted(said)


def test_language_without_labels(spark):
    df = docs(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in byte_gru.identify(df).collect()} == {("und", 0.0)}
    assert byte_gru.identify(empty(spark)).count() == 0


# --- fingerprints -----------------------------------------------------------

def hash_long(value, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(struct.pack("<q", value), seed=seed & (1 << 64) - 1)
                                           .intdigest()))[0]


def winnowed(text):
    """(position, 32-bit hash) by the definition."""
    tokens, word = [], ""
    for c in (text or "") + " ":
        if c in "\x20\x09\x0A\x0B\x0C\x0D":
            tokens += list(word) if len(word) > 24 else [word] if word else []
            word = ""
        else:
            word += c
    ones = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(t.encode(), seed=42).intdigest()))[0] for t in tokens]

    def folded(run):
        h = 42
        for x in run:
            h = hash_long(x, h)
        return h

    grams = [folded(ones[i:i + 4]) for i in range(len(ones) - 3)] if len(ones) >= 4 else [folded(ones)] if ones else []
    grams = [(g & (1 << 64) - 1) >> 32 for g in grams]
    kept = set()
    for i in range(max(1, len(grams) - 7) if grams else 0):
        window = [(j, grams[j]) for j in range(i, min(i + 8, len(grams)))]
        kept.add(min(window, key=lambda p: (p[1], -p[0])))
    return sorted(kept)


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_equals_the_definition(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices(["aa", "bb", "cc", "dd ee", "ff\n"], k=rng.randrange(60))) for _ in range(30)]
    df = docs(spark, texts)
    got = winnowing.neighbours(df).collect()
    assert len(got) == len(texts) + 2
    of = {None: "no id", **{i: t or "" for i, t in enumerate(texts)}}
    ids = [*sorted((i for i in of if i is not None), reverse=True), None]
    for r in got:
        text, after = of[r.doc_id], of[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for shown, value in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert [(int(p), int(h, 16)) for p, h in (x.split(":") for x in shown.split())] == winnowed(value)
        assert r.near_edited == pytest.approx(likeness(winnowed(text), winnowed(edited)))
        assert r.near_next == pytest.approx(likeness(winnowed(text), winnowed(after)))
    assert winnowing.neighbours(empty(spark)).count() == 0
    lone = winnowing.neighbours(docs(spark, ["only one text here, twice"], extra=False).where("doc_id = 0")).first()
    assert lone.near_next == 1.0


def test_shifted_passage_without_spaces_keeps_its_fingerprints(spark):
    """Whatever stands before a shared passage, its grams are the same."""
    rng = random.Random(66)
    passage = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    coded = "".join(rng.choices("ABCDEFGHIJabcdefghij0123456789+/\U0001F600", k=300))
    texts = [f"{front}{body}{back}" for body in (passage, coded) for front, back in (
        ("", ""), ("x", ""), ("yz" * 20, "\u4E00w"), ("a b ", " c"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = winnowing.with_fingerprint(rows, "text", "p").select("doc_id", winnowing.hashes(F.col("p")).alias("h")).collect()
    prints = {r.doc_id: set(r.h) for r in got}
    for first in (0, 4):
        for other in range(first + 1, first + 4):
            # All windows inside the passage choose alike.
            assert len(prints[first] & prints[other]) >= 0.9 * len(prints[first])
    assert not prints[0] & prints[4]


# --- packing ----------------------------------------------------------------

def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    df = docs(spark)
    got = packing.pack(df, WORDS, size=64, windows=3, merge=2).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            for i, t in [*enumerate(ODD), (None, "no id")]}
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want)
    for i, rows in pieces.items():
        copies = 2 if i == 9 else 1
        assert sum(r.length for r in rows) == copies * len(want[i])
        for r in rows:
            part = want[i][r.start:r.start + r.length]
            assert r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        if copies == 1:
            assert sorted(x for r in rows for x in range(r.start, r.start + r.length)) == list(range(len(want[i])))
    held: dict = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        total = sum(n for _, n in spans)
        assert total <= 64 and total & (total - 1) == 0
    assert packing.pack(empty(spark), WORDS).count() == 0


MARKS = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|>, <|ENDOFTEXT|> <|endoftext|", "X<|endoftext|>. <|endoftext|>É,",
         "\t<|endoftext|>\t<|endoftext|>\n", "Wörter É. Ünd, ÀB, a. B, c.. ,. 1. x, ?, don't. \u0130. ﬁ."]


def test_word_coder_equals_the_default_call():
    tokenizer, own, rng = Tokenizer.from_file(WORDS), packing.WordCoder(WORDS), random.Random(9)
    pieces = [" ", "\n", "\t", ".", ",", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "A", "bc", "É", "中", "7", "'s", "ß", "\u0301"]
    for text in [*MARKS, *["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(4000)]]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(own.encode(text), "<u4")) == want, text


def test_packing_fills_best_and_emits_the_fullest():
    """Every step against the rule, read off a plain list of windows."""
    rng = random.Random(10)
    packer, windows = packing.Packer(32, 3), []
    for k in range(2000):
        n = rng.randrange(1, 33)
        out = [sum(map(len, held)) for held in packer.add(packing.Piece(k, 0, bytes(4 * n), n))]
        fits = [w for w in windows if w + n <= 32]
        want = []
        if fits:
            windows.remove(max(fits))
            windows.append(max(fits) + n)
        elif len(windows) < 3:
            windows.append(n)
        else:
            full = max(windows)
            windows.remove(full)
            want, rest = [32], n - (32 - full)
            fits = [w for w in windows if w + rest <= 32]
            if fits:
                windows.remove(max(fits))
            windows.append(max(fits, default=0) + rest)
        want += [32] * windows.count(32)
        windows = [w for w in windows if w < 32]
        assert out == want and sorted(u for u, _ in packer.open) == sorted(windows)


# --- toxicity ---------------------------------------------------------------

def test_toxicity_of_held_out_rows(spark):
    rng, words = random.Random(7), "morning river walking under quiet trees along some green paths".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=rng.randrange(1, 60)) + (["you", rng.choice(["idiot", "zorgmuk!!", "S.C.U.M"])] * bad))
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "quiet " * 50_000), (None, "green trees"), (5, rows[5][1])]
    labels += [(None, 1), (3, None), (2000, 1), (1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert tested and all(r.predicted == (r.doc_id % 4 == 0) for r in tested)
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000} == {0}
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(1 for r in got if r.score < 0.5)


def test_toxicity_without_both_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs(spark), none).collect()} == {0.0}
    assert toxicity.score(empty(spark), none).count() == 0


def test_isotonic_steps_rise():
    rng = np.random.default_rng(8)
    margin = rng.normal(size=500)
    at, rate = toxicity.isotonic(margin, (rng.random(500) < 1 / (1 + np.exp(-2 * margin))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= -1e-2).all()


def test_stages_keep_documents_without_labels(spark):
    df = spark.createDataFrame([(i, f"some words {i}", None) for i in range(20)], "doc_id long, text string, lang string")
    assert byte_gru.keep_identified(df).count() == 20
    for label in (1, 0):
        labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, toxic int")
        assert toxicity.keep_clean(df, labels).count() == 20
    assert toxicity.keep_clean(df, labels.where("false")).count() == 20
