"""Repeated byte strings: against brute force over every place."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlantern.llm import repeats
from tests.llm.test_text_operators import empty


def slow(texts):
    """(n_bytes, n_removed, n_spans, kept) of every text."""
    data = [(t or "").encode() for t in texts]
    n = repeats.LENGTH
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int(np.count_nonzero(np.diff(np.append(False, gone).astype(int)) == 1)), kept))
    return out


def check(spark, texts, ids=None):
    rows = [(i, k, t) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    df = spark.createDataFrame(rows, "doc_id long, k long, text string")
    for name in ("mark", "pos", "anchor", "own", "spans", "node", "low", "count"):
        df = df.withColumn(name, F.lit("clash"))
    found = repeats.repeated_bytes(df.repartition(3))
    got = [tuple(r) for r in repeats.digests(found).collect()]
    want = [(r[0], *w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, slow(texts))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return sum(w[2] for w in want)


def some_words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gämma", "delta", "epsilon", "z"]) + str(rng.randrange(900)) for _ in range(n))


def mixed_texts(rng):
    """Passages of about the length in question, in many surroundings, cut and changed at every place."""
    shared = [some_words(rng, 60) for _ in range(4)]
    texts = [None, "", " ", "short", "x" * 199, "x" * 200, "y" * 201, "z" * 1500, "ab" * 300, "no id"]
    for _ in range(60):
        text = some_words(rng, rng.randrange(30))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            s = s[a:a + rng.choice([150, 195, 199, 200, 201, 205, 260, 400])]
            if rng.random() < 0.3:
                s = s[:len(s) // 2] + "#" + s[len(s) // 2 + 1:]
            text += s + rng.choice(["", " ", some_words(rng, 5)])
        texts.append(text)
    return texts + texts[12:20] + [texts[15] + "!", "?" + texts[16]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_brute_force(spark, seed):
    texts = mixed_texts(random.Random(seed))
    ids = [None if t == "no id" else 7 if k % 31 == 3 else k for k, t in enumerate(texts)]
    assert check(spark, texts, ids) > 30


def test_one_anchor_with_many_surroundings(spark, monkeypatch):
    """A passage in more documents than a node may hold is split, with equal results."""
    monkeypatch.setattr(repeats, "NODE", 5)
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    passage = some_words(rng, 40)
    texts = [some_words(rng, 8) + passage[rng.randrange(40):len(passage) - rng.randrange(80)] + some_words(rng, 8)
             for _ in range(60)]
    assert check(spark, texts + texts[:5] + [None]) >= 60


def test_long_text_over_several_steps(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 512)
    rng = random.Random(4)
    long = some_words(rng, 700)
    assert check(spark, [long, long[1000:3000], long[2000:2500] + "é" * 400 + long[100:400]]) >= 4


def test_anchors_lie_in_every_string():
    raw = np.frombuffer(some_words(random.Random(5), 400).encode(), np.uint8)
    at, hashes = repeats.Rolling().anchors(raw)
    for i in range(len(raw) - repeats.LENGTH + 1):
        assert np.any((at >= i) & (at + repeats.ANCHOR <= i + repeats.LENGTH))
    assert len(np.unique(hashes)) == len(at)


def test_column_wise_order():
    rng = np.random.default_rng(6)
    for _ in range(300):
        m, width = int(rng.integers(1, 30)), int(rng.integers(0, 5))
        before, after = (rng.integers(0, 3, (m, width)) for _ in range(2))
        nodes = rng.integers(0, 3, m)
        got = repeats.column_wise(nodes, before, after)
        whole = np.hstack([before, nodes[:, None], after])
        for c in range(width + 1):
            seen = Counter(tuple(r) for r in whole[:, c:c + width + 1])
            assert [seen[tuple(r)] > 1 for r in whole[:, c:c + width + 1]] == got[:, c].tolist()


def test_of_nothing(spark):
    assert repeats.digests(repeats.repeated_bytes(empty(spark))).count() == 0
