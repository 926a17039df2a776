"""Periodic runs and the Merkle manifest: against brute force and hand-made cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlantern.llm import merkle, runs
from tests.llm.test_text_operators import ODD, docs, empty


def slow_runs(x):
    """Every period against every place."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found[i, j + q] = min(found.get((i, j + q), q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("kind", ["two words", "one word", "repeats", "patches"])
def test_runs_equal_brute_force(kind):
    rng = random.Random(kind)
    for _ in range(1500):
        n = rng.randrange(60)
        if kind == "two words":
            x = [rng.randrange(1, 3) for _ in range(n)]
        elif kind == "one word":
            x = [7] * n
        elif kind == "repeats":
            x = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
            x = [rng.randrange(1, 4) for _ in range(rng.randrange(5))] + x + x[:rng.randrange(len(x) + 1)]
        else:
            x = []
            while len(x) < n:
                x += [rng.randrange(1, 3) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 7)
        codes = runs.numbered_words([str(w).encode() for w in x])
        assert runs.find_runs(codes) == slow_runs(x)


def test_long_runs_stay_cheap():
    assert runs.find_runs(np.ones(100_000, np.int64)) == [(0, 100_000, 1)]
    # One line before ever new words: as many left words as places.
    line = list(range(1, 9))
    x = [w for k in range(5000) for w in (100 + k, *line)]
    assert runs.find_runs(np.array(x)) == []
    # Five times each period: all found, none twice.
    x = [w for k in range(3000) for w in ([1, 2, 3] * 5 + [1000 + k])]
    assert runs.find_runs(np.array(x)) == [(16 * k, 15, 3) for k in range(3000)]


def test_run_query_columns(spark):
    texts = [*ODD, "a " * 6, "a " * 5, "\x0b".join("xyxyxyxy"), "p q r p q r p q r p q r p s s s s s s", "A a " * 4]
    found = runs.periodic_runs(docs(spark, texts))
    got = {}
    for r in runs.digests(found).collect():
        got.setdefault(r.doc_id, r)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        want = slow_runs(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in want)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert got[None].n_runs == 0 and found.where("doc_id = 9").count() == 2
    assert runs.digests(runs.periodic_runs(runs.looped(empty(spark)))).count() == 0


def test_looped_texts(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " \n".join(words)) for i in range(80)] + [(k, t) for k in range(80, 160) for t in (None, "", " \t", "one")]
    df = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
    changed = 0
    for before, after in zip(df.collect(), runs.looped(df).collect()):
        h = zlib.crc32(str(before.doc_id).encode())
        if before.doc_id is None or h % 10 or not (before.text or "").split():
            assert after.text == before.text
            continue
        w = before.text.split()
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert after.text == " ".join(w[a + (i - a) % p] if i >= a else w[i] for i in range(n))
        changed += 1
    assert changed > 5


# --- manifest ---------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_tree(leaves):
    """(root, [levels of (before, after)] per leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8:k // 8 * 8 + 8]
            paths[i].append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        level = [h(*level[k:k + 8]) for k in range(0, len(level), 8)]
        at = [k // 8 for k in at]
    return level[0], paths


def slow_manifest(rows):
    def leaf(row, text):
        fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
        return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    small = str.maketrans(merkle.CAPITALS, merkle.SMALL)
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id, leaf(r, r.text), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for members in trees.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    done = {x: slow_tree([m[1] for m in trees[x]]) for x in langs}
    root, tops = slow_tree([done[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        subroot, paths = done[x]
        for (doc_id, own, r), path in zip(trees[x], paths):
            now = own
            if doc_id is not None and r.text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                now = leaf(r, r.text.translate(small))
            for before, after in path + top:
                now = h(before, now, after)
            proof = h(*(b + a for b, a in path + top))
            out.append((doc_id, own, subroot, root, proof, now, now == root))
    return out


def manifest_rows(spark, n, langs):
    rng = random.Random(n)
    rows = [(None if i == 5 else i if i != 7 else 6, None if i % 11 == 0 else f"Text É {i} " * (i % 3), rng.choice(langs),
             rng.choice([None, "web", "Büch"]), None if i % 7 == 0 else i) for i in range(n)]
    rows += rows[:min(n, 2)]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("rank", "hash", "part", "n", "group", "item", "block", "kids", "path"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, [None]), (40, [None, "", "en", "é"]),
                                      (700, ["en"] * 40 + [f"l{k}" for k in range(70)])])
def test_manifest_equals_brute_force(spark, n, langs):
    df = manifest_rows(spark, n, langs)
    got = [tuple(r) for r in merkle.prove(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_manifest(df.collect())))
    if n > 9:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    df = manifest_rows(spark, 150, ["a", "a", "a", *"bcdefghijkl"])
    got = [tuple(r) for r in merkle.prove(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow_manifest(df.collect())))


def test_manifest_of_nothing(spark):
    assert merkle.prove(manifest_rows(spark, 3, ["a"]).where("false")).count() == 0
