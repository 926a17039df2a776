"""URL filter, search, near-duplicates, passages, sharding, pipeline: against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rowlantern.llm import chosen_path, components, hash_tree, maxscore, paragraphs, queries, url_reputation
from tests.check_oracle import compare, connect

SF = entry.SMOKE_DIR


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name]) is None


# --- URL filter -------------------------------------------------------------

def test_url_parts_and_rules(spark):
    cases = {
        "https://WWW.Example.com/en/a?b#c": ("www.example.com", "/en/a", "allow", "www.example.com/en/"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "block", "example.com/en/"),
        "http://notexample.com/en/x": ("notexample.com", "/en/x", "allow", "com/"),
        "http://example.com": ("example.com", "", "allow", None),
        "ftp://x.net/es/1#t": ("x.net", "/es/1", "block", "net/es/"),
        "no scheme.net/es/": ("", "", "allow", None), None: ("", "", "allow", None),
        "http://?q": ("", "", "allow", None), "http://Ä.NET/fr/": ("Ä.net", "/fr/", "block", "net/fr/"),
        "a://b://c.net/es/": ("b:", "//c.net/es/", "allow", None),
    }
    rows = list(enumerate(cases)) + [(None, "http://x.net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.verdict, r.rule) for r in url_reputation.judge(
        pages, none, queries.URL_RULES).collect()}
    assert got == {None: ("x.net", "/es/", "block", "net/es/"), **{i: want for i, want in enumerate(cases.values())}}
    assert url_reputation.judge(pages.limit(0), none, []).count() == 0


def test_bad_hosts_are_blocked_and_new_ones_shrunk(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else f'h{i % 7}'}.site.org/x") for i in range(600)]
    rows += [(900, "http://new.site.org/"), (901, "http://bad.site.org/y")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(1, None), (None, 1)],
                                     "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert got[0].verdict == got[901].verdict == "block" and got[1].verdict == got[900].verdict == "allow"
    assert got[0].bad_bound > 0.9 > 0.3 > got[1].bad_bound


def test_unlabelled_hosts_fall_back_to_domain_suffix_and_all(spark):
    rows = [(i, f"http://h{i % 8}.{'bad' if i % 2 else 'good'}.co.uk/x") for i in range(800)]
    rows += [(i, f"http://h{i % 8}.site.org/x") for i in range(800, 1200)]
    new = ["new.bad.co.uk", "new.good.co.uk", "x.unseen.org", "y.unseen.xyz"]
    pages = spark.createDataFrame(rows + [(2000 + i, f"http://{h}/") for i, h in enumerate(new)] + [(3000, None)],
                                  "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2 if i < 800 else 0) for i in range(1200)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert [got[2000 + i].verdict for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert got[2000].bad_bound > 0.9 and all(got[2000 + i].bad_bound is not None for i in range(4))
    assert got[3000].bad_bound is None and got[3000].verdict == "allow"


# --- search -----------------------------------------------------------------

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-40, 40, (300, 12))
    vectors[50:80] = vectors[3]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (None, [1] * 12), (401, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit("clash"))
    for k, shard, group in ((5, 64, 4), (5, 1000, 1000), (400, 64, 1000)):
        got = maxscore.top_k(df, F.col("vec_id") % 10 == 0, k, shard, group)
        by = {}
        for r in got.orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(by) == set(range(0, 300, 10))
        for q, found in by.items():
            scores = vectors @ vectors[q]
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:k]
            assert found == [(n + 1, i, scores[i]) for n, i in enumerate(best)]


def test_search_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    big = [[1 << 27, int(k), -int(k) // 3] for k in rng.integers(-9, 9, 40)]
    mixed = [[int(x) << int(s) for x, s in zip(rng.integers(-99, 99, 3), rng.integers(0, 24, 3))] for _ in range(60)]
    vectors = big + mixed
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, vector array<long>")
    for shard in (16, 1000):
        got = {}
        for r in maxscore.top_k(df, F.col("vec_id") % 7 == 0, 5, shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == set(range(0, 100, 7))
        for q, found in got.items():
            scores = [sum(a * b for a, b in zip(v, vectors[q])) for v in vectors]
            order = sorted((i for i in range(100) if i != q), key=lambda i: (-scores[i], i))[:5]
            assert found == [(i, scores[i]) for i in order]


def test_search_of_huge_components_ends(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    df = df.select("vec_id", maxscore.integer_vector(F.col("e")).alias("vector"))
    got = maxscore.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 63) - 1), (3, 0), (2, -(1 << 63))]


def test_search_skips_postings_that_cannot_matter():
    """One heavy term decides; the light ones are read for the rows in question only."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 3, (9000, 24))
    vectors[:, 0] = rng.integers(0, 100_000, 9000)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if self.ndim == 2 and isinstance(key, tuple):
                read.append(np.asarray(out).size)
            return out

    q = np.array([1000] + [1] * 23)
    order = np.argsort(-vectors[:, 0], kind="stable")
    postings = np.ascontiguousarray(vectors[order].T.astype(np.float64)).view(Seen)
    ids, scores = maxscore._search_one(-1, q.astype(np.float64), order, postings, 5)
    exact = vectors @ q
    assert [(int(i), int(s)) for i, s in zip(ids, scores)] == [
        (i, exact[i]) for i in sorted(range(9000), key=lambda i: (-exact[i], i))[:5]]
    assert sum(read) < vectors.size * 0.35


def test_search_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [1, 2]), (5, [3, 4])], "vec_id long, vector array<long>")
    got = maxscore.top_k(df, F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 5, 11)]
    assert maxscore.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    odd = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([-0.5, 0.99],)],
                                "e array<float>")
    assert [r[0] for r in odd.select(maxscore.integer_vector(F.col("e"))).collect()] == [None] * 4 + [[-128, 253]]


# --- near-duplicates --------------------------------------------------------

def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def near_copies(seed):
    rng, words = random.Random(seed), [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(5):
        base = rng.choices(words, k=rng.choice([3, 40, 120]))
        for _ in range(rng.choice([2, 12, 40])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    common = " ".join(rng.choices(words, k=14))
    rows += [common + " " + " ".join(rng.choices(words, k=30)) for _ in range(30)]
    rows += [None, "", " \n", "one", "ONE", "two words", "two  words ", " ".join(rng.choices(words, k=20_000))]
    return [(i + 10, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, leaf, depth", [(1, 64, 3), (2, 4, 2), (3, 2, 1)])
def test_near_duplicates_equal_brute_force(spark, seed, leaf, depth):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("n", "digest", "own", "sign")}).repartition(3)
    got = chosen_path.near_duplicates(df, 3, 85, leaf=leaf, depth=depth).collect()
    want = brute_components(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (3, text), (3, text), (5, text + " x"), (8, "other words"), (9, None), (9, None), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    kept = chosen_path.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, text), (8, "other words"), (9, "")]
    assert chosen_path.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 301), (5, 5)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 300, 301)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages ---------------------------------------------------------------

def test_planted_passages_go_and_clean_text_stays(spark):
    rng, words = random.Random(9), [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=55)
    rows = []
    for i in range(60):
        own = rng.choices(words, k=rng.randrange(0, 120))
        if i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(90, None), (91, ""), (92, " ".join(passage).upper()), (3, rows[3][1]), (None, " ".join(passage)),
             (93, "ab " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn(
        "n_chars", F.length("text").cast("long"))
    found = paragraphs.repeated_passages(df).collect()
    holders = {i for i in range(60) if i % 3 == 0} | {92, None}
    assert {r.doc_id for r in found} == holders - {0} and {r.first_doc_id for r in found} == {0}
    texts = dict(rows)
    for r in found:
        run = texts[r.doc_id].lower().split()[r.start:r.start + r.words]
        # Paragraphs alike from 0.8 on may start or end two words outside of what repeats.
        assert " ".join(run[2:-2]) in " ".join(passage)
    out = paragraphs.drop_passages(df, length_col="n_chars")
    assert out.columns == df.columns
    left = {r.doc_id: r for r in out.collect()}
    assert all(left[i].text == t for i, t in rows if i not in holders - {0} and i != 3)
    assert all(" ".join(passage) not in " ".join((r.text or "").lower().split()) for i, r in left.items() if i != 0)
    assert all(r.n_chars == len(r.text) for r in left.values() if r.text is not None)
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


def test_planted_passages_go_up_to_their_ends(spark):
    rng, words = random.Random(11), [f"w{i}" for i in range(5000)]
    rows, passages = [], [rng.choices(words, k=51) for _ in range(8)]
    for i in range(48):
        ahead, behind = (rng.choices(words, k=rng.randrange(80)) for _ in range(2))
        rows.append((i, " ".join(ahead + passages[i % 8] + behind)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text.split() for r in paragraphs.drop_passages(df).collect()}
    assert all(" ".join(left[i]) == rows[i][1] for i in range(8))
    for i in range(8, 48):
        own = set(zip(*[left.get(i, [])[k:] for k in range(5)]))
        assert not own & set(zip(*[passages[i % 8][k:] for k in range(5)]))


def test_every_passage_of_39_words_holds_a_seed():
    rng = random.Random(10)
    for _ in range(200):
        passage = [rng.randrange(1 << 63) for _ in range(39)]
        seen = []
        for _ in range(2):
            ahead, behind = ([rng.randrange(1 << 63) for _ in range(rng.randrange(80))] for _ in range(2))
            words = np.array(ahead + passage + behind, np.uint64)
            starts = paragraphs.seed_starts(words) - len(ahead)
            seen.append({s for s in starts.tolist() if 0 <= s <= 39 - paragraphs.SEED})
        assert seen[0] & seen[1]


def _changed(rng, words, count):
    words = list(words)
    for at in rng.sample(range(len(words)), count):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def _five(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("blank", [False, True])
def test_paragraphs_equal_or_alike_are_found_as_by_brute_force(spark, blank):
    """Lines, or parts between blank lines wrapped at nine words, between fresh text; 0, 1 and 2 words changed."""
    rng, vocabulary = random.Random(12 + blank), [f"w{i}" for i in range(20_000)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    step = "\n\n" if blank else "\n"
    line = (lambda w: "\n".join(" ".join(w[i:i + 9]) for i in range(0, len(w), 9))) if blank else " ".join
    rows, pairs = [], []
    for size in (24, 30, 60, 100):
        for count in (0, 1, 2):
            for _ in range(25):
                paragraph = fresh(size)
                other = _changed(rng, paragraph, count)
                a, b = _five(paragraph), _five(other)
                first = len(rows)
                for words in (paragraph, other):
                    ahead = fresh(rng.randrange(26, 60))
                    rows.append((len(rows), step.join(line(w) for w in (ahead, words, fresh(rng.randrange(26, 60))))))
                    at = len(ahead)
                pairs.append((first, at, size, 5 * len(a & b) >= 4 * len(a | b), count))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {}
    for r in paragraphs.repeated_passages(df).collect():
        found.setdefault(r.doc_id, []).append(r)
    alike = [p for p in pairs if p[3]]
    whole = [(first, at, size) for first, at, size, _, _ in alike
             if any((r.first_doc_id, r.start, r.words) == (first, at, size) for r in found.get(first + 1, []))]
    assert len(alike) > 150 and len(whole) >= 0.99 * len(alike)
    assert all((first, at, size) in whole for first, at, size, _, count in pairs if not count)
    # Fresh text stays: nothing outside of the planted paragraphs goes, and nothing of the first documents.
    for first, at, size, _, _ in pairs:
        assert first not in found
        assert all(at <= r.start and r.start + r.words <= at + size for r in found.get(first + 1, []))


def test_hot_family_of_alike_lines(spark):
    """2000 near copies of one line, and one line that is equal in 1000 documents."""
    rng, vocabulary = random.Random(14), [f"w{i}" for i in range(5000)]
    line, equal = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=40)
    rows = [(i, " ".join(_changed(rng, line, 1)) + "\n" + " ".join(f"own{i}-{k}" for k in range(30))
             + ("\n" + " ".join(equal) if i % 2 else "")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    left = {r.doc_id: r.text.split("\n") for r in paragraphs.drop_passages(df).collect()}
    lines = {i: text.split("\n") for i, text in rows}
    assert [x.strip() for x in left[0]] == lines[0]
    assert left[1] == [lines[1][1], lines[1][2]]
    assert all(left[i] == [lines[i][1]] for i in range(2, 2000))


def test_pieces_of_texts():
    words, breaks = paragraphs.read_words("A b\n\nc  d\n" + "x" * 3_000_000 + " e\r\nf")
    assert breaks.tolist() == [0, 0, 2, 2, 3, 3, 4] and words[0] == paragraphs.read_words("a")[0][0]
    assert [len(x) for x in paragraphs.read_words(None)] == [0, 0]
    text = " ".join(f"w{i % 977}" for i in range(700_000))
    assert (paragraphs.read_words(text)[0] == paragraphs.sh.word_hashes(text.encode())).all()
    spans = lambda t: paragraphs.paragraph_spans(paragraphs.read_words(t)[1]).tolist()
    long, short = "a " * 30, "a " * 10
    assert spans(long + "\n" + short + "\n" + long) == [[0, 30], [40, 70]]
    assert spans("\n".join([short] * 3)) == [[0, 30]] and spans("\n".join([short] * 2)) == []
    assert spans("\n".join([short] * 3) + "\n \n" + long + "\n" + short) == [[0, 30], [30, 60]]


# --- sharding ---------------------------------------------------------------

def test_shards_move_only_where_weights_change(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    tree = hash_tree.even_tree(8)
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in tree]
    got = keys.select(hash_tree.shard_of(F.col("key"), tree).alias("a"),
                      hash_tree.shard_of(F.col("key"), hash_tree.grown(tree)).alias("b"),
                      hash_tree.shard_of(F.col("key"), heavier).alias("c")).collect()
    share = np.bincount([r.a for r in got], minlength=8)
    assert share.min() > 400 and share.max() < 600
    assert all(r.b in (r.a, 8) for r in got) and 350 < sum(r.b == 8 for r in got) < 550
    region = lambda s: s // 4
    assert all(region(r.c) == region(r.a) or region(r.c) == region(5) for r in got)
    assert all(r.c == r.a for r in got if region(r.a) != region(5) and region(r.c) != region(5))


def test_slots_are_gapless_and_sizes_right(spark):
    rows = [(i % 50, "é" * (i % 7)) for i in range(300)] + [(None, None), (None, ""), (77, "x" * 100_000)] + [(5, "hot")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    got = hash_tree.place(df, hash_tree.even_tree(8)).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    for placed in by.values():
        assert sorted(r.slot for r in placed) == list(range(len(placed)))
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert hash_tree.place(df.limit(0), hash_tree.even_tree(8)).count() == 0


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = corpus_pipeline.store(docs, "test-stage")
            assert 0 < docs.count() <= before
            last, before = docs, docs.count()
    assert docs.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry.queries()
