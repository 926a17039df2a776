"""The word index: hits, what is read of it, how it is cut, and adding files."""

import re

import pytest

from rowlantern import operators as op
from rowlantern.operators import token_index

TEXTS = ["The quick brown fox", "the slow fox", None, "", "THE END", "fox-trot, fox. 12th", "naïve Straße 中文 ß", "qu ick"]


def records(spark, texts=TEXTS, file="a"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file string, record_id long, text string")


def ids(df):
    return sorted((r.file, r.record_id) for r in df.collect())


def slow(texts, query):
    def words(t):
        return set(re.findall(r"[^\W_]+", (t or "").lower()))
    return [i for i, t in enumerate(texts) if words(query) and words(query) <= words(t)]


@pytest.mark.parametrize("query", ["fox", "FOX the", "the quick fox brown", "quick", "trot", "naïve", "中文", "strasse", "ß",
                                   "", " -,", "absent", "the absent", "12th"])
def test_hits(spark, out, query):
    path = out()
    op.build_index(records(spark), path)
    hits = op.index_hits(spark, path, query)
    assert ids(hits) == [("a", i) for i in slow(TEXTS, query)]
    found = op.indexed_search(records(spark), path, query)
    assert ids(found) == ids(hits) and found.columns == ["file", "record_id", "text"]


def test_only_asked_buckets_are_read(spark, out):
    path = out()
    op.build_index(records(spark, [f"word{i} common" for i in range(300)]), path)
    plan = token_index.postings_of(spark, path, ["word7"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "EqualTo(word,word7)" in plan
    read = {re.search(r"bucket=(\d+)", f).group(1) for f in op.index_hits(spark, path, "word7").inputFiles() if "bucket=" in f}
    total = {re.search(r"bucket=(\d+)", f).group(1) for f in spark.read.parquet(f"{path}/postings").inputFiles()}
    assert len(total) > 40 and len(read) <= len(total)


def test_build_is_one_shuffle_of_words(spark, out, monkeypatch):
    """A word of every record is cut into rows of bounded length, dealt to several tasks."""
    monkeypatch.setattr(token_index, "BLOCK", 16)
    monkeypatch.setattr(token_index, "RECORDS_PER_PART", 50)
    path = out()
    op.build_index(records(spark, [f"common w{i % 9}" for i in range(400)]), path)
    rows = spark.read.parquet(f"{path}/postings").where("word = 'common'").collect()
    assert len(rows) == 25 and all(len(r.places) == 16 for r in rows)
    assert ids(op.index_hits(spark, path, "W3 common")) == [("a", i) for i in range(400) if i % 9 == 3]
    assert {(r.word, r.n_records) for r in op.word_counts(spark, path).collect()} >= {("common", 400), ("w8", 44)}


def test_adding_files(spark, out):
    path = out()
    op.build_index(records(spark), path, buckets=7)
    op.build_index(records(spark, ["a fox", "none"], "b"), path, append=True)
    assert ids(op.index_hits(spark, path, "fox")) == [("a", 0), ("a", 1), ("a", 5), ("b", 0)]
    assert all(int(re.search(r"bucket=(\d+)", f).group(1)) < 7 for f in spark.read.parquet(f"{path}/postings").inputFiles())
    with pytest.raises(ValueError, match="already indexed: b"):
        op.build_index(records(spark, ["x"], "b"), path, append=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        op.build_index(records(spark), path)


def test_index_of_nothing(spark, out):
    path = out()
    op.build_index(records(spark).where("false"), path)
    assert ids(op.index_hits(spark, path, "fox")) == [] and op.word_counts(spark, path).count() == 0
