"""Searches, lookups and pages that open some of the files only."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rowlantern import operators as op
from rowlantern.operators import record_index, stopping
from rowlantern.sources import open_dataset


@pytest.fixture
def folder(put, tmp_path):
    """30 files of 0 to 9 lines, with names that read like patterns."""
    rng = random.Random(4)
    for i in range(30):
        lines = [json.dumps({"n": i * 100 + j, "t": rng.choice(["cat", "dog", "Cat and dog"])}) for j in range(rng.randrange(10))]
        put(f"set/p {i:02d} [a]{{b}}%20.jsonl", "".join(f"{x}\n" for x in lines))
    return str(tmp_path / "set")


@pytest.fixture
def opened(monkeypatch):
    """Paths that the operators open."""
    seen = []

    def watch(module):
        real = module.open_dataset
        monkeypatch.setattr(module, "open_dataset", lambda spark, paths, *a, **k: (
            seen.extend([paths] if isinstance(paths, str) else paths), real(spark, paths, *a, **k))[1])

    watch(stopping)
    watch(record_index)
    return seen


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_first_hits_equal_a_search_of_all(spark, folder, opened):
    records = open_dataset(spark, folder, "jsonl")
    for query, cap in (("cat", 7), ("cat", 100_001), ("bird", 3), ("dog", 0)):
        same = ["file", "record_id", "byte_offset", "byte_len", "preview", "hit_no", "truncated"]
        got = op.first_hits(spark, folder, query, cap, fmt="jsonl", first_bytes=300)
        assert rows(got.orderBy("hit_no"), *same) == rows(op.search_hits(records, query, max_hits=cap).orderBy("hit_no"), *same)
    with pytest.raises(ValueError):
        op.first_hits(spark, folder, " ", fmt="jsonl")
    with pytest.raises(ValueError):
        op.first_hits(spark, folder, "cat", -1, fmt="jsonl")


def test_first_hits_stop_reading(spark, folder, opened):
    assert op.first_hits(spark, folder, "t", 5, fmt="jsonl", first_bytes=500).count() == 5
    sizes = [os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder)]
    assert 0 < len(opened) < 10 and sum(sizes) > 3000
    opened.clear()
    assert op.first_hits(spark, folder, "bird", 5, fmt="jsonl", first_bytes=500).count() == 0
    assert len(opened) == sum(size > 0 for size in sizes)


def test_steps_double(spark, folder):
    got = stopping.file_groups(spark, folder, 300).orderBy("file").collect()
    start = 0
    for r in got:
        assert r.step == (0 if start < 300 else (start // 300).bit_length())
        start += r.length


def test_lookup_opens_only_the_files_that_hold_the_ids(spark, folder, opened, tmp_path):
    index = str(tmp_path / "index")
    op.index_records(spark, folder, index, "jsonl")
    whole = {r.dataset_id: tuple(r) for r in op.whole_dataset_ids(open_dataset(spark, folder, "jsonl")).select(
        "dataset_id", "file", "record_id", "text").collect()}
    n = len(whole)
    assert sorted(whole) == list(range(n))
    opened.clear()
    wanted = [3, 3, n - 1, n, -1]
    got = op.lookup(spark, index, wanted).select("dataset_id", "file", "record_id", "text").collect()
    assert {r.dataset_id: tuple(r) for r in got} == {i: whole[i] for i in (3, n - 1)} and len(got) == 2
    assert len(opened) == 2
    everything = spark.range(n + 5).select(F.col("id").alias("any"))
    got = op.lookup(spark, index, everything).select("dataset_id", "file", "record_id", "text").collect()
    assert {r.dataset_id: tuple(r) for r in got} == whole and len(got) == n
    assert op.lookup(spark, index, [n + 7]).count() == 0
    with pytest.raises(ValueError, match="no record index"):
        op.lookup(spark, str(tmp_path / "other"), [1])


def test_pages_cross_files(spark, folder, opened, tmp_path):
    index = str(tmp_path / "index")
    op.index_records(spark, folder, index, "jsonl")
    n = open_dataset(spark, folder, "jsonl", locations=False).count()
    opened.clear()
    seen, at = [], 0
    page = op.dataset_page(spark, index, at, 40).collect()
    assert len(opened) < 20
    while True:
        seen += [r.dataset_id for r in page]
        assert {(r.next_id, r.eof) for r in page} == {(at + 40, False) if at + 40 < n else (None, True)}
        if page[0].eof:
            break
        at = page[0].next_id
        page = op.dataset_page(spark, index, at, 40).collect()
    assert seen == list(range(n))
    assert op.dataset_page(spark, index, n, 40).count() == 0
    with pytest.raises(ValueError):
        op.dataset_page(spark, index, -1)


def test_a_changed_file_is_noticed_and_counted_again(spark, folder, opened, tmp_path):
    index = str(tmp_path / "index")
    op.index_records(spark, folder, index, "jsonl")
    names = sorted(os.listdir(folder))
    assert op.changed_files(spark, index).count() == 0
    with open(os.path.join(folder, names[0]), "a") as f:
        f.write('{"n":"later"}\n' * 20)
    os.replace(os.path.join(folder, names[5]), os.path.join(folder, "z.jsonl"))
    assert sorted(r.change for r in op.changed_files(spark, index).collect()) == ["changed", "gone", "new"]
    with pytest.raises(ValueError, match="changed since"):
        op.lookup(spark, index, [0])
    opened.clear()
    op.index_records(spark, folder, index, "jsonl")
    assert len(opened) == 2  # the longer one and the renamed one
    n = open_dataset(spark, folder, "jsonl", locations=False).count()
    assert op.indexed_files(spark, index).agg(F.sum("records")).first()[0] == n
    assert op.lookup(spark, index, range(n)).count() == n
    op.index_records(spark, folder, index, "jsonl")
    assert sorted(os.listdir(index)) == ["version=0", "version=1"]


def test_index_of_other_formats(spark, put, out, tmp_path):
    put("csv/a.csv", 'k,v\n1,"x\ny"\n2,z\n')
    put("csv/b.csv", "k,v\n3,w\n")
    put("json/a.json", '[{"k":1},{"k":2}]')
    put("json/b.json", '[]')
    put("json/c.json", '[3]')
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "parquet"))
    for fmt, n in (("csv", 5), ("json", 3), ("parquet", 10)):
        index = out()
        op.index_records(spark, str(tmp_path / fmt), index, fmt)
        whole = op.whole_dataset_ids(open_dataset(spark, str(tmp_path / fmt), fmt)).select("dataset_id", "raw").collect()
        got = op.lookup(spark, index, range(100)).select("dataset_id", "raw").collect()
        assert sorted(got) == sorted(whole) and len(got) == n


def test_sketch_counts(spark):
    some = spark.range(5000).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 50).cast("string")).alias("a`b"))
    for k in (1, 5, 60):
        assert op.approx_top_values(some, "a`b", k, 60).collect() == op.top_values(some.withColumnRenamed("a`b", "v"), "v", k).collect()
    assert op.approx_top_values(some.limit(0), "a`b").count() == 0
    many = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 20).otherwise(F.col("id")).alias("v"))
    exact = {r.value: r.n for r in op.top_values(many, "v", 60_000).collect()}
    got = op.approx_top_values(many, "v", 20, 1000).collect()
    assert {r.value for r in got} == set(range(20))
    assert all(exact[r.value] <= r.n <= exact[r.value] + 3.5 * 60_000 / 1000 for r in got)
    with pytest.raises(ValueError):
        op.approx_top_values(many, "v", 0)
