"""Nothing is lost or changed: broken, deep and long JSON, exact numbers, several files, values that are NULL."""

import importlib
import json

import pytest
from pyspark.sql import functions as F

from rowlantern import operators as op
from rowlantern.sinks import export_records, export_subtree
from rowlantern.sources import read_jsonl, read_parquet
from rowlantern.sources.parquet_files import read_parquet_rows
from tests.conftest import parts

search_module = importlib.import_module("rowlantern.operators.search")


def records(spark, *raws):
    rows = [(i, r) for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, "record_id long, raw string").withColumn("text", F.col("raw"))


def test_nested_repeated_keys_are_listed(spark):
    df = records(spark, '{"a":{"x":1,"x":2},"b":1}', '[{"x":1,"x":2},5]')
    got = sorted((r.record_id, r.pos, r.seg, r.text) for r in op.children(df).collect())
    assert got == [(0, 0, "a", '{"x":1,"x":2}'), (0, 1, "b", "1"), (1, 0, "0", '{"x":1,"x":2}'), (1, 1, "1", "5")]
    found = op.nodes(df).where("record_id = 0").collect()
    assert sorted(r.path for r in found) == ["", "a", "a.x", "a.x", "b"]
    assert sorted(r.pos for r in found if r.path == "a.x") == [0, 1]
    assert op.subtree_search(df, [], "5").where("parent_record_id = 1").count() == 1


def test_numbers_stay_as_written(spark, out):
    big = "1" * 45
    df = records(spark, f'{{"p":{{"a":1.10,"b":1e400,"c":{big}, "d":0.12345678901234567890123}}}}')
    texts = {r.seg: r.text for r in op.children(df, ["p"]).collect()}
    assert texts == {"a": "1.10", "b": "1e400", "c": big, "d": "0.12345678901234567890123"}
    assert op.subtree(df, ["p", "d"]).first().value == "0.12345678901234567890123"
    path = out()
    export_subtree(df, ["p"], "jsonl", path, children=["a", "b", "c"])
    assert b"".join(parts(path)) == f"1.10\n1e400\n{big}\n".encode()


@pytest.mark.parametrize("raw", ['{"a":1,', "[1,2", '{"a":1} x', "nonsense", "[1 2]"])
def test_broken_records_have_an_error(spark, raw):
    df = records(spark, raw)
    assert op.children(df).where("error is not null").count() == 1
    assert op.nodes(df).where("error is not null and kind = 'unknown'").count() == 1
    assert op.subtree_as_records(df).where("error is not null").count() == 1
    summary = op.node_summary(df).collect()
    assert len(summary) == 1 and summary[0].error and not summary[0].complete


def test_broken_way_to_a_subtree_is_reported(spark):
    row = op.children(records(spark, '{"a":[1,}'), ["b"]).collect()
    assert [(r.kind, r.text) for r in row] == [("unknown", None)] and row[0].error


def test_any_depth_and_length(spark):
    deep = "[" * 3000 + "]" * 3000
    long = json.dumps({"s": "x" * 21_000_000, "t": 1})
    found = op.nodes(records(spark, deep)).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (found.n, found.d) == (3000, 2999)
    listed = op.children(records(spark, long)).select("seg", F.length("text").alias("n")).collect()
    assert sorted((r.seg, r.n) for r in listed) == [("s", 21_000_002), ("t", 1)]
    assert [r.json_ok for r in op.json_validity(records(spark, deep, "[" * 3000)).orderBy("record_id").collect()] == [
        True, False]


def test_json_schema_counts_paths(spark):
    df = records(spark, '{"a":[1,"x"]}', '{"a":[2]}', "{")
    got = {(r.path, r.kind): r.n for r in op.json_schema(df).collect()}
    assert got == {("", "object"): 2, ("a", "array"): 2, ("a[*]", "number"): 2, ("a[*]", "string"): 1,
                   (None, "unknown"): 1}


@pytest.fixture
def three_files(spark, put):
    for name in "abc":
        folder = put(f"many/{name}.jsonl", "".join(f"{name}{i} hit\n" for i in range(5))).rsplit("/", 1)[0]
    return read_jsonl(spark, folder)


def test_pages_walk_all_files(three_files):
    seen, file, at = [], None, 0
    while True:
        page = op.next_page(three_files, at, 4, file).orderBy("file", "record_id").collect()
        seen += [r.text for r in page]
        if page[0].eof:
            break
        file, at = page[0].next_file, page[0].next_id
    assert seen == [f"{name}{i} hit" for name in "abc" for i in range(5)]


def test_a_cursor_without_a_file_is_in_the_smallest(three_files):
    page = op.next_page(three_files, 3, 4).orderBy("file", "record_id").collect()
    assert [r.text for r in page] == ["a3 hit", "a4 hit", "b0 hit", "b1 hit"]


def test_hits_after_goes_on_in_the_next_file(three_files):
    hits = op.search(three_files, "hit")
    assert [r.text for r in op.hits_after(hits, 3, 3).orderBy("file", "record_id").collect()] == [
        "a4 hit", "b0 hit", "b1 hit"]
    second = sorted(r.file for r in three_files.select("file").distinct().collect())[1]
    assert [r.text for r in op.hits_after(hits, 3, 2, second).orderBy("file", "record_id").collect()] == [
        "b4 hit", "c0 hit"]


def test_ids_over_files_need_the_file(three_files):
    first, second, _ = sorted(r.file for r in three_files.select("file").distinct().collect())
    with pytest.raises(ValueError, match="several files"):
        op.select_by_ids(three_files, [1])
    assert [r.text for r in op.select_by_ids(three_files, [1], file=second).collect()] == ["b1 hit"]
    pairs = op.select_by_ids(three_files, [(first, 1), (second, 2)]).orderBy("file").collect()
    assert [r.text for r in pairs] == ["a1 hit", "b2 hit"]


def test_large_caps_number_all_hits(three_files, monkeypatch):
    monkeypatch.setattr(search_module, "TOP_K", 3)
    hits = op.search_hits(three_files, "hit", max_hits=7).orderBy("hit_no").collect()
    assert [(r.hit_no, r.preview, r.truncated) for r in hits] == [
        (i, f"{'ab'[i // 5]}{i % 5} hit", True) for i in range(7)]
    assert not op.search_hits(three_files, "hit", max_hits=100).first().truncated


@pytest.mark.parametrize("values, want", [(["1", None], [1, None]), ([None, "1"], [None, 1]), ([None], [None])])
def test_null_values_are_written(spark, out, values, want):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "record_id long, raw string").withColumn("text", F.col("raw")).coalesce(1)
    for fmt in ("json", "jsonl"):
        path = out()
        summary = export_records(df, "parquet", fmt, path, ordered=False).first()
        assert summary.records_written == len(want)
        text = b"".join(parts(path)).decode()
        assert (json.loads(text) if fmt == "json" else [json.loads(x) for x in text.splitlines()]) == want


def test_column_filter_reaches_the_scan(spark, out):
    path = out()
    spark.range(100).selectExpr("id", "id % 7 as k", "'x' as unused").write.parquet(path)
    found = op.column_filter(read_parquet_rows(spark, path), "k = 3", ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "unused" not in plan
    assert found.count() == 14


def test_missing_rate_and_top_values(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id long, v string")
    assert {r.col: (r.n_missing, r.missing_rate) for r in op.missing_rate(df).collect()} == {
        "id": (0, 0.0), "v": (2, 0.5)}
    assert op.missing_rate(df.limit(0)).where("missing_rate is null").count() == 2
    assert [(r.value, r.n) for r in op.top_values(df, "v", 3).collect()] == [(None, 2), ("a", 1), ("b", 1)]


def test_read_parquet_still_gives_records(spark, out):
    path = out()
    spark.range(3).write.parquet(path)
    assert read_parquet(spark, path).count() == 3
