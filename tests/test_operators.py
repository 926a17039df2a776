import json

import pytest
from pyspark.sql import functions as F

from rowlantern import operators as op
from rowlantern.functions import cut, row_line, row_object
from rowlantern.functions.search_text import matches, needles
from rowlantern.operators import select
from rowlantern.sources import catalog, format_of, open_dataset
from rowlantern.streaming import start_file_search, start_search, stream_hits


def records(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "record_id long, raw string")
    return df.withColumn("text", F.col("raw"))


def hits(spark, query, *raws, **kw):
    return [r.record_id for r in records(spark, *raws).where(matches(F.col("text"), query, **kw)).orderBy("record_id").collect()]


def test_needles():
    assert needles(" a b ") == ["a b"]
    assert needles("'k':\"v\"") == ["k", "v"]
    assert needles("http://x") == ["http", "//x"]
    assert needles(":x") == [":x"] and needles("x:") == ["x:"]
    assert needles('a:"') == ["a", '"']  # one lone quote is itself
    assert needles("a:b", key_value=False) == ["a:b"]
    with pytest.raises(ValueError):
        needles("  ")


def test_matching(spark):
    assert hits(spark, "HELLO", "say hello", "no") == [0]
    assert hits(spark, "HELLO", "say hello", "HELLO", case_sensitive=True) == [1]
    assert hits(spark, "ÉTÉ", "l'été", "ete") == [0]
    assert hits(spark, "k:v", '{"v":"k"}', "only k", "kv") == [0, 2]
    # a needle with a quote or backslash also matches in its escaped form
    assert hits(spark, 'say "hi"', '{"t":"say \\"hi\\""}', 'x "say \\"hi\\"" y', 'say hi', 'say "hi"') == [0, 1, 3]
    assert hits(spark, "a\\b", "a\\b", 'is "a\\\\b"', "ab") == [0, 1]


def test_occurrences_and_spans(spark):
    df = records(spark, "aaaa baab", "none", "AA", 'say "q" twice "q"')
    got = {r.record_id: r.occurrences for r in op.occurrence_counts(df, "aa").collect()}
    assert got == {0: 3, 1: 0, 2: 1, 3: 0}
    assert op.occurrence_total(df, "aa").first().occurrences == 4
    spans = op.match_spans(df, "aa").orderBy("record_id", "span_no").collect()
    assert [(r.record_id, r.span_no, r.start_pos) for r in spans] == [(0, 1, 0), (0, 2, 2), (0, 3, 6), (2, 1, 0)]
    assert [r.start_pos for r in op.match_spans(records(spark, "x é中 aa"), "aa").collect()] == [5]


def test_cap_and_truncation(spark):
    df = records(spark, *["x"] * 5)
    for cap, n, more in [(3, 3, True), (5, 5, False), (9, 5, False), (10**9, 5, False)]:
        rows = op.search_hits(df, "x", max_hits=cap).orderBy("hit_no").collect()
        assert [r.record_id for r in rows] == list(range(n)) and all(r.truncated == more for r in rows)
    with pytest.raises(ValueError):
        op.search_hits(df, "x", max_hits=-1)
    page = op.hits_page(op.search_hits(df, "x"), index=2, size=2).collect()
    assert sorted(r.record_id for r in page) == [2, 3] and page[0].next_index == 4 and not page[0].eof
    assert [r.record_id for r in op.hits_after(op.search_hits(df, "x"), 3, 2).collect()] == [4]


def test_pages_run_on_into_the_next_file(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)], "file string, record_id long")
    for dense in (False, True):
        rows = op.next_page(df, record_id=1, size=2, file="a", dense=dense).orderBy("file", "record_id").collect()
        assert [(r.file, r.record_id) for r in rows] == [("a", 1), ("b", 0)]
        assert (rows[0].next_file, rows[0].next_id) == ("b", 1)


def test_record_view_cuts_code_points(spark):
    df = spark.createDataFrame([("é中" * 3,)], "t string")
    assert [tuple(r) for r in df.select(cut(F.col("t"), 5), cut(F.col("t"), 6), cut(F.col("t"), 0)).collect()] == [
        ("é中é中é…", "é中" * 3, "")]


def test_lookup_reports_oversized_records(spark):
    rows = op.get_records(records(spark, "abc", "abcdef"), [0, 1, 7], max_bytes=4).orderBy("record_id").collect()
    assert [(r.raw, r.bytes) for r in rows] == [("abc", 3), (None, 6)] and "too large" in rows[1].error


def test_id_lists(spark, monkeypatch):
    df = records(spark, *"abcde")
    monkeypatch.setattr(select, "_LITERAL_IDS", 2)
    for bound in (10, 1):  # broadcast, and beyond its bound the plain join
        monkeypatch.setattr(select, "BROADCAST_IDS", bound)
        got = op.select_by_ids(df, [3, 1, 1, 4, 99])
        assert sorted(r.record_id for r in got.collect()) == [1, 3, 4]
    ids = spark.createDataFrame([(2,), (2,), (9,)], "record_id long")
    assert [r.record_id for r in op.select_by_ids(df, ids).collect()] == [2]
    assert op.select_by_ids(df, []).count() == 0
    assert sorted(r.record_id for r in op.union_ids(df, ids).collect()) == [0, 1, 2, 3, 4, 9]
    assert sorted(r.record_id for r in op.subtract_ids(ids, df).collect()) == [9]


def test_row_rendering(spark):
    df = spark.sql("""SELECT CAST(1.50 AS DECIMAL(5,2)) AS d, DATE'2024-01-02' AS day, TIMESTAMP'2024-01-02 03:04:05' AS ts,
        X'6869' AS bin, array(1, 2) AS arr, named_struct('a', 'x', 'b', CAST(NULL AS INT)) AS st, map('k', 1) AS mp,
        CAST('NaN' AS DOUBLE) AS nan, CAST(NULL AS STRING) AS none, 'a\tb\nc' AS txt""")
    line = df.select(row_line(df)).first()[0]
    assert line == ('1.50\t2024-01-02\t2024-01-02 03:04:05\tblob(base64:aGk=)\t[1,2]\t{"a":"x","b":null}\t{"k":1}'
                    "\tNaN\tnull\ta b c")
    obj = json.loads(df.select(row_object(df)).first()[0])
    assert obj["d"] == 1.5 and obj["day"] == "2024-01-02" and obj["arr"] == [1, 2] and obj["none"] is None
    assert obj["st"] == {"a": "x", "b": None} and obj["bin"] == "aGk=" and obj["txt"] == "a\tb\nc"


def test_json_validity(spark):
    good = ['{"a":1}', "[1,2]", "5", '"s"', "null", '{"a":1,"a":2}', ' {"b":[{}]} ', '"\\u00e9"', "-1.5e3"]
    bad = ['{"x":1} junk', '{"x":1}\n{"x":2}', "{'a':1}", "1,2", "1],[2", "", "  ", "[1,2", '{"a":}', "prose", "NaN",
           '"tab\tinside"', '{"a":1', "tru"]
    rows = op.json_validity(records(spark, *good, *bad, None)).orderBy("record_id").collect()
    assert [r.json_ok for r in rows] == [True] * len(good) + [False] * (len(bad) + 1)


TREE = '{"b":{"z":1,"y":"{}"},"a":["x",null,2.5,[true]],"b2":null,"it\'s?":"q"}'


def test_children_keep_document_order(spark):
    df = records(spark, TREE)
    kids = op.children(df).orderBy("pos").collect()
    assert [(r.seg, r.kind, r.preview) for r in kids] == [
        ("b", "object", '{"z":1,"y":"{}"}'), ("a", "array", '["x",null,2.5,[true]]'), ("b2", "null", "null"),
        ("it's?", "string", '"q"')]
    assert [(r.seg, r.kind, r.text) for r in op.children(df, ["a"]).orderBy("pos").collect()] == [
        ("0", "string", '"x"'), ("1", "null", "null"), ("2", "number", "2.5"), ("3", "array", "[true]")]
    assert op.children(df, ["b", "y"]).count() == 0  # a string that looks like an object
    assert op.children(df, ["a", 0]).count() == 0
    twice = op.children(records(spark, '{"k":1,"k":2}')).orderBy("pos").collect()
    assert [(r.seg, r.text) for r in twice] == [("k", "1"), ("k", "2")]


def test_children_pages_and_choice(spark):
    df = records(spark, TREE)
    page = op.children_page(df, [], cursor=1, limit=2).orderBy("pos").collect()
    assert [r.seg for r in page] == ["a", "b2"] and page[0].next_cursor == 3
    assert op.children_page(df, [], cursor=3, limit=2).first().next_cursor is None
    assert [r.seg for r in op.select_children(df, [], ["b2", "b", 0]).orderBy("pos").collect()] == ["b", "b2"]
    assert [r.text for r in op.select_children(df, ["a"], [3, 0, "b"]).orderBy("pos").collect()] == ['"x"', "[true]"]


def test_subtree_paths(spark):
    df = records(spark, TREE)

    def at(*path):
        row = op.subtree(df, list(path)).first()
        return row.value, row.kind

    assert at("b", "y") == ('"{}"', "string") and at("a", 3, 0) == ("true", "boolean")
    assert at("b2") == ("null", "null") and at("a", 1) == ("null", "null")
    assert at("it's?") == ('"q"', "string")
    assert at("nope") == (None, None) and at("a", 9) == (None, None) and at("a", "b") == (None, None) and at(0) == (None, None)
    with pytest.raises(Exception, match="no value at nope"):
        op.subtree(df, ["nope"], on_missing="error").collect()
    assert op.subtree(df, ["nope"], on_missing="skip").count() == 0


def test_node_summary_caps(spark):
    df = records(spark, '{"a":[1,2,3],"s":"x"}')
    full, capped, leaf = (op.node_summary(df, ["a"]).first(), op.node_summary(df, ["a"], max_items=2).first(),
                          op.node_summary(df, ["s"]).first())
    assert (full.kind, full.child_count, full.complete) == ("array", 3, True)
    assert (capped.child_count, capped.complete) == (2, False)
    assert (leaf.kind, leaf.child_count, leaf.complete) == ("string", None, True)


def test_subtree_as_records_and_search(spark):
    many = {f"k{i}": i for i in range(8)}
    df = records(spark, json.dumps({"items": [many, "a" * 200, None], "n": None, "s": 7}))
    got = op.subtree_as_records(df, ["items"]).orderBy("record_id").collect()
    assert got[0].preview == "#0 {Object(8): k0, k1, k2, k3, k4, k5, …}"
    assert got[1].preview == '#1 "' + "a" * 159 + "…" and got[2].preview == "#2 null"
    assert json.loads(got[0].raw) == many
    assert [r.label for r in op.subtree_as_records(df).orderBy("record_id").collect()] == ["items:", "n:", "s:"]
    assert [(r.record_id, r.label, r.preview) for r in op.subtree_as_records(df, ["s"]).collect()] == [(0, "", "7")]
    assert op.subtree_as_records(df, ["n"]).count() == 0
    assert [r.record_id for r in op.subtree_search(df, ["items"], "K7").collect()] == [0]
    assert [r.record_id for r in op.subtree_search(df, ["items"], "#2").collect()] == [2]
    assert op.subtree_search(df, ["items"], "k7:nothing").count() == 0  # plain text only


def walk(value, path="", depth=0, pos=0):
    kids = ([(f"{path}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list)
            else [((path + "." if path else "") + k, v) for k, v in value.items()] if isinstance(value, dict) else None)
    yield path, depth, pos, None if kids is None else len(kids)
    for i, (p, v) in enumerate(kids or []):
        yield from walk(v, p, depth + 1, i)


def test_nodes_against_a_walk(spark):
    values = [json.loads(TREE), [[[[1], []], {}], {"a": {"b": {"c": [{"d": "[1]"}]}}}], 5, "x", None]
    df = records(spark, *[json.dumps(v) for v in values])
    rows = op.nodes(df).collect()
    want = sorted(str((i, *n)) for i, v in enumerate(values) for n in walk(v))
    assert sorted(str((r.record_id, r.path, r.depth, r.pos, r.child_count)) for r in rows) == want
    assert all(r.expanded for r in rows)
    shallow = op.nodes(df, max_depth=1).where("not expanded").collect()
    assert {(r.record_id, r.path, r.child_count) for r in shallow} == {
        (0, "b", 2), (0, "a", 4), (1, "[0]", 2), (1, "[1]", 1)}


def test_catalogue(spark, tmp_path):
    for name in ["b/x.JSONL", "b/inner/y.txt", "A/z.csv", "top.parquet", "Note.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    rows = catalog(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.name, r.kind, r.depth, r.supported) for r in rows] == [
        ("A", "dir", 1, False), ("z.csv", "file", 2, True), ("b", "dir", 1, False), ("inner", "dir", 2, False),
        ("y.txt", "file", 3, False), ("x.JSONL", "file", 2, True), ("Note.md", "file", 1, False), ("top.parquet", "file", 1, True)]
    assert not rows[0].truncated
    few = catalog(spark, str(tmp_path), max_nodes=4).orderBy("ordinal").collect()
    assert [r.name for r in few] == ["A", "z.csv", "b"] and few[0].truncated
    assert {r.depth for r in catalog(spark, str(tmp_path), max_depth=1).collect()} == {1}


def test_formats_by_extension():
    assert [format_of(p) for p in ("a.jsonl", "x/B.CSV", "c.Json", "d.parquet", "e.txt", "noext")] == [
        "jsonl", "csv", "json", "parquet", "unknown", "unknown"]


def test_streaming_search_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.jsonl").write_text(f"hit {i}\nmiss\r\n")
    hits = stream_hits(spark, str(source), "HIT", max_files_per_trigger=1)
    query = start_search(hits, str(tmp_path / "hits"), str(tmp_path / "mark"), available_now=True)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "hits")).collect()
    want = op.search(open_dataset(spark, str(source), "jsonl"), "HIT").collect()
    assert sorted(r.preview for r in got) == sorted(r.text for r in want) == ["hit 0", "hit 1", "hit 2"]


@pytest.mark.parametrize("fmt, text", [
    ("csv", 'a,b\n1,"x\nHit"\n2,miss\n3,hit\n'), ("json", '[{"t":"miss"},\n{"t":"hit"}]')])
def test_streaming_search_of_whole_files(spark, tmp_path, fmt, text):
    source = tmp_path / "in [1]"
    source.mkdir()
    for i in range(2):
        (source / f"f {i}{{x}}.{fmt}").write_text(text)
    (source / "other.txt").write_text("hit")
    folder = str(source).replace("[", "\\[").replace("]", "\\]")
    query = start_file_search(spark, folder, "hit", fmt, str(tmp_path / "hits"), str(tmp_path / "mark"),
                              max_files_per_trigger=1, available_now=True)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "hits")).collect()
    want = op.search(open_dataset(spark, f"{folder}/*.{fmt}", fmt), "hit").collect()
    assert sorted((r.file, r.record_id) for r in got) == sorted((r.file, r.record_id) for r in want)
    assert len(got) == (4 if fmt == "csv" else 2) and {r.batch for r in got} == {0, 1}


def test_plans(spark, tmp_path):
    """What the plans must and must not contain."""
    df = spark.range(1000).selectExpr("id", "cast(id as string) as t", "id % 7 as g")
    path = str(tmp_path / "p.parquet")
    df.coalesce(1).write.parquet(path)

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()

    rows = open_dataset(spark, path)
    assert "Exchange" not in plan(op.search(rows, "9")) and "Sort" not in plan(op.search(rows, "9"))
    assert "TakeOrderedAndProject" in plan(op.search_hits(rows, "9"))
    assert "TakeOrderedAndProject" in plan(op.next_page(rows, 10))
    from rowlantern.sources import read_parquet_rows
    narrow = plan(read_parquet_rows(spark, path).where("g = 3").select("record_id", "g"))
    assert "EqualTo(g,3)" in narrow and "ReadSchema: struct<g:bigint" in narrow
    some = op.select_by_ids(rows, list(range(500)))
    assert "BroadcastHashJoin" in plan(some) and "LeftSemi" in plan(some)
    assert "Exchange" not in plan(op.nodes(rows))
    (tmp_path / "l.jsonl").write_text("a\nb\n")
    text = plan(open_dataset(spark, str(tmp_path / "l.jsonl")))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_ids_over_parts_of_a_dataset(spark, tmp_path):
    path = str(tmp_path / "parts.parquet")
    spark.range(100).repartition(3).sortWithinPartitions("id").write.parquet(path)
    rows = open_dataset(spark, path)
    with pytest.raises(ValueError, match="several files"):
        op.select_by_ids(rows, [1])
    whole = op.whole_dataset_ids(rows).select("file", "record_id", "dataset_id").orderBy("dataset_id").collect()
    assert [r.dataset_id for r in whole] == list(range(100))
    assert [(r.file, r.record_id) for r in whole] == sorted((r.file, r.record_id) for r in whole)
    pairs = [(whole[40].file, whole[40].record_id), (whole[99].file, whole[99].record_id)]
    assert op.select_by_ids(rows, pairs).count() == 2
