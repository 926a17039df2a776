"""The documented behaviour, scenario by scenario, on tiny inline files."""

import json

import pytest

from rowlantern import open_dataset
from rowlantern import operators as op
from rowlantern.sinks import export_records, export_subtree
from rowlantern.sources import read_parquet_rows
from tests.conftest import in_order, parts


def texts(folder):
    return b"".join(parts(folder))


def test_paging_neither_repeats_nor_drops(spark, put):
    df = open_dataset(spark, put("paging.jsonl", "a\nb\nc\nd\n"))
    first = op.next_page(df, size=2).orderBy("record_id").collect()
    assert [r.text for r in first] == ["a", "b"] and first[0].next_id == 2 and not first[0].eof
    second = op.next_page(df, record_id=first[0].next_id, size=2, file=None).orderBy("record_id").collect()
    assert [r.text for r in second] == ["c", "d"] and second[0].next_id is None and second[0].eof


def test_crlf_and_bad_bytes(spark, put):
    rows = in_order(open_dataset(spark, put("crlf_bytes.csv", b"a\r\n\xff\xfex\r\n")))
    assert [r.record_id for r in rows] == [0, 1] and rows[0].raw == "a" and "x" in rows[1].text
    rows = in_order(open_dataset(spark, put("crlf.jsonl", b"a\r\n\xff\xfex\r\n")))
    assert rows[0].raw == "a" and "x" in rows[1].raw


def test_page_search(spark, put):
    page = op.record_view(op.next_page(open_dataset(spark, put("words.jsonl", "hello\nworld\n"))))
    assert [r.record_id for r in op.search_page(page, "wor").collect()] == [1]
    assert op.search_page(page, "  ").count() == 0


def test_full_scan_then_export(spark, put, out):
    df = open_dataset(spark, put("dup.jsonl", "aa\nbb\naa\n"))
    hits = op.search_hits(df, "aa", case_sensitive=True)
    assert [r.record_id for r in hits.orderBy("hit_no").collect()] == [0, 2]
    assert not hits.first().truncated
    to = out()
    assert export_records(df, "jsonl", "jsonl", to, ids=[2]).first().records_written == 1
    assert texts(to) == b"aa\n"
    to = out()
    export_records(df, "jsonl", "jsonl", to, ids=hits)
    assert texts(to) == b"aa\naa\n"


def test_csv_to_jsonl_and_json(spark, put, out):
    df = open_dataset(spark, put("scores.csv", "id,name,score\n1,Alice,98\n2,Bob,87\n"))
    to = out()
    assert export_records(df, "csv", "jsonl", to, ids=[2, 1, 0, 1, 99]).first().records_written == 2
    assert [json.loads(line) for line in texts(to).splitlines()] == [
        {"id": "1", "name": "Alice", "score": "98"}, {"id": "2", "name": "Bob", "score": "87"}]
    to = out()
    export_records(df, "csv", "json", to, ids=[1])
    assert json.loads(texts(to)) == [{"id": "1", "name": "Alice", "score": "98"}]


def test_multi_line_csv_field(spark, put, out):
    df = open_dataset(spark, put("dialogue.csv", 'id,dialogue,summary,topic\n1,"line one\nline two",,\n2,x,y,z\n'))
    rows = in_order(df)
    assert len(rows) == 3
    assert json.loads(rows[1].raw) == {"id": "1", "dialogue": "line one\nline two", "summary": "", "topic": ""}
    to = out()
    export_records(df, "csv", "jsonl", to, ids=[1])
    assert rb"line one\nline two" in texts(to)


@pytest.fixture
def xy(spark, tmp_path):
    path = str(tmp_path / "xy.parquet")
    spark.sql("SELECT * FROM VALUES ('hello', 1), ('world', 2) AS t(x, y)").coalesce(1).write.parquet(path)
    return path


def test_parquet_search_lookup_export(spark, xy, out):
    df = open_dataset(spark, xy)
    assert [r.record_id for r in op.search(df, "world").collect()] == [1]
    assert op.search(df, "y").count() == 0  # column names are not searched
    assert json.loads(op.get_records(df, [1]).first().raw) == {"x": "world", "y": 2}
    to = out()
    export_records(df, "parquet", "jsonl", to, ids=[1])
    assert texts(to) == b'{"x":"world","y":2}\n'


def test_invalid_parquet_is_a_readable_error(spark, put):
    with pytest.raises(ValueError, match="Parquet"):
        open_dataset(spark, put("bad.parquet", "not a parquet"))


def test_subtree_root_and_children(spark, put, out):
    df = open_dataset(spark, put("subtree.json", '[{"a":{"b":[1,2,3]}}]'))
    to = out()
    export_subtree(df, ["a", "b"], "jsonl", to, include_root=True)
    assert texts(to) == b"[1,2,3]\n"
    to = out()
    assert export_subtree(df, ["a", "b"], "jsonl", to, children=[1]).first().records_written == 1
    assert texts(to) == b"2\n"
    to = out()
    export_subtree(df, ["a", "b"], "json", to, children=[0, 2])
    assert texts(to) == b"[\n1,\n3\n]\n"
    with pytest.raises(ValueError):
        export_subtree(df, ["a"], "csv", out())
    with pytest.raises(Exception, match="no value at a.c"):
        export_subtree(df, ["a", "c"], "jsonl", out())


def test_json_search_and_lookup(spark, put):
    df = open_dataset(spark, put("search.json", '[{"x":"hello"},{"x":"world"}]'))
    hit = op.search_hits(df, "world").first()
    assert hit.record_id == 1 and hit.byte_offset == 15
    assert "world" in op.get_records(df, [1]).first().raw


def test_json_array_pages(spark, put):
    df = open_dataset(spark, put("array.json", json.dumps([{"x": 1}, {"x": 2}, {"x": 3}], indent=2)))
    first = op.next_page(df, size=2).collect()
    assert len(first) == 2 and not first[0].eof
    second = op.next_page(df, record_id=2, size=2).collect()
    assert len(second) == 1 and second[0].eof


def test_other_json_shapes(spark, put):
    obj = in_order(open_dataset(spark, put("object.json", json.dumps({"x": 1, "y": "z"}, indent=2))))
    assert [(r.record_id, json.loads(r.raw)) for r in obj] == [(0, {"x": 1, "y": "z"})]
    assert len(in_order(open_dataset(spark, put("concat.json", '{"x":1}\n{"x":2}\n{"x":3}\n')))) == 3
    assert len(in_order(open_dataset(spark, put("nul.json", b'[{"x":1},{"x":2}]\n\0\0\0\0')))) == 2
    assert in_order(open_dataset(spark, put("blank.json", " \n"))) == []
    assert [r.raw for r in in_order(open_dataset(spark, put("scalar.json", "42")))] == ["42"]


def test_unknown_formats(spark, put, out):
    with pytest.raises(ValueError, match="unsupported format"):
        open_dataset(spark, put("x.txt", "a"))
    df = open_dataset(spark, put("words.jsonl", "hello\n"))
    to = out()
    with pytest.raises(ValueError, match="unsupported conversion"):
        export_records(df, "parquet", "csv", to)
    import os
    assert not os.path.exists(to)  # nothing is created for a refused request


def test_one_id_per_csv_record_in_search_and_export(spark, put, out):
    df = open_dataset(spark, put("multi.csv", 'a,b\n1,"x\ny"\n2,needle\n'))
    hits = op.search_hits(df, "needle")
    assert [r.record_id for r in hits.collect()] == [2]
    to = out()
    export_records(df, "csv", "csv", to, ids=hits)
    assert texts(to) == b"2,needle\n"


def test_all_top_level_values_are_searched_and_exported(spark, put, out):
    df = open_dataset(spark, put("several.json", '{"x":1}\n{"x":\n2}\n'))
    assert op.search(df, "2").count() == 1
    to = out()
    export_records(df, "json", "jsonl", to)
    assert [json.loads(line) for line in texts(to).splitlines()] == [{"x": 1}, {"x": 2}]


def test_empty_json_export_is_an_empty_array(spark, put, out):
    df = open_dataset(spark, put("words.jsonl", "1\n2\n"))
    for ordered in (True, False):
        to = out()
        assert export_records(df, "jsonl", "json", to, ids=[], ordered=ordered).first().records_written == 0
        written = [json.loads(p) for p in parts(to) if p]
        assert written and all(p == [] for p in written)


def test_full_last_page_reports_the_end(spark, xy):
    rows = op.next_page(read_parquet_rows(spark, xy), size=2).collect()
    assert len(rows) == 2 and rows[0].eof and rows[0].next_id is None


def test_export_keeps_record_order_across_parts(spark, put, out):
    df = open_dataset(spark, put("many.jsonl", "".join(f"{i}\n" for i in range(500))))
    to = out()
    export_records(df.repartition(7), "jsonl", "jsonl", to)
    assert texts(to).split() == [str(i).encode() for i in range(500)]
    to = out()
    export_records(df.repartition(7), "jsonl", "json", to)
    assert [v for p in parts(to) for v in json.loads(p)] == list(range(500))
