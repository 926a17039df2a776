"""Readers against plain sequential readings of the same bytes, over many split sizes."""

import json
import random

import pytest

from rowlantern.sources import read_csv, read_json, read_jsonl
from tests.conftest import in_order

SIZES = [13, 64]


def jsonl_by_hand(data):
    out, at = [], 0
    for line in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
        size = min(len(line) + 1, len(data) - at)
        out.append((at, size, line.decode("utf-8", "replace").rstrip("\r\n")))
        at += size
    return out


def csv_by_hand(data):
    """Character by character: a quote opens at a field start only."""
    out, start, inside, fresh, i = [], 0, False, True, 0
    while i < len(data):
        c = data[i:i + 1]
        if inside:
            if c == b'"':
                if data[i + 1:i + 2] == b'"':
                    i += 1
                else:
                    inside = False
        elif c == b"\n":
            out.append((start, i + 1 - start))
            start, fresh = i + 1, True
        elif c == b",":
            fresh = True
        elif c == b'"' and fresh:
            inside, fresh = True, False
        elif not (fresh and c in b" \t"):
            fresh = False
        i += 1
    if start < len(data):
        out.append((start, len(data) - start))
    return [(a, n, data[a:a + n].decode("utf-8", "replace")) for a, n in out]


def fields_by_hand(text):
    out, cur, inside, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if inside and text[i + 1:i + 2] == '"':
                cur += '"'
                i += 1
            else:
                inside = not inside
        elif c == "," and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return out + [cur]


def random_lines(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n)).encode("utf-8", "surrogateescape")


@pytest.mark.parametrize("size", SIZES)
def test_jsonl_ids_and_offsets(spark, small_splits, put, size):
    small_splits(size)
    rng = random.Random(size)
    files = {}
    for k in range(3):
        data = random_lines(rng, ["a", "é", "中", "\r", "\n", "\n", " ", "xyz", "\udcff"], 120)
        if k == 1:
            data = b"\xef\xbb\xbf" + data
        files[put(f"lines/{k}.jsonl", data)] = data
    folder = next(iter(files)).rsplit("/", 1)[0]
    rows = in_order(read_jsonl(spark, folder))
    assert [r.record_id for r in in_order(read_jsonl(spark, folder, locations=False))] == [r.record_id for r in rows]
    for path, data in files.items():
        got = [(r.byte_offset, r.byte_len, r.text) for r in rows if r.file.endswith(path)]
        want = jsonl_by_hand(data)
        if data.startswith(b"\xef\xbb\xbf"):  # the mark belongs to the first line's bytes, not to its text
            want[0] = (*want[0][:2], want[0][2].lstrip("﻿"))
        assert got == want
        assert [r.record_id for r in rows if r.file.endswith(path)] == list(range(len(want)))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("size", SIZES)
def test_csv_records(spark, small_splits, put, size, seed):
    small_splits(size)
    rng = random.Random(seed * 100 + size)
    files = {}
    for k in range(2):
        body = random_lines(rng, ["a", '"', '""', ",", ",", "\n", "\n", " ", "\t", "é", "\r\n", '"b\nc"', ',"d,e"'], 90)
        data = b"id,name,,x\n" + body
        files[put(f"csv{k}/{k}.csv", data)] = data
    for path, data in files.items():
        rows = in_order(read_csv(spark, path))
        want = csv_by_hand(data)
        assert [r.record_id for r in rows] == list(range(len(want)))
        assert [(r.byte_offset, r.byte_len) for r in rows] == [w[:2] for w in want]

        def clean(t):
            return t[:-2] if t.endswith("\r\n") else t[:-1] if t.endswith("\n") else t

        texts = [clean(w[2]) for w in want]
        # Without a final line break a trailing CR is dropped as well: one rule for line ends.
        assert [r.text for r in rows[:-1]] == texts[:-1]
        assert rows[-1].text == texts[-1].removesuffix("\r")
        for r in rows[1:]:
            got, cells = json.loads(r.raw), fields_by_hand(r.text)
            names = ["id", "name", "col_2", "x"]
            want_obj = {n: cells[i] if i < len(cells) else "" for i, n in enumerate(names)}
            if len(cells) > 4:
                want_obj["__extra__"] = cells[4:]
            assert got == want_obj


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([0, -1, 12.5, 10**20])
    if kind == 1:
        return rng.choice([True, False, None])
    if kind in (2, 3):
        return "".join(rng.choice(['a', '"', "\\", ",", "]", "}", "[", "{", " ", "\n", "é", "中"]) for _ in range(rng.randrange(6)))
    if kind in (4, 5):
        return {rng.choice("abc,]") + str(i): random_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("layout", ["commas", "lines"])
@pytest.mark.parametrize("size", SIZES)
def test_json_arrays_and_values(spark, small_splits, put, size, layout, indent):
    small_splits(size)
    rng = random.Random(size + len(layout))
    for k in range(1, 3):
        values = [random_value(rng) for _ in range(rng.randrange(12))]
        text = json.dumps(values, indent=indent, ensure_ascii=bool(k % 2))
        data = (b"\xef\xbb\xbf" if k == 1 else b"") + text.encode() + (b"\n\x00\x00" if k == 2 else b"")
        rows = in_order(read_json(spark, put(f"arr{k}/{k}.json", data), layout=layout))
        assert [json.loads(r.raw) for r in rows] == values
        assert [r.record_id for r in rows] == list(range(len(values)))
        assert [data[r.byte_offset:r.byte_offset + r.byte_len].decode() for r in rows] == [r.raw for r in rows]

        values = [v for v in values if not isinstance(v, list)] or [{"only": 1}]
        joined = "\n".join(json.dumps(v, indent=indent) for v in values).encode()
        rows = in_order(read_json(spark, put(f"val{k}/{k}.json", joined)))
        assert [json.loads(r.raw) for r in rows] == values
        assert [joined[r.byte_offset:r.byte_offset + r.byte_len].decode() for r in rows] == [r.raw for r in rows]


def test_json_shapes_mixed_in_one_folder(spark, small_splits, put):
    small_splits(16)
    put("mix/a b.json", '[{"x":1}, {"x":2}]')
    put("mix/b.json", '{"x":1}\n{"x":2}{"y":3} 5 "s t" [1]\n\n')
    put("mix/c.json", '["  lead", ",x", "last"]')
    put("mix/d.json", "[ ]")
    folder = put("mix/e.json", " \n").rsplit("/", 1)[0]
    for layout in ("commas", "lines"):
        rows = in_order(read_json(spark, folder, layout=layout))
        assert [(r.record_id, r.raw) for r in rows] == [
            (0, '{"x":1}'), (1, '{"x":2}'),
            (0, '{"x":1}'), (1, '{"x":2}'), (2, '{"y":3}'), (3, "5"), (4, '"s t"'), (5, "[1]"),
            (0, '"  lead"'), (1, '",x"'), (2, '"last"'),
        ]


def test_text_behind_a_root_array_is_ignored(spark, small_splits, put):
    for size in SIZES:
        small_splits(size)
        for layout, gap in (("commas", " "), ("lines", "\n")):
            text = '[{"a":[1,2]},{"b":"]"}] , [7, 8], "z"'.replace(" ", gap)
            rows = in_order(read_json(spark, put(f"t{size}{layout}/t.json", text), layout=layout))
            assert [r.raw for r in rows] == ['{"a":[1,2]}', '{"b":"]"}']


def test_record_spanning_many_splits(spark, small_splits, put):
    small_splits(32)
    long = "word, " * 60 + '""' + "\n" * 20
    rows = in_order(read_csv(spark, put("wide/w.csv", f'id,text\n1,"{long}"\n2,b\n')))
    assert [json.loads(r.raw) for r in rows[1:]] == [{"id": "1", "text": long.replace('""', '"')}, {"id": "2", "text": "b"}]
    value = [{"t": "x, ]" * 60, "n": [[1, 2], {"k": None}] * 10}, 1]
    assert [json.loads(r.raw) for r in in_order(read_json(spark, put("wide/w.json", json.dumps(value))))] == value


def test_unterminated_quote_keeps_the_rest_as_one_record(spark, small_splits, put):
    small_splits(16)
    text = 'a,b\n1,2\n3,"open' + "\nmore text" * 9
    rows = in_order(read_csv(spark, put("open/o.csv", text)))
    assert [r.text for r in rows] == ["a,b", "1,2", text[8:]]


def test_oversized_record_ends_the_query(spark, small_splits, put, monkeypatch):
    from rowlantern.sources import splits
    monkeypatch.setattr(splits, "MAX_RECORD_BYTES", 200)
    small_splits(16)
    df = read_csv(spark, put("big/b.csv", 'a,b\n1,"' + "x\n" * 120 + '"\n5,6\n'))
    with pytest.raises(Exception, match="record too large for a row.*b.csv, record 1, bytes 245"):
        df.collect()


def test_wide_headers_are_not_broadcast(spark, small_splits, put, monkeypatch):
    from rowlantern.sources import splits
    monkeypatch.setattr(splits, "BROADCAST_BYTES", 1000)
    small_splits(24)
    df = read_csv(spark, put("wide/a.csv", "a,b\n" + "1,2\n" * 60))
    assert df.count() == 61


def test_scan_fails_when_splits_move_between_passes(spark, small_splits, put):
    small_splits(16)
    df = read_jsonl(spark, put("moved/m.jsonl", "line\n" * 40))
    small_splits(1000)
    with pytest.raises(Exception, match="splits changed"):
        df.collect()


def test_scan_without_broadcast(spark, small_splits, put, monkeypatch):
    """Beyond the broadcast bound the split table is joined by shuffle, with the same result."""
    from rowlantern.sources import splits
    monkeypatch.setattr(splits, "BROADCAST_SPLITS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small_splits(24)
        csv = "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(30))
        rows = in_order(read_csv(spark, put("nb/a.csv", csv)))
        assert [json.loads(r.raw) for r in rows[1:]] == [{"a": str(i), "b": f"x\n{i}"} for i in range(30)]
        values = [{"x": i, "s": "a,b]"} for i in range(30)]
        assert [json.loads(r.raw) for r in in_order(read_json(spark, put("nb/a.json", json.dumps(values))))] == values
        df = read_jsonl(spark, put("nb/a.jsonl", "".join(f"line {i}\n" for i in range(30))))
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert [(r.record_id, r.text) for r in in_order(df)] == [(i, f"line {i}") for i in range(30)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
