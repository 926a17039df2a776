"""What a Python worker holds does not follow the size of an Arrow batch."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rowlantern.sources import kernels, read_csv, read_json
from tests.conftest import in_order


def pieces(lines, **more):
    return pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.binary()), **more})


def peak(kernel, batch):
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in kernel(iter([batch])))
        return found, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("sep", [b"\n", b","])
def test_json_kernels_hold_a_part_of_a_large_batch(sep):
    record = json.dumps({"id": 1, "text": 'a "b" \\' * 300}).encode()
    lines = [b"[" + record, *([b"," * (sep == b"\n") + record] * 8000), b"]"]
    size = sum(map(len, lines))
    split = [f"0|{size}|{size}|f"] * len(lines)
    n, held = peak(kernels.summarise_json(sep), pieces(lines, split=split, seq=np.arange(len(lines))))
    assert n == 1 and held < 5 * size
    facts = {"block_start": 0, "file": "f", "file_size": size, "entry_inside": 0, "entry_depth": 0,
             "closed_before": False, "base_id": 0, "base_off": 0, "bom": 0, "head": None}
    info = pa.array([json.dumps(facts)] + [None] * (len(lines) - 1), pa.string())
    n, held = peak(kernels.assemble_json(sep, True), pieces(lines, info=info))
    assert n == 8001 and held < 5 * size


@pytest.mark.parametrize("chunk", [1, 7, 40])
def test_records_are_the_same_in_portions_of_any_size(spark, put, monkeypatch, chunk):
    array = put("array/a.json", '\n[ {"a": "x,\\\\\\"]\\n", "b": [1,\n 2]},\n {"c": null}, 3,\n"[",\n[[], {}]\n]\n')
    values = put("values/v.json", '{"a": 1}\n[2,\n{"b": "\\\\"}] "x"\n\n7')
    table = put("table/t.csv", 'a,b\n1,"x\n""y"",\nz"\n2,\n"3",4\n')
    read = [lambda: read_json(spark, array, layout=layout) for layout in ("commas", "lines")]
    read += [lambda: read_json(spark, values), lambda: read_csv(spark, table)]
    whole = [in_order(r()) for r in read]
    monkeypatch.setattr(kernels, "CHUNK_BYTES", chunk)
    assert [in_order(r()) for r in read] == whole
