"""Framing a part as a JSON array, batch by batch."""

import pyarrow as pa

from rowlantern.sinks import framing
from tests.test_bounded_memory import peak


def test_array_framing_holds_no_python_strings():
    values = pa.array(["中" * 1000] * 5000, pa.string())
    n, held = peak(framing.json_array, pa.RecordBatch.from_arrays([values], names=["value"]))
    assert n == 5002 and held < 1 << 20


def test_array_framing_keeps_order_and_nulls():
    batches = [["a", None], [], ["b"], ["c", "d", None]]
    found = framing.json_array(pa.RecordBatch.from_arrays([pa.array(b, pa.string())], names=["value"]) for b in batches)
    assert [v for b in found for v in b.column(0).to_pylist()] == ["[", "a,", "null,", "b,", "c,", "d,", "null", "]"]
