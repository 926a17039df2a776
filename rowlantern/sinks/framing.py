"""JSON array framing of one part file: each part is a valid array by itself."""

import pyarrow as pa
import pyarrow.compute as pc


def json_array(batches):
    yield _lines(["["])
    held, none = None, True
    for batch in batches:
        values = pc.fill_null(batch.column(0), "null")
        if not len(values):
            continue
        if not none:
            yield _lines([held + ","])
        held, none = values[-1].as_py(), False
        if len(values) > 1:
            # Joined inside Arrow: Python strings would be two more copies.
            yield _lines(pc.binary_join_element_wise(values.slice(0, len(values) - 1), ",", ""))
    yield _lines(["]"] if none else [held, "]"])


def _lines(values):
    values = values.cast(pa.string()) if isinstance(values, pa.Array) else pa.array(values, pa.string())
    return pa.RecordBatch.from_arrays([values], names=["value"])
