"""Stages of the pipeline hold batches of bounded rows, and judge a text alike in any batch."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from rowlantern.llm import byte_gru, packing, tables, toxicity

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("before, after", [("10000", 1000), ("0", 1000), ("7", 7)])
def test_batches_are_bounded(spark, before, after):
    kept = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, before)
        corpus_pipeline.packed(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
        assert int(spark.conf.get(NAME)) == after
    finally:
        spark.conf.set(NAME, kept)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["damn", "good", "été", "you", "idiot", "day", "über"], 30)) for _ in range(400)]
    model = byte_gru.ByteGRU(["de", "en", "fr"], 6)
    judged = toxicity.fit_rows([(t, t.count("idiot") > 4) for t in texts[:200]])
    for kernel in (byte_gru.predictor(model), toxicity.scorer(judged)):
        whole = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["row", "text"])
        one = pa.Table.from_batches(list(kernel(iter([whole])))).to_pydict()
        many = pa.Table.from_batches(list(kernel(whole.slice(a, 37) for a in range(0, 400, 37)))).to_pydict()
        assert one["row"] == many["row"] and one.get("lang_pred") == many.get("lang_pred")
        assert np.allclose(one["score"], many["score"], rtol=0, atol=1e-6)


@pytest.mark.parametrize("before, after", [("4096", 1000), ("7", 7)])
def test_batches_read_from_parquet_are_bounded(spark, before, after):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    kept, arrow = spark.conf.get(name), spark.conf.get(NAME)
    try:
        spark.conf.set(name, before)
        corpus_pipeline.packed(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
        assert int(spark.conf.get(name)) == after
    finally:
        spark.conf.set(name, kept)
        spark.conf.set(NAME, arrow)


@pytest.mark.parametrize("whole", [True, False])
def test_words_of_a_packing_task_are_not_kept_for_other_stages(monkeypatch, whole):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    texts = [" ".join(f"word{k} Stop{k}." for k in range(a, a + 50)) for a in (0, 50)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    task = packing._pack_task(path, 2, 4096, 16)(iter(batches))
    next(task)
    own = packing.coder(path)
    assert len(own.known) > 50
    if whole:
        assert sum(b.num_rows for b in task) == 2
    else:
        task.close()  # as when a limit is reached
    assert (own.known, own.bases, own.older) == ({"": b""}, {}, {})


def test_a_lean_kernel_gives_the_same_batches_and_then_frees(monkeypatch):
    freed = []
    pool = SimpleNamespace(release_unused=lambda: freed.append(1))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    monkeypatch.setattr(pa, "system_memory_pool", lambda: pool)
    task = tables.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))
    assert next(task) == 2 and not freed
    assert list(task) == [4, 6] and len(freed) == 2
