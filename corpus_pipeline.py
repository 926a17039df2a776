"""A corpus pipeline: language, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowlantern.llm import byte_gru, chosen_path, packing, paragraphs, toxicity
from rowlantern.llm.tables import ready, store

#: Least mean probability of the most likely language; below it a document is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Toxicity score from which on a document is rejected.
TOXIC_FROM = 0.5
#: Rows hold whole texts: an executor's cores each have a batch in the JVM and in Python.
BATCH_ROWS = 1000
#: Five-word shingles, alike from 0.8 on.
SHINGLE, PERCENT = 5, 80


def _small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session, Arrow's and those read from Parquet, to ``BATCH_ROWS``; fewer, if it has them so, stay."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; `und` (null texts, texts without a letter) and unsure ones go.

    Without any ``lang`` to learn from, all stay.  Repeated rows are judged each;
    an empty table gives no rows; columns beyond those of documents stay.
    """
    _small_batches(spark)
    return byte_gru.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; null texts are judged as empty, repeated rows each.

    Unless ``labels`` has both kinds, all stay.  An empty table gives no rows; all columns stay.
    """
    _small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; of rows with one id and text, one.

    Null texts and texts without a word are alike to nothing and stay, as do
    rows without an id that are alike to nothing; an empty table gives no rows.
    """
    _small_batches(spark)
    return chosen_path.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the document of the smallest id among those with them keeps.

    Null and short texts stay as they are; repeats inside a document are not
    removed; ``n_chars`` is counted anew; an empty table gives no rows.
    """
    _small_batches(spark)
    return paragraphs.drop_passages(docs, length_col="n_chars", percent=PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens; a null text is its end mark alone, repeated rows are packed each."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("passages", passages),
          ("packing", packed)]

#: The stages are trained networks, trees and sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
