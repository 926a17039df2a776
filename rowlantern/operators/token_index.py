"""Indexed search: whole words to the records that hold them, kept as a table.

The index is a folder with two tables.  ``postings`` has a row per word, file
and block of BLOCK record ids with the places in that block, so a word that
stands in every record is many rows of bounded length.  Its folders are buckets
of the word's hash: a query reads the buckets of its own words and, inside them,
the row groups that may hold the word.  ``files`` names the files, with the
number of records indexed of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.operators.select import select_by_ids

#: Letters and digits of any script; all else parts words.
WORD = r"[\p{L}\p{N}]+"
BLOCK = 1 << 16
BUCKETS = 64
#: Records whose postings share a file of a bucket.
RECORDS_PER_PART = 20_000_000
POSTINGS = "word string, file_id long, block long, places array<int>, bucket int"


def words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build_index(records: DataFrame, path: str, column: str = "text", buckets: int = BUCKETS, append: bool = False) -> None:
    """Write the index of ``records`` (file, record_id and a text) to the folder ``path``.

    Words travel to their bucket in one shuffle; a bucket is dealt to several
    tasks by blocks of records, so a frequent word is no group of its own.
    A null text has no words but counts as a record.  ``append`` adds files to
    an index; a file that it already has is refused.
    """
    spark = records.sparkSession
    rows = records.select(F.xxhash64("file").alias("file_id"), "file", "record_id", F.col(column).alias("text"))
    files = rows.groupBy("file_id", "file").agg(F.count(F.lit(1)).alias("records")).withColumn("buckets", F.lit(buckets))
    if append:
        known = spark.read.parquet(f"{path}/files")
        kept = known.agg(F.max("buckets")).first()[0]
        if kept is not None:
            buckets = kept
        files = files.withColumn("buckets", F.lit(buckets))
        again = files.join(known.select("file_id"), "file_id", "left_semi").select("file").limit(1).collect()
        if again:
            raise ValueError(f"already indexed: {again[0].file}")
    mode = "append" if append else "errorifexists"
    files.write.mode(mode).parquet(f"{path}/files")
    written = spark.read.parquet(f"{path}/files")
    total, ids, names = written.agg(F.sum("records"), F.count_distinct("file_id"), F.count_distinct("file")).first()
    if ids != names:
        raise ValueError("two files have one number: index them apart")
    parts = (total or 0) // RECORDS_PER_PART + 1
    block = F.floor(F.col("record_id") / BLOCK)
    placed = rows.select("file_id", block.alias("block"), (F.col("record_id") % BLOCK).cast("int").alias("place"),
                         F.explode(words(F.col("text"))).alias("word"))
    dealt = placed.withColumn("bucket", _bucket(F.col("word"), buckets)).withColumn(
        "part", F.pmod(F.xxhash64("file_id", "block"), F.lit(parts)).cast("int")).repartition("bucket", "part")
    # Rows of one bucket, part, word, file and block are at most BLOCK and lie in one task already.
    postings = dealt.groupBy("bucket", "part", "word", "file_id", "block").agg(
        F.array_sort(F.collect_list("place")).alias("places"))
    postings.drop("part").sortWithinPartitions("bucket", "word", "file_id", "block").write.mode(mode).partitionBy(
        "bucket").parquet(f"{path}/postings")


def _asked(spark: SparkSession, query: str) -> list[str]:
    """The words of a query, by the rule that the index was built with; evaluated while planning."""
    return spark.range(1).select(words(F.lit(query)).alias("w")).first().w


def postings_of(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """Postings of the given words; buckets and words are literals, so other buckets are not read."""
    buckets = spark.read.parquet(f"{path}/files").agg(F.max("buckets")).first()[0] or BUCKETS
    table = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    if not asked:
        return table.where("false")
    numbers = spark.range(1).select(F.array(*[_bucket(F.lit(w), buckets) for w in asked]).alias("b")).first().b
    return table.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(asked))


def index_hits(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(file, record_id) of the records that hold every word of ``query``, whatever their order.

    A query without a word finds nothing.  Words are compared block by block:
    what meets in one group is one list for each word of the query.
    """
    asked = _asked(spark, query)
    found = postings_of(spark, path, asked)
    if len(asked) > 1:
        lists = found.groupBy("file_id", "block").agg(F.collect_list("places").alias("lists")).where(
            F.size("lists") == len(asked))
        common = F.aggregate(F.slice("lists", 2, len(asked)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        found = lists.withColumn("places", common)
    ids = found.select("file_id", "block", F.explode("places").alias("place")).select(
        "file_id", (F.col("block") * BLOCK + F.col("place")).alias("record_id"))
    files = spark.read.parquet(f"{path}/files").select("file_id", "file")
    return ids.join(files, "file_id").select("file", "record_id")


def indexed_search(records: DataFrame, path: str, query: str) -> DataFrame:
    """The records that hold every word of ``query``: a semi-join with the postings of its words."""
    return select_by_ids(records, index_hits(records.sparkSession, path, query))


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n_records) of every indexed word, from the lengths of its postings."""
    table = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return table.groupBy("word").agg(F.sum(F.size("places")).cast("long").alias("n_records"))
