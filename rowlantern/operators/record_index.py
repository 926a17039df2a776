"""A kept index of records: how many each file holds, so that ids lead to files.

The index is a small table, one row per file: name, size, time of change and
number of records.  A running sum over the files in order of their names numbers
the records of the whole dataset, and an id or a page is answered from the files
that hold it alone.  A file that changed since is noticed before it is read.

Versions lie side by side, each one file put in place by one rename; the latest counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowlantern.operators.paging import PAGE_SIZE
from rowlantern.session import materialise
from rowlantern.sources.files import list_files, literal_paths
from rowlantern.sources.open import format_of, open_dataset
from rowlantern.sources.parquet_files import read_parquet_rows

# Beyond so many asked-for files the dataset is opened as a whole instead of by names.
NAMED_FILES = 10_000
COLUMNS = "file string, length long, modified timestamp, records long, paths array<string>, format string"


def _count(spark: SparkSession, paths: list[str], fmt: str, options: dict) -> DataFrame:
    """(file, records); Parquet footers hold the numbers, text is read once without its contents moving."""
    if fmt == "parquet":
        rows = read_parquet_rows(spark, paths)
    else:
        rows = open_dataset(spark, paths, fmt, **({"locations": False} if fmt == "jsonl" else {}), **options)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("records"))


def index_records(spark: SparkSession, paths, index: str, fmt: str | None = None, **options) -> None:
    """Write the index of a dataset to the folder ``index``; later calls count only files that are new or changed."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    fmt = fmt or format_of(roots[0])
    listed = list_files(spark, roots)
    known = _latest(spark, index)
    version = 0
    if known is None:
        counts = listed.join(_count(spark, roots, fmt, options), "file", "left")
    else:
        version = known.agg(F.max("version")).first()[0] + 1
        old = known.where(F.col("format") == fmt).select("file", "length", "modified", "records")
        listed = materialise(listed)
        same = listed.join(old, ["file", "length", "modified"])
        fresh = listed.join(old, ["file", "length", "modified"], "left_anti")
        total = fresh.count()
        if not total and same.count() == known.count():
            return
        counts = same
        if total:
            names = roots if total > NAMED_FILES else literal_paths([r.file for r in fresh.select("file").collect()])
            counts = same.unionByName(fresh.join(_count(spark, names, fmt, options), "file", "left").select(same.columns))
    rows = counts.select("file", "length", "modified", F.coalesce("records", F.lit(0)).alias("records"),
                         F.array(*[F.lit(p) for p in roots]).alias("paths"), F.lit(fmt).alias("format"))
    # One row per file of the dataset, and a single file whose rename makes the version whole.
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{index}/version={version}")


def _latest(spark: SparkSession, index: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    kept = spark.read.schema(COLUMNS + ", version int").parquet(index)
    last = kept.agg(F.max("version")).first()[0]
    return None if last is None else kept.where(F.col("version") == last)


def indexed_files(spark: SparkSession, index: str) -> DataFrame:
    """(file, length, modified, records, first_id, paths, format): ``first_id`` is the dataset id of record 0."""
    kept = _latest(spark, index)
    if kept is None:
        raise ValueError(f"no record index: {index}")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return kept.drop("version").withColumn("first_id", F.coalesce(F.sum("records").over(before), F.lit(0)))


def changed_files(spark: SparkSession, index: str) -> DataFrame:
    """(file, change): files that are ``new``, ``gone`` or ``changed`` since the index was written."""
    kept = indexed_files(spark, index)
    paths = kept.select("paths").first()
    now = list_files(spark, paths[0]).select("file", F.struct("length", "modified").alias("now"))
    both = kept.select("file", F.struct("length", "modified").alias("then")).join(now, "file", "full_outer")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(
        F.col("now") != F.col("then"), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def locate(spark: SparkSession, index: str, ids: DataFrame | Iterable[int]) -> DataFrame:
    """(dataset_id, file, record_id) of dataset ids; repeated ids count once, unknown ones are left out.

    Ids and files meet by ranges of ids as long as an average file, so the join
    is one of equal keys and a file has no more than its share of ranges.
    """
    files = indexed_files(spark, index).where("records > 0")
    total, n = files.agg(F.sum("records"), F.count(F.lit(1))).first()
    width = max(1, -(-(total or 0) // max(n, 1)))
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(int(i),) for i in set(ids)], "dataset_id long")
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias("dataset_id")).where("dataset_id is not null").distinct()
    last = F.col("first_id") + F.col("records") - 1
    ranges = files.select("file", "first_id", last.alias("last_id"), F.explode(F.sequence(
        F.floor(F.col("first_id") / width), F.floor(last / width))).alias("range"))
    met = wanted.withColumn("range", F.floor(F.col("dataset_id") / width)).join(ranges, "range")
    return met.where("dataset_id between first_id and last_id").select(
        "dataset_id", "file", (F.col("dataset_id") - F.col("first_id")).alias("record_id"))


def _open(spark: SparkSession, index: str, files: DataFrame, options: dict) -> DataFrame | None:
    """Records of the given files of the index, after a look at their size and time."""
    kept = materialise(indexed_files(spark, index).join(files.select("file").distinct(), "file", "left_semi"))
    first = kept.first()
    if first is None:
        return None
    many = kept.count() > NAMED_FILES
    paths = list(first.paths) if many else literal_paths([r.file for r in kept.select("file").collect()])
    try:
        now = materialise(list_files(spark, paths))
    except Exception as err:
        raise ValueError(f"a file of the record index cannot be listed: {str(err).splitlines()[0]}") from err
    stale = kept.join(now, ["file", "length", "modified"], "left_anti").select("file").first()
    if stale:
        raise ValueError(f"changed since it was indexed: {stale.file}")
    return open_dataset(spark, paths, first.format, **options)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "dataset_id long, file string, record_id long, text string, raw string")


def lookup(spark: SparkSession, index: str, ids: DataFrame | Iterable[int], **options) -> DataFrame:
    """Records by dataset id, with ``dataset_id``; only files that hold an asked-for id are opened."""
    wanted = materialise(locate(spark, index, ids))
    records = _open(spark, index, wanted, options)
    if records is None:
        return _none(spark)
    return records.join(wanted, ["file", "record_id"])


def dataset_page(spark: SparkSession, index: str, dataset_id: int = 0, size: int = PAGE_SIZE, **options) -> DataFrame:
    """``size`` records from ``dataset_id`` on, over the bounds of files, with ``next_id`` (NULL at the end) and ``eof``.

    The index knows where the page ends, so no record beyond it is looked for.
    """
    if dataset_id < 0 or size < 1:
        raise ValueError("a page starts at 0 or later and has a size")
    end = dataset_id + size
    files = indexed_files(spark, index)
    total = files.agg(F.sum("records")).first()[0] or 0
    held = files.where((F.col("first_id") < end) & (F.col("first_id") + F.col("records") > dataset_id))
    held = materialise(held.select("file", "first_id"))
    records = _open(spark, index, held, options)
    if records is None:
        records = _none(spark)
    else:
        number = F.col("first_id") + F.col("record_id")
        records = records.join(F.broadcast(held), "file").withColumn("dataset_id", number).drop("first_id")
    page = records.where(F.col("dataset_id").between(dataset_id, end - 1)).orderBy("dataset_id")
    return page.withColumn("next_id", F.lit(end if end < total else None).cast("long")).withColumn(
        "eof", F.lit(end >= total))
