"""What lies in a folder: every file and directory, with its format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.operators.search import first_in_order, numbered
from rowlantern.sources.open import FORMATS


def catalog(spark: SparkSession, root: str, max_depth: int | None = None,
            max_nodes: int | None = None) -> DataFrame:
    """One row per node, parents before children, directories first, then by name.

    ``ordinal`` is the place in that order; ``truncated`` tells whether nodes
    beyond ``max_nodes`` exist.  All nodes are listed unless a bound is asked
    for.  File contents are not read.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    base = _uri(spark, root)
    inner = F.split(F.substring(F.col("path"), len(base) + 2, 1 << 30), "/")
    files = listing.select("path", "length", "modified", inner.alias("parts"))
    below = files.where(F.size("parts") > 1).select(F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"), "parts")
    dirs = below.select(F.slice("parts", F.lit(1), F.col("n")).alias("parts")).distinct().select(
        F.concat_ws("/", F.lit(base), F.array_join("parts", "/")).alias("path"),
        F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"),
        "parts", F.lit("dir").alias("kind"))
    nodes = files.withColumn("kind", F.lit("file")).unionByName(dirs)
    if max_depth is not None:
        nodes = nodes.where(F.size("parts") <= max_depth)

    last = F.element_at("parts", -1)
    ext = F.lower(F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise(""))
    fmt = F.when(F.col("kind") == "dir", F.lit(None)).when(ext.isin(*FORMATS), ext).otherwise("unknown")
    own = F.when(F.col("kind") == "dir", "0").otherwise("1")
    # All but the last part of a path are directories.
    key = F.concat(
        F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.concat(F.lit("0"), F.lower(p))),
        F.array(F.concat(own, F.lower(last))))
    shaped = nodes.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), last.alias("name"),
        F.size("parts").alias("depth"), "kind", fmt.alias("format"),
        (F.coalesce(fmt, F.lit("unknown")) != "unknown").alias("supported"),
        "length", "modified", key.alias("sort_key"))
    columns = ["ordinal", "path", "parent", "name", "depth", "kind", "format", "supported", "length", "modified"]
    if max_nodes is None:
        rows = numbered(shaped, ["sort_key", "path"], "place")
        return rows.withColumn("ordinal", (F.col("place") + 1).cast("int")).select(*columns, F.lit(False).alias("truncated"))
    # The root counts as a node.
    rows = first_in_order(shaped, ["sort_key", "path"], max_nodes - 1)
    return rows.withColumn("ordinal", (F.col("hit_no") + 1).cast("int")).select(*columns, "truncated")


def _uri(spark: SparkSession, root: str) -> str:
    """The folder as the file system itself writes it, to cut it off listed paths."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")
