"""Session settings the readers rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings worth having in any session that uses this package; none is forced.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows can be megabytes wide: bound an Arrow batch by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rowlantern")
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none uses a folder below its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df):
    """Write ``df`` once and read it back: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def pin_split_layout(spark: SparkSession) -> None:
    """Keep file splits the same from one scan to the next.

    Spark derives the split size from the cores registered at that moment, so
    two scans of one plan could cut files differently while executors come and
    go.  Fixing ``spark.sql.files.minPartitionNum`` removes that dependency.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = max(1, spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
