"""Search over files as they arrive: hits can be read while the scan goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rowlantern.functions.render import PREVIEW_CHARS, cut, row_line
from rowlantern.functions.search_text import matches
from rowlantern.sources.json_files import escape_globs
from rowlantern.sources.open import FORMATS, open_dataset


def stream_hits(spark: SparkSession, folder: str, query: str, fmt: str = "jsonl", schema: T.StructType | None = None,
                case_sensitive: bool = False, columns: list[str] | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of hits: file, record_id (Parquet), preview.

    The filter keeps no state.  Lines of text files have no id here, because an
    id needs the lines before it; ``start_file_search`` gives ids, file by file.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    file = F.col("_metadata.file_path").alias("file")
    if fmt == "jsonl":
        lines = reader.option("lineSep", "\n").text(folder)
        text = F.rtrim(F.make_valid_utf8("value"), F.lit("\r\n"))
        records = lines.select(file, F.lit(None).cast("long").alias("record_id"), text.alias("text"))
    elif fmt == "parquet":
        if schema is None:
            schema = spark.read.parquet(folder).schema
        rows = reader.schema(schema).parquet(folder)
        names = columns or schema.fieldNames()
        records = rows.select(file, F.col("_metadata.row_index").alias("record_id"), row_line(rows, names).alias("text"))
    else:
        raise ValueError(f"unsupported format for a streaming search: {fmt}")
    hit = records.where(matches(F.col("text"), query, case_sensitive))
    return hit.select("file", "record_id", cut(F.col("text"), PREVIEW_CHARS).alias("preview"))


def start_search(hits: DataFrame, out_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append hits to Parquet files; read them any time, cancel with ``stop()``."""
    writer = hits.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out_path)


def start_file_search(spark: SparkSession, folder: str, query: str, fmt: str, out_path: str, checkpoint: str,
                      case_sensitive: bool = False, max_files_per_trigger: int | None = None,
                      available_now: bool = False) -> StreamingQuery:
    """Search each newly arrived file as a whole, in any format, with record ids.

    Every batch of files goes through the batch readers.  Its hits are written
    to ``out_path/batch=<n>``, replacing what a broken earlier try left there.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format for a streaming search: {fmt}")
    listing = "path string, modificationTime timestamp, length long, content binary"  # content is never read
    reader = spark.readStream.format("binaryFile").schema(listing).option("pathGlobFilter", f"*.{fmt}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def search_files(batch: DataFrame, n: int) -> None:
        # Names only; the stream's own file log on the driver holds the same list.
        paths = [escape_globs(r.path) for r in batch.toLocalIterator()]
        if paths:
            hit = open_dataset(batch.sparkSession, paths, fmt).where(matches(F.col("text"), query, case_sensitive))
            shown = hit.select("file", "record_id", cut(F.col("text"), PREVIEW_CHARS).alias("preview"))
            shown.write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    writer = reader.load(folder).select("path").writeStream.foreachBatch(search_files)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
