"""Record numbering and stitching for text files that Spark reads in splits.

One pass gives a row per split; window SQL over those rows turns them into the
entry state, first record id and byte offset of every split; a second pass
numbers and cuts the records.  Text is never shuffled, except for the records
that straddle a split boundary.

The per-split table has one row per file split (100 TB at 128 MB: 800,000 rows)
and is written once to the checkpoint folder.  It is broadcast only while its
row count is within ``BROADCAST_SPLITS`` (some 200 MB); beyond that the pieces
are shuffled by split and put back in order.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.session import materialise, pin_split_layout
from rowlantern.sources import kernels

# Workers get the helpers with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(kernels)

SPLIT_KEY = ["file", "block_start", "block_length"]
# The split table is broadcast within both bounds: rows, and bytes with paths and headers.
BROADCAST_SPLITS, BROADCAST_BYTES = 1_000_000, 128 << 20
# A Spark row cannot exceed 2 GB; a longer record ends the query.
MAX_RECORD_BYTES = 2_000_000_000


def scan_pieces(spark: SparkSession, paths, sep: str) -> DataFrame:
    """Text between separators, with its split and its position in the task."""
    pin_split_layout(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("lineSep", sep).text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_block_length").alias("block_length"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("seq"),
    )


def piece_bytes() -> Column:
    return F.octet_length("value").cast("long") + 1


def attach_splits(pieces: DataFrame, splits: DataFrame, n_splits: int, columns: list[str]) -> DataFrame:
    """Join each piece to its split row; fail rather than number rows wrongly."""
    small = splits.select(*SPLIT_KEY, "first_seq", "n_pieces", *columns)
    texts = [F.octet_length(f.name) for f in small.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = small.agg(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(128)).cast("long"))).first()[0] or 0
    broadcast = n_splits <= BROADCAST_SPLITS and size <= BROADCAST_BYTES
    joined = pieces.join(F.broadcast(small) if broadcast else small, SPLIT_KEY, "left")
    moved = F.raise_error(F.lit("file splits changed between two scans of the same data"))
    at = F.col("seq") - F.col("first_seq")
    inside = F.col("first_seq").isNotNull() & (at >= 0) & (at < F.col("n_pieces"))
    placed = joined.withColumn("piece", F.when(inside, at).otherwise(moved.cast("long")))
    # A broadcast join leaves rows in scan order; a shuffled one must restore it.
    return placed if broadcast else placed.sortWithinPartitions(*SPLIT_KEY, "piece")


def _before(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


# Bytes of a leading byte-order mark, which the line reader swallows: pieces plus
# one separator each add up to the file size, or to one more when the last
# separator is missing; a surplus of two or three is the mark.
_MARK = "IF(file_size - total >= 2, 3, 0)"
_WINDOWS = """WINDOW upto AS (PARTITION BY file ORDER BY block_start ROWS UNBOUNDED PRECEDING),
    before AS (PARTITION BY file ORDER BY block_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY file ORDER BY block_start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    whole AS (PARTITION BY file ORDER BY block_start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

_PLACE_LINES = f"""
WITH a AS (
    SELECT *, coalesce(sum(n_pieces) OVER before, 0) AS base_id, coalesce(sum(n_bytes) OVER before, 0) AS raw_off,
           sum(n_bytes) OVER whole AS total
    FROM {{splits}} {_WINDOWS})
SELECT *, {_MARK} AS bom, raw_off + {_MARK} AS base_off FROM a
"""

# A split maps the quote state {closed, open} to itself, swaps it, or forces it,
# so the state on entry is the last forced value, flipped once per later swap.
# Bracket depth, record counts and bytes then add up as plain prefix sums.
_PLACE_CARRIED = f"""
WITH a AS (
    SELECT *, int(out0 = 1 AND out1 = 0) AS swap FROM {{summary}}
), b AS (
    SELECT *, sum(swap) OVER upto AS swaps, coalesce(sum(swap) OVER before, 0) AS swaps_before,
           coalesce(sum(n_bytes) OVER before, 0) AS raw_off, sum(n_bytes) OVER whole AS total,
           first_value(head) OVER upto AS file_head
    FROM a {_WINDOWS}
), c AS (
    SELECT *, int((coalesce(last_value(IF(out0 = out1, out0 + swaps, NULL)) IGNORE NULLS OVER before, 0)
                   + swaps_before) % 2) AS entry_inside
    FROM b {_WINDOWS}
), d AS (
    SELECT *, IF(entry_inside = 0, out0, out1) AS exit_inside,
           int(coalesce(sum(IF(entry_inside = 0, delta0, delta1)) OVER before, 0)) AS entry_depth,
           int(sum(IF(entry_inside = 0, delta0, delta1)) OVER upto) AS exit_depth
    FROM c {_WINDOWS}
), e AS (
    SELECT *, try_element_at(filter(starts, s -> s.inside = entry_inside AND s.rel = {{level}} - entry_depth), 1) AS any_start,
           try_element_at(filter(closes, s -> s.inside = entry_inside AND s.rel = -entry_depth AND {{level}} > 0), 1) AS close
    FROM d
), f AS (
    SELECT *, coalesce(max(close IS NOT NULL) OVER before, false) AS closed_before FROM e {_WINDOWS}
), g AS (
    -- Starts behind the end of the root value belong to nothing.
    SELECT *, IF(NOT closed_before AND (close IS NULL OR any_start.first_off < close.off), any_start, NULL) AS start FROM f
), h AS (
    -- Where the record that is still open at a split's end stops.
    SELECT *, coalesce(start.n, 0) AS n_starts,
           coalesce(first_value(least(raw_off + start.first_off, raw_off + close.off)) IGNORE NULLS OVER after, file_size)
               - raw_off - start.last_off AS tail_span
    FROM g {_WINDOWS}
)
SELECT file, block_start, block_length, file_size, first_seq, n_pieces, n_bytes, entry_inside, entry_depth,
       closed_before, close, start, n_starts, file_head AS head, raw_off, tail_span,
       last_value(tail_span) IGNORE NULLS OVER before AS head_span,
       NOT closed_before AND (entry_inside = 1 OR entry_depth > {{level}}) AS entry_open,
       NOT closed_before AND close IS NULL AND (exit_inside = 1 OR exit_depth > {{level}}) AS exit_open,
       coalesce(sum(n_starts) OVER before, 0) AS base_id, {_MARK} AS bom, raw_off + {_MARK} AS base_off
FROM h {_WINDOWS}
"""


def place_lines(per_split: DataFrame) -> DataFrame:
    """First record id and byte offset of each split when every piece is a record."""
    return per_split.sparkSession.sql(_PLACE_LINES, splits=per_split)


def place_carried(summary: DataFrame, level: int) -> DataFrame:
    """Entry state, first record id and byte offset of each split, composed along its file."""
    return summary.sparkSession.sql(_PLACE_CARRIED, summary=summary, level=level)


def info_once(columns: list[str]) -> Column:
    """Split facts, as one text, on the first row of a split only; tasks read rows in order.

    A struct would cost one Arrow column per field and row.
    """
    facts = F.struct(*[F.col(c) for c in columns], F.base64("head").alias("head"))
    return F.when(F.col("piece") == 0, F.to_json(facts, {"ignoreNullFields": "false"})).alias("info")


def summarise(pieces: DataFrame, kernel, value: Column, lengths: bool = False) -> DataFrame:
    """Run a summary kernel: one output row per split."""
    # One column for all split facts: each column costs about as much as a short text.
    split = F.concat_ws("|", "block_start", "block_length", "file_size", "file").alias("split")
    extra = [piece_bytes().alias("len")] if lengths else []
    return pieces.select(value.alias("value"), split, "seq", *extra).mapInArrow(kernel, kernels.SUMMARY_DDL)


def carried_splits(pieces: DataFrame, kernel, value: Column, level: int, lengths: bool = False) -> DataFrame:
    """The placed per-split table, written once so later scans only read it."""
    return materialise(place_carried(summarise(pieces, kernel, value, lengths), level))


def overview(splits: DataFrame):
    """Counts that steer the second pass, from one look at the per-split table."""
    first = F.col("block_start") == 0
    return splits.agg(
        F.count("*").alias("n_splits"),
        F.count_if(F.col("entry_open") | F.col("exit_open")).alias("cut"),
        F.count_if(first & F.col("head").isNull()).alias("headless"),
        F.count_if(first & F.coalesce(F.col("head") == F.lit(b"["), F.lit(False))).alias("arrays"),
        F.count_if(first & F.coalesce(F.col("head") != F.lit(b"["), F.lit(True))).alias("others"),
    ).first()


def assemble(pieces: DataFrame, splits: DataFrame, n_splits: int, kernel) -> DataFrame:
    """Records that begin and end inside one split, cut without any shuffle."""
    facts = ["block_start", "file", "file_size", "entry_inside", "entry_depth", "closed_before",
             "base_id", "base_off", "bom"]
    joined = attach_splits(pieces, splits, n_splits, ["entry_inside", "entry_depth", "closed_before",
                                            "base_id", "base_off", "bom", "head"])
    fed = joined.select(F.col("value").cast("binary").alias("value"), info_once(facts))
    return fed.mapInArrow(kernel, kernels.RECORDS_DDL)


def straddling_records(pieces: DataFrame, splits: DataFrame, n_splits: int, sep: str) -> DataFrame:
    """Records cut by a split boundary, put together from their pieces only.

    Yields file, record_id, byte_offset, byte_len, body (binary).  A record over
    ``MAX_RECORD_BYTES`` ends the query with its file, id and length.
    """
    spans = ["start", "close", "entry_open", "exit_open", "n_starts", "base_id", "base_off",
             "head_span", "tail_span"]
    facts = attach_splits(pieces, splits, n_splits, spans).where("entry_open or exit_open")
    value, size = F.col("value").cast("binary"), F.octet_length("value")
    none = F.col("n_starts") == 0

    closes = F.col("close").isNotNull() & (none | (F.col("close.off") < F.col("start.first_off")))
    end_piece = (F.when(closes, F.col("close.piece")).when(none, F.col("n_pieces"))
                 .otherwise(F.col("start.first_piece")))
    end_byte = F.when(closes, F.col("close.byte")).when(none, 0).otherwise(F.col("start.first_byte"))
    in_head = F.col("entry_open") & (
        (F.col("piece") < end_piece) | ((F.col("piece") == end_piece) & (end_byte > 0)))
    head_len = F.when(F.col("piece") == end_piece, end_byte).otherwise(size).cast("int")
    in_tail = F.col("exit_open") & ~none & (F.col("piece") >= F.col("start.last_piece"))
    opens = F.col("piece") == F.col("start.last_piece")
    skip = F.when(opens, F.col("start.last_byte")).otherwise(0).cast("int")

    def part(record_id, begins, span, text):
        keep = span <= MAX_RECORD_BYTES
        return F.struct(
            record_id.alias("record_id"), begins.alias("begins"), span.alias("span"),
            F.when(keep, text).alias("text"))

    rows = facts.select("file", "block_start", "piece", F.inline(F.array_compact(F.array(
        F.when(in_head & (F.col("head_span") <= MAX_RECORD_BYTES), part(
            F.col("base_id") - 1, F.lit(None).cast("long"), F.col("head_span"),
            F.substring(value, F.lit(1), head_len))),
        F.when(in_tail & (opens | (F.col("tail_span") <= MAX_RECORD_BYTES)), part(
            F.col("base_id") + F.col("n_starts") - 1,
            F.when(opens, F.col("base_off") + F.col("start.last_off")),
            F.col("tail_span"), F.substring(value, skip + 1, size))),
    ))))
    ordered = F.array_sort(F.collect_list(F.struct("block_start", "piece", F.col("text").cast("string").alias("text"))))
    return rows.groupBy("file", "record_id").agg(
        F.max("begins").alias("byte_offset"), F.max("span").alias("span"), ordered.alias("parts"),
    ).select(
        "file", "record_id", "byte_offset", F.col("span").alias("byte_len"),
        F.when(F.col("span") <= MAX_RECORD_BYTES, F.array_join(
            F.transform("parts", lambda p: p["text"]), sep)).otherwise(F.raise_error(F.concat(
                F.lit("record too large for a row: "), F.col("file"), F.lit(", record "), F.col("record_id").cast("string"),
                F.lit(", bytes "), F.col("span").cast("string"))).cast("string")).cast("binary").alias("body"))
