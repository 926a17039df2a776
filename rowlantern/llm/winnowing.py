"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are words of up to 24 characters and, in longer runs without white space
(text of scripts that do not part words, encoded data), single characters, so
that grams slide over such text by one.  Each token is hashed once; every run of
four tokens has the hash of its token hashes.  A window of eight runs keeps its
smallest hash, the rightmost of equal ones, with its position: two texts that
share a run of at least ``WINDOW + GRAM - 1`` = 11 tokens share a fingerprint of
that run, wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlantern.llm.tables import range_numbered

# White space parts words.  A word is a token if no more than 24 characters long, else each of its characters is.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,24}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
GRAM, WINDOW = 4, 8
POSITION_BITS = 31
LAST = (1 << POSITION_BITS) - 1


def _every(items: str, width: int, make) -> Column:
    """make(i) for every start of a run of ``width`` items; empty for fewer items."""
    count = F.size(items) - (width - 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, make)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with array<long> ``out``: kept grams in text order, 32 bits of hash, 31 of LAST - position.

    Shorter texts than a gram have the hash of all their tokens; texts without
    tokens have none.  Null counts as empty.  Each step is a projection of its
    own, so that no list is made twice.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0)
    df = df.withColumn(out, F.transform(tokens, lambda w: F.xxhash64(w)))
    item = lambda i: F.get(F.col(out), i)
    grams = _every(out, GRAM, lambda i: F.xxhash64(*[item(i + k) for k in range(GRAM)]))
    df = df.withColumn(out, F.when(F.size(out) >= GRAM, grams).when(
        F.size(out) > 0, F.array(F.xxhash64(F.col(out)))).otherwise(F.col(out)))
    # The smaller number has the smaller hash, and among equal hashes the larger position.
    df = df.withColumn(out, F.transform(out, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), POSITION_BITS)
                                        .bitwiseOR(F.lit(LAST) - i.cast("long"))))
    low = _every(out, WINDOW, lambda i: F.least(*[item(i + k) for k in range(WINDOW)]))
    return df.withColumn(out, F.when(F.size(out) >= WINDOW, F.array_distinct(low)).when(
        F.size(out) > 0, F.array(F.array_min(out))).otherwise(F.col(out)))


def hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: F.shiftright(x, POSITION_BITS)))


def as_text(print_: Column) -> Column:
    """``position:hash`` items, the hash in hex, in text order."""
    return F.array_join(F.transform(print_, lambda x: F.concat(
        (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"), F.lit(":"),
        F.lower(F.hex(F.shiftright(x, POSITION_BITS))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, n, next_id, asked): of distinct ids, in descending order, last to first.

    Ids are dealt by range; each range numbers itself and only the first id of
    every range is looked at beyond it.  ``asked`` is the n of the id before.
    """
    rows = range_numbered(ids, [F.desc_nulls_last("id")], "next")
    down = [F.desc_nulls_last("id")]
    here = Window.partitionBy("part").orderBy(*down)
    # Null is an id like any other, so neighbours are carried in structs.
    own = F.struct("id", "n")
    ends = rows.groupBy("part").agg(
        F.max_by(own, F.struct(F.col("id").isNotNull(), "id")).alias("first"),
        F.min_by(own, F.struct(F.col("id").isNotNull(), "id")).alias("last"))
    # One row per range: as many as partitions, not as rows.
    ranges = Window.orderBy("part")
    everything = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(ranges), F.first("first").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(ranges), F.last("last").over(everything)).alias("before"))
    return rows.select("*", F.lead(own).over(here).alias("lead"), F.lag(own).over(here).alias("lag")).join(
        ends, "part").select("id", "n", F.coalesce("lead", "after")["id"].alias("next_id"),
                             F.coalesce("lag", "before")["id"].alias("previous_id"),
                             F.coalesce("lag", "before")["n"].alias("asked"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and likenesses.

    The edited text has its last third of code points replaced by as many of the
    next document's, in descending order of id (the first follows the last).
    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).  Null texts are empty, a null id comes last in the
    order.  Rows with one id are one document to their neighbours, which take
    the smallest of its texts; each such row has its own result.  A lone
    document follows itself; an empty table gives no rows; other columns are
    not read.

    Texts are dealt out once by id; a third of each moves on to the document
    that asks for it, with the hash set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = next_ids(rows.groupBy("id").agg(F.max(F.length("text")).cast("long").alias("n")))
    known = ids.select(F.col("id").alias("own"), "previous_id", "asked")
    dealt = rows.join(known, rows["id"].eqNullSafe(known["own"])).drop("own")
    given = with_fingerprint(dealt, "text", "print").select(
        F.col("previous_id").alias("to"),
        F.substring("text", F.lit(1), F.floor(F.col("asked") / 3).cast("int")).alias("head"),
        hashes(F.col("print")).alias("next_hashes"))
    given = given.groupBy("to").agg(F.min(F.struct("head", "next_hashes")).alias("g")).select("to", "g.*")

    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    both = dealt.select("id", "text").join(given, F.col("id").eqNullSafe(F.col("to"))).select(
        "id", "text", "next_hashes", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut)).alias("edited"))
    both = with_fingerprint(with_fingerprint(both, "text", "own"), "edited", "new").drop("text")
    both = both.withColumns({"own_hashes": hashes(F.col("own")), "new_hashes": hashes(F.col("new"))})
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("new_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"))
