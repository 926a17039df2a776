"""Merkle manifest of a dataset: a hash tree per group of rows and one over the groups, with a proof per row.

Rows are numbered within their group.  The number's digits to base FAN are
grouped away one after the other inside blocks of FAN ** DIGITS rows: the rows
of a node become an array of structs, the node a struct with that array, and so
on, until a block is one row with its subtree inside.  Blocks are the leaves of
the next round, until a group is one row; the groups' roots are one more tree.
On the way down a block's row takes the path of its root, and one nested
transform gives every row in it the hashes beside its own path, which explode
turns into rows.  No join is needed, and no row holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlantern.llm.tables import partitions_of, store

FAN, DIGITS = 8, 3
BLOCK = FAN ** DIGITS
PATH = "array<struct<before:string,after:string>>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value: no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(F.concat(*map(_field, columns)))


def numbered(rows: DataFrame, group: str, order: list, label: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in their group (null first, a group like any other) and its size ``n``.

    Rows are sorted in ranges; what a range adds for each group is counted, so
    no group passes through one task.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    ranged = store(rows.repartitionByRange(partitions_of(rows), *by).sortWithinPartitions(*by).withColumn(
        "part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)
    here = Window.partitionBy(group)
    parts = ranged.groupBy("part", group).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("a")).select(
        F.col("part").alias("p"), F.col(group).alias("g"),
        (F.coalesce(F.sum("c").over(here.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.col("a")).alias("shift"), F.sum("c").over(here).alias("n"))
    same = (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))
    return ranged.join(parts, same).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "p", "g", "shift")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(group, n, rank, hash, item) to a row per block: (group, n, block, hash, kids)."""
    rows = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK)).repartition("group", "block")
    kid = F.struct("rank", "hash", F.col("item").alias("kids"))
    for k in range(DIGITS):
        rows = rows.withColumn("kid", kid).groupBy("group", "n", "block", F.floor(F.col("rank") / FAN).alias("rank")).agg(
            F.array_sort(F.collect_list("kid")).alias("kids"))
        several = F.col("n") > FAN ** k  # else this node is the only one of its level and stays as it is
        rows = rows.withColumn("hash", F.when(several, digest(F.concat_ws("", "kids.hash"))).otherwise(
            F.col("kids")[0]["hash"]))
        kid = F.struct("rank", "hash", "kids")
    return rows.select("group", "n", "block", "hash", "kids")


def _unrolled(kids: Column, n: Column, above: Column, level: int) -> Column:
    """All items below ``kids`` with the path from each to the root."""
    def one(kid, i):
        beside = F.struct(F.concat_ws("", F.slice(kids["hash"], F.lit(1), i)).alias("before"),
                          F.concat_ws("", F.slice(kids["hash"], i + 2, F.lit(FAN))).alias("after"))
        path = F.concat(F.when(n > FAN ** level, F.array(beside)).otherwise(F.array().cast(PATH)), above)
        if level:
            return _unrolled(kid["kids"], n, path, level - 1)
        return F.struct(kid["rank"].alias("rank"), kid["hash"].alias("hash"), kid["kids"].alias("item"), path.alias("path"))

    out = F.transform(kids, one)
    return F.flatten(out) if level else out


def _climb(nodes: DataFrame, label: str, top) -> DataFrame:
    """(group, n, rank, hash, item) to (group, rank, hash, item, path, subroot, root).

    ``top`` gives (group, path, subroot, root) for the groups' roots (group, hash).
    """
    blocks = store(_rolled(nodes), f"{label}-blocks")
    most = blocks.agg(F.max("n")).first()[0] or 0
    if most > BLOCK:
        above = _climb(blocks.select("group", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), "hash",
                                     F.lit(0).alias("item")), label, top).withColumnRenamed("rank", "block")
    else:
        above = top(blocks.select("group", "hash")).withColumn("block", F.lit(0).cast("long"))
    # A block and what lies above it are two rows of one key.
    both = blocks.select("group", "block", "n", "kids").unionByName(
        above.select("group", "block", "path", "subroot", "root"), allowMissingColumns=True)
    held = both.groupBy("group", "block").agg(*[
        F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "subroot", "root")])
    return held.select("group", "subroot", "root", F.explode(_unrolled(F.col("kids"), F.col("n"), F.col("path"), DIGITS - 1)).alias(
        "x")).select("group", "x.*", "subroot", "root")


def manifest(rows: DataFrame, group: str, hash_col: str, order: list, item: Column) -> DataFrame:
    """(group, rank, hash, item, path, subroot, root) of every row.

    ``path`` has, level by level from the row up to the root, the hashes before
    and after it among the at most FAN children of their parent, as text.
    """
    def alone(roots: DataFrame) -> DataFrame:
        return roots.select("group", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                            F.col("hash").alias("root"))

    def over_groups(roots: DataFrame) -> DataFrame:
        one = roots.select(F.lit(0).alias("all"), F.col("group").alias("name"), "hash")
        nodes = numbered(one, "all", [F.col("name").asc_nulls_first()], "merkle-groups").select(
            F.lit(0).alias("group"), "n", "rank", "hash", F.struct("name").alias("item"))
        return _climb(nodes, "merkle-root", alone).select(
            F.col("item.name").alias("group"), "path", F.col("hash").alias("subroot"), "root")

    nodes = numbered(rows.withColumn("item", item), group, order, "merkle-leaves").select(
        F.col(group).alias("group"), "n", "rank", F.col(hash_col).alias("hash"), "item")
    return _climb(nodes, "merkle", over_groups)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def prove(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    A leaf is the hash of doc_id, source, lang, n_chars and text, each with its
    length or ``-`` for null; trees are by lang (null is one of them, the
    first), leaves ascend by doc_id (null first, then by leaf), and the roots of
    the trees ascend by lang.  ``folded_root`` starts from the row as read again:
    where 3 divides the checksum of the id, its text is lower-cased, and the
    row is verified only if that changed nothing.  A null id is read as it is.
    Repeated rows are leaves each and have equal hashes but places of their
    own; an empty table gives no rows; other columns are not read.

    Documents cross the network as two hashes and an id.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    fields = [F.col(c) for c in names]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf([*fields, F.col("text")]).alias("leaf"),
                       F.when(changed, leaf([*fields, F.translate("text", CAPITALS, SMALL)])).alias("read"))
    # Leaves and their changed copies travel as 32 bytes each.
    out = manifest(rows, "lang", "leaf", [F.col("doc_id").asc_nulls_first(), F.col("leaf")],
                   F.struct("doc_id", F.unhex("read").alias("read")))
    again = folded(F.coalesce(F.lower(F.hex("item.read")), F.col("hash")), F.col("path"))
    beside = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    return out.select(F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
                      digest(F.concat_ws("", beside)).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
