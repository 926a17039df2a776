"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level the children of a node draw ``-ln(u) / weight`` with ``u`` from a
hash of the row's key and the child's name; the smallest draw wins.  A child's
chance is its weight, and a draw depends on nothing but key, name and weight:
when the weight of one subtree grows, rows move only into that subtree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlantern.llm.tables import range_numbered

HASH_BITS = 52
BLOCK = 1 << 16


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Leaf(f"r{s // (per_rack * racks)}", f"k{s // per_rack}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own.

    Only the root gets a new child, so the new shard takes rows from all others
    and no row moves between those.
    """
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"r+{new}", f"k+{new}", new, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), key)), 1, HASH_BITS // 4), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float((1 << HASH_BITS) + 1))) / F.lit(float(weight))


def _winner(key: Column, level: str, weights: dict) -> Column:
    draws = [F.struct(_draw(key, f"{level}/{name}", w).alias("d"), F.lit(name).alias("name"))
             for name, w in weights.items()]
    return draws[0]["name"] if len(draws) == 1 else F.array_min(F.array(*draws))["name"]


def _weights(leaves: list[Leaf], field: str) -> dict:
    total: dict = {}
    for leaf in leaves:
        name = getattr(leaf, field)
        total[name] = total.get(name, 0.0) + leaf.weight
    return total


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """Shard of a row: three draws, each among the children of the node reached."""
    def below(leaves, fields):
        field, rest = fields[0], fields[1:]
        weights = _weights(leaves, field)
        won = _winner(key, field, weights)
        if not rest:
            return won
        found = None
        for name in weights:
            child = below([x for x in leaves if getattr(x, field) == name], rest)
            found = F.when(won == name, child) if found is None else found.when(won == name, child)
        return found

    return below([x for x in tree if x.weight > 0], ["region", "rack", "shard"])


def place(docs: DataFrame, tree: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and place of every row under the law ``key``.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard).  ``size``
    is the text's UTF-8 bytes plus 1.  A row's shard depends on its id and the
    tree alone; ``grown_shard`` is where it would be with one more shard.  Slots
    count from 0 in each shard, by id, size and checksum.  A null text is empty;
    a null id is hashed as the empty string and comes first; repeated rows are
    counted before any shuffle and get neighbouring slots; an empty table gives
    no rows; other columns are not read.
    """
    doc, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(doc.cast("string"), F.lit(""))
    copies = docs.select(
        doc.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key")).groupBy(
        "doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("copies"))
    rows = copies.select(
        "doc_id", "size", "text_crc32", "copies", shard_of(F.col("key"), tree).cast("int").alias("shard"),
        shard_of(F.col("key"), grown(tree)).cast("int").alias("grown_shard"))
    order = ["doc_id", "size", "text_crc32"]
    rows = range_numbered(rows, order, "shards")

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(first, ["shard", "part"])
    # Copies unfold in bounded steps, so that no array grows with their number.
    last = F.col("copies") - 1
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(last / BLOCK))))
    each = steps.withColumn("copy", F.explode(F.sequence(
        F.col("step") * BLOCK, F.least(last, F.col("step") * BLOCK + (BLOCK - 1)))))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("ahead") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
