"""Connected components of a table of edges, by hooking and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlantern.llm.tables import store


def _parents(edges: DataFrame) -> DataFrame:
    """(v, p): the smallest of a vertex and its neighbours; counted before the shuffle."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))


def _jumped(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("v").alias("u"), F.col("p").alias("q"))
    return parents.join(up, F.col("p") == F.col("u")).select("v", F.col("q").alias("p"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b): the smallest vertex reachable from it.

    Every round hooks each vertex to its smallest neighbour, jumps twice, and
    keeps the edges between what is left; rounds end when no edge is.  All
    of it is joins and partial minima, so a vertex with very many edges is no
    group of its own.  Each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = store(edges.distinct(), f"{label}-edges")
    maps = []
    while edges.limit(1).count():
        parents = store(_jumped(_jumped(_parents(edges))), f"{label}-parents")
        maps.append(parents)
        at = [parents.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab"]
        moved = edges.join(at[0], "a").join(at[1], "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = store(moved.distinct(), f"{label}-edges")
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    found = maps[0].select("v", F.col("p").alias("c"))
    for later in maps[1:]:
        up = later.select(F.col("v").alias("u"), F.col("p").alias("q"))
        found = found.join(up, F.col("c") == F.col("u"), "left").select("v", F.coalesce("q", "c").alias("c"))
    return found
