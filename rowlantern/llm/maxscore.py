"""Exact top-k search by MaxScore over integer vectors, shard by shard.

A vector is a document and its components are its terms.  A component is kept
as its distance from the shard's least favourable value, so that every term of
a query contributes at least 0 and at most its score bound.  Per query, the terms
with the smallest bounds are non-essential as long as they cannot lift a
vector over the k-th best score found so far; essential postings are traversed for
all vectors, and the non-essential ones are probed, largest bound first, only
for vectors that are still competitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
STEP, PROBE = 2048, 8
# Doubles hold every whole number below; results are 64-bit.
EXACT, LEAST, MOST = 1 << 53, -(1 << 63), (1 << 63) - 1
# Tasks that tiles are dealt to at most; a task searches its tiles one after the other.
TILE_TASKS = 20_000


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if it or a component is null or not finite.

    A component beyond 64 bits becomes the nearest 64-bit number.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def best(keep_ids: np.ndarray, keep_scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then smallest id."""
    if keep_scores.dtype == object:
        return np.array(sorted(range(len(keep_ids)), key=lambda i: (-keep_scores[i], keep_ids[i]))[:k], np.int64)
    return np.lexsort((keep_ids, -keep_scores))[:k]


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                 k: int) -> list[tuple[int, int, int]]:
    """The k best of one shard for each query, its own row left out.

    Postings are kept term by term, vectors of great length first, so that the
    limit is high early.  Scores are exact: whole numbers are held as doubles
    for a query none of whose sums can reach 2**53 in this shard, and else as
    Python integers.  A score beyond 64 bits is ranked by its exact value and
    shown as the nearest 64-bit number.
    """
    found = []
    if not len(ids):
        return found
    sizes = np.abs(vectors.astype(np.float64)).sum(axis=1)
    order = np.lexsort((ids, -sizes))
    ids, postings = ids[order], np.ascontiguousarray(vectors[order].T)
    low, high = postings.min(axis=1, initial=0), postings.max(axis=1, initial=0)
    quick, exact = postings.astype(np.float64), None
    for qid, q in zip(query_ids, queries):
        reach = sum(abs(int(x)) * max(int(h), -int(l)) for x, l, h in zip(q, low, high))
        # Bounds and offsets are differences of such sums, so they stay within twice the reach.
        if 4 * reach < EXACT:
            top_ids, top = _search_one(qid, q.astype(np.float64), ids, quick, k)
        else:
            exact = postings.astype(object) if exact is None else exact
            top_ids, top = _search_one(qid, q.astype(object), ids, exact, k)
        found += [(int(qid), int(i), max(LEAST, min(MOST, int(s)))) for i, s in zip(top_ids, top)]
    return found


def _search_one(qid: int, q: np.ndarray, ids: np.ndarray, postings: np.ndarray, k: int):
    """Ids and scores of the k best rows for one query, in the number type of ``postings``."""
    low, high = postings.min(axis=1), postings.max(axis=1)
    # Contribution of term t to a vector x: q[t] * x[t], counted from its least value here.
    least = np.minimum(q * low, q * high)
    bound = np.maximum(q * low, q * high) - least
    order = np.argsort(bound, kind="stable")
    reach = np.cumsum(bound[order])
    offset = least.sum()
    top_ids, top = np.empty(0, np.int64), np.empty(0, postings.dtype)
    for start in range(0, len(ids), STEP):
        part, part_ids = slice(start, start + STEP), ids[start:start + STEP]
        limit = top[-1] - offset if len(top) == k else -np.inf
        # Terms before `split` in order of bound cannot lift a vector over the limit together.
        split = int(np.searchsorted(reach, limit, side="left"))
        if split == len(order) and len(order) and reach[-1] < limit:
            break
        # Only the postings of essential terms are gone through.
        essential, others = order[split:], order[:split][::-1]
        score = q[essential] @ postings[essential, part] - least[essential].sum()
        rest = reach[split - 1] if split else 0
        alive = np.flatnonzero((score + rest >= limit) & (part_ids != qid))
        score = score[alive]
        for i in range(0, len(others), PROBE):
            if not len(alive):
                break
            terms = others[i:i + PROBE]
            score = score + q[terms] @ postings[np.ix_(terms, start + alive)] - least[terms].sum()
            rest = reach[split - i - len(terms) - 1] if split > i + len(terms) else 0
            still = score + rest >= limit
            alive, score = alive[still], score[still]
        top_ids = np.concatenate([top_ids, part_ids[alive]])
        top = np.concatenate([top, score + offset])
        keep = best(top_ids, top, k)
        top_ids, top = top_ids[keep], top[keep]
    return top_ids, top


def _search_tiles(k: int, queries_per_step: int = 512):
    """Groups sorted by (tile, is_query): a shard's vectors first, then queries against it."""
    def run(batches: Iterator[pa.RecordBatch]):
        tile, ids, rows, shard, waiting = None, [], [], None, []

        def answer():
            nonlocal waiting, shard, ids, rows
            out = []
            if waiting and (rows or shard is not None):
                if shard is None:
                    shard = (np.array(ids, np.int64), np.array(rows, np.int64))
                    ids, rows = [], []
                out = search_shard(np.array([w[0] for w in waiting], np.int64),
                                   np.array([w[1] for w in waiting], np.int64), *shard, k)
            waiting = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 3, FOUND)], schema=FOUND)

        for batch in batches:
            for at, is_query, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if at != tile:
                    yield answer()
                    tile, ids, rows, shard = at, [], [], None
                if is_query:
                    waiting.append((vec_id, vector))
                    if len(waiting) >= queries_per_step:
                        yield answer()
                else:
                    ids.append(vec_id)
                    rows.append(vector)
        yield answer()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 8192, query_rows: int = 8192,
          id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query.

    ``vectors`` holds an id and an array<long>; ``is_query`` marks the queries.
    A query's own id is no candidate; ties go to the smaller id; ranks count
    from 1; a query with fewer candidates has them all.  Rows with a null id or
    vector, or whose length is not the most frequent one, take no part.  Of
    rows with one id, each is a candidate and the query is the smallest vector.
    An empty table gives no rows; other columns are not read.  Scores are exact
    to 64 bits; beyond them the order is exact within a shard, the score shown and the
    order between shards are those of the nearest 64-bit number.

    Vectors are dealt to shards and queries to groups by hash; each (shard, group) tile
    is searched by itself, and the shards' results are merged by a window per query.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"),
                          is_query.alias("query")).where("vec_id is not null and vector is not null")
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("query").cast("long")).alias("queries"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                           F.lit(0).cast("long").alias("score")).limit(0)
    rows = rows.where(F.size("vector") == usual["n"])
    shards = max(1, -(-usual["rows"] // shard_rows))
    groups = max(1, -(-(usual["queries"] or 0) // query_rows))
    place = F.xxhash64("vec_id", "vector")
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(place, F.lit(shards)).alias("shard"),
        F.lit(False).alias("is_query"), "vec_id", "vector")
    asked = rows.where("query").groupBy("vec_id").agg(F.min("vector").alias("vector")).select(
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.lit(True).alias("is_query"), "vec_id", "vector")
    tile = F.col("group").cast("long") * shards + F.col("shard")
    dealt = candidates.unionByName(asked).select(tile.alias("tile"), "is_query", "vec_id", "vector")
    tasks = min(shards * groups, TILE_TASKS)
    # By number, not by hash, so that every task has as many tiles as the next one.
    dealt = dealt.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int"))
    dealt = dealt.sortWithinPartitions("tile", "is_query", "vec_id")
    hits = dealt.mapInArrow(_search_tiles(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
