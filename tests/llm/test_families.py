"""Large families of near copies are compared once, not in every tree."""

import random

from pyspark.sql import functions as F

from rowlantern.llm import chosen_path
from rowlantern.llm.chosen_path import NodeJoin


def family(n):
    """Copies with some words of their own: many pairs are likely, few are alike."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(80), rng.choice([1, 2, 5, 6])):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def by_hand(rows, percent):
    sets = {i: {tuple(w[k:k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {i: find(i) for i in sets}


def test_a_family_is_compared_once(spark, monkeypatch):
    rows, met, confirm = family(150), [], NodeJoin.confirm

    def counted(self, blocks, signs, fetch):
        met.append(blocks.count())
        return confirm(self, blocks, signs, fetch)

    monkeypatch.setattr(NodeJoin, "confirm", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = chosen_path.near_duplicates(docs, shingle=3, percent=85, leaf=4)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == by_hand(rows, 85)
    assert len(met) == 3 and met[2] < 60 * len(rows)


def test_nodes_stay_apart_where_together_is_more(spark):
    join = NodeJoin(85, 4, 3)
    nodes = [(0, 1, cid, 5 if cid < 5 else cid) for cid in range(8)] + [(1, 2, cid, 5 if cid < 5 else cid) for cid in range(8)]
    nodes += [(0, 3, cid, 100 if cid < 140 else cid) for cid in range(100, 142)]
    nodes += [(1, 4, cid, 100 if cid < 240 else cid) for cid in (*range(200, 240), 240, 241)]
    table = spark.createDataFrame(nodes, "tree int, node long, cid long, comp long")
    table = join.ranked(join.sized(table))
    # One family in two trees; two groups that only share their largest component.
    whole = join.merged(table, 128).groupBy("main").agg(
        F.count_distinct("node").alias("nodes"), F.count("*").alias("rows"), F.max("others").alias("others"))
    assert {r["main"]: (r["nodes"], r["rows"], r["others"]) for r in whole.collect()} == {5: (1, 8, 2), 100: (2, 84, 2)}
