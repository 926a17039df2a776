"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document is the set of its word shingles, embedded as a fixed number of
minwise tokens.  Each tree starts with the documents that share one chosen
token; a node with too many documents branches again by further tokens, chosen
by a hash of the node, until its documents are few enough to be compared with
one another.  Independent trees are repeated: a pair at the threshold ``s`` is
missed by all ``t`` trees with a chance of ``(1 - s) ** t`` (2.6e-7 at 0.85 and 8).

Large nodes are families of near copies, or share a common passage.  Their
documents meet a few pivots of the node first.  Where few are then outside the
node's largest component, these are compared with all others, in blocks, so no
pair is left out and none is written; where many are, the node branches.  Links are confirmed on full sets.  Only what decides
components is kept: a pair that is connected already is not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlantern.llm import shingles as sh
from rowlantern.llm.components import components
from rowlantern.llm.tables import lean, store

TOKENS, BRANCH, PIVOTS = 64, 2, 8
MEMBER, PIVOT, PEER = 0, 1, 2
SIGNED = "doc_id long, n long, digest binary, sign binary, roots array<long>"
BROADCAST_IDS = 500_000


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def _out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _node(parent: np.ndarray | int, place: int, values: np.ndarray) -> np.ndarray:
    """Ids of the nodes that the values of one token lead to."""
    with np.errstate(over="ignore"):
        start = sh.mixed(np.asarray(parent, np.int64).astype(np.uint64) * sh.STEP + np.uint64(place + 1))
        return sh.mixed(start + values.astype(np.uint64) * sh.STEP).astype(np.int64)


def _sign(size: int, trees: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sign", pa.binary()),
                        ("roots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        seeds, spread = sh.seeds_of(TOKENS), np.arange(trees)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                with np.errstate(over="ignore"):
                    tokens = sh.shingle_set(sh.word_hashes((text.as_py() or "").encode()), size)
                    if not len(tokens):
                        rows.append((doc_id, 0, None, None, None))
                        continue
                    least = sh.minwise(tokens, seeds)
                roots = [int(_node(t, t, least[t:t + 1])[0]) for t in spread]
                rows.append((doc_id, len(tokens), sh.digest(tokens), least.tobytes(), roots))
            yield _out(schema, rows)

    return run


def _branch(batches: Iterator[pa.RecordBatch]):
    """(tree, node, cid, sign) to the node's children: BRANCH tokens chosen by the node."""
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("cid", pa.int64())])
    for batch in batches:
        trees, nodes, cids, signs = (batch.column(i).to_pylist() for i in range(4))
        if not nodes:
            continue
        least = np.frombuffer(b"".join(signs), np.uint32).reshape(-1, TOKENS)
        parent, rows = np.array(nodes, np.int64), np.arange(len(nodes))
        for k in range(BRANCH):
            place = (_node(parent, k, np.zeros(len(nodes), np.uint32)).astype(np.uint64) % np.uint64(TOKENS)).astype(int)
            child = _node(parent, k, least[rows, place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int32()), pa.array(child), pa.array(cids, pa.int64())], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, one list for each value of the first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*_columns(batch)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _alike_signs(least: np.ndarray, enough: int) -> np.ndarray:
    """Pairs with at least ``enough`` equal tokens, as a symmetric matrix."""
    same = np.zeros((len(least), len(least)), np.int16)
    for k in range(TOKENS):
        same += least[:, None, k] == least[None, :, k]
    return same >= enough


def _alike_sets(sets: list[np.ndarray], percent: int, width: int = 1 << 13) -> np.ndarray:
    """Pairs of sets that are alike, from products of their incidence matrix, a slice of tokens at a time."""
    n = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner, both = np.repeat(np.arange(len(sets)), n), np.zeros((len(sets), len(sets)))
    for low in range(0, int(token.max()) + 1, width):
        part = (token >= low) & (token < low + width)
        held = np.zeros((len(sets), width if token.max() >= low + width else int(token.max()) + 1 - low), np.float32)
        held[owner[part], token[part] - low] = 1
        both += held @ held.T
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def _allowed(group: list[tuple], role: int, percent: int, sizes: np.ndarray, least: np.ndarray, enough: int) -> np.ndarray:
    """Pairs of a block that may be links: likely by tokens and size, and not both mere members."""
    roles = np.array([r[role] for r in group])
    likely = _alike_signs(least, enough)
    likely &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    return likely & ((roles[:, None] != MEMBER) | (roles[None, :] != MEMBER))


def _sieve(percent: int, enough: int):
    """(block, role, cid, comp, n, sign) by block to the rows with a likely partner in another component."""
    schema = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("cid", pa.int64()), ("comp", pa.int64())])

    def run(batches):
        rows = []
        for group in _grouped(batches):
            if len(group) > 1:
                least = np.frombuffer(b"".join(r[5] for r in group), np.uint32).reshape(-1, TOKENS)
                comp = np.array([r[3] for r in group])
                likely = _allowed(group, 1, percent, np.array([r[4] for r in group]), least, enough)
                likely &= comp[:, None] != comp[None, :]
                rows += [group[i][:4] for i in np.flatnonzero(likely.any(axis=1))]
            if len(rows) > 5000:
                yield _out(schema, rows)
                rows = []
        yield _out(schema, rows)

    return run


def _confirm(percent: int, enough: int):
    """(block, role, cid, comp, sign, tokens) by block to links (a, b) that join components, confirmed on full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group):
        cid, comp = (np.array([r[k] for r in group]) for k in (2, 3))
        least = np.frombuffer(b"".join(r[4] for r in group), np.uint32).reshape(-1, TOKENS)
        sets = [np.frombuffer(r[5], np.uint64) for r in group]
        top = {c: c for c in comp.tolist()}

        def find(c):
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        likely = _allowed(group, 1, percent, np.array([len(s) for s in sets]), least, enough)
        likely &= comp[:, None] != comp[None, :]
        known = np.count_nonzero(likely) > 4 * len(group)
        if known:  # cheaper for all pairs of the block at once
            likely &= _alike_sets(sets, percent)
        for i, j in zip(*np.nonzero(np.triu(likely, 1))):
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and (known or sh.alike(sets[i], sets[j], percent)):
                top[a] = b
                yield (int(cid[i]), int(cid[j]))

    def run(batches):
        rows = []
        for group in _grouped(batches):
            if len(group) > 1 and len({r[3] for r in group}) > 1:
                rows += links(group)
            if len(rows) > 5000:
                yield _out(schema, rows)
                rows = []
        yield _out(schema, rows)

    return run


def _sets(size: int):
    schema = pa.schema([("cid", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for cid, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                with np.errstate(over="ignore"):
                    tokens = sh.shingle_set(sh.word_hashes((text.as_py() or "").encode()), size)
                if len(tokens) and sh.digest(tokens) == digest:
                    rows.append((cid, tokens.tobytes()))
            yield _out(schema, rows)

    return run


class NodeJoin:
    """Links within the nodes of trees; every step reads and writes tables in the shared folder.

    A node is a set of classes (cid).
    """

    def __init__(self, percent: int, leaf: int, depth: int):
        self.percent, self.leaf, self.depth = percent, leaf, depth
        chance = percent / 100
        # Five deviations below the threshold: a link is overlooked by its tokens once in millions.
        self.enough = max(1, int(TOKENS * (chance - 5 * (chance * (1 - chance) / TOKENS) ** 0.5)))

    def sized(self, members: DataFrame) -> DataFrame:
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return members.join(sizes, "node")

    def confirm(self, blocks: DataFrame, signs: DataFrame, fetch) -> DataFrame:
        """Links between components within blocks of (block, role, cid, comp).

        Tokens decide which rows go on to be compared by their full sets, which
        ``fetch`` gives for classes (cid).
        """
        rows = blocks.join(signs, "cid").select("block", "role", "cid", "comp", "n", "sign")
        rows = rows.repartition("block").sortWithinPartitions("block", "role", "cid")
        rows = store(rows.mapInArrow(
            lean(_sieve(self.percent, self.enough)), "block long, role int, cid long, comp long"), "likely")
        sets = fetch(rows.select("cid").distinct())
        rows = rows.join(signs, "cid").join(sets.select("cid", "tokens"), "cid").select(
            "block", "role", "cid", "comp", "sign", "tokens")
        rows = rows.repartition("block").sortWithinPartitions("block", "role", "cid")
        return store(rows.mapInArrow(lean(_confirm(self.percent, self.enough)), "a long, b long"), "links")

    @staticmethod
    def open_nodes(members: DataFrame, comp: DataFrame | None) -> DataFrame:
        """Members with their component, of nodes that hold more than one."""
        if comp is None:
            return members.withColumn("comp", F.col("cid"))
        known = comp.select(F.col("v").alias("cid"), "c")
        members = members.join(known, "cid", "left").withColumn("comp", F.coalesce("c", "cid")).drop("c")
        mixed = members.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
        return members.join(mixed.select("node"), "node")

    @staticmethod
    def ranked(members: DataFrame) -> DataFrame:
        """Members with the largest component of their node (main) and the number of others in it."""
        parts = members.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("rows"))
        most = parts.groupBy("node").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"),
                                         (F.sum("rows") - F.max("rows")).alias("others"))
        return members.join(most, "node")

    def by_pivots(self, large: DataFrame) -> DataFrame:
        """Everyone outside a node's largest component dealt to blocks, and a few members of the node sent to all.

        About PIVOTS are chosen by a hash from the whole node, and as many from the others.
        """
        blocks = F.ceil((F.col("others") + 1) / self.leaf)
        other = F.col("comp") != F.col("main")
        lot = F.xxhash64("cid", "node")
        key = lambda k: F.xxhash64("node", F.lit(-1), k)
        members = large.where(other).select(
            key(F.pmod(F.xxhash64("cid"), blocks)).alias("block"), F.lit(MEMBER).alias("role"), "cid", "comp")
        chosen = (F.pmod(lot, F.col("size")) < PIVOTS) | other & (
            F.pmod(F.xxhash64(lot), F.greatest("others", F.lit(1))) < PIVOTS)
        pivots = large.where(chosen).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return members.unionByName(pivots.select(key(F.col("k")).alias("block"), F.lit(PIVOT).alias("role"), "cid", "comp"))

    def by_grid(self, large: DataFrame) -> DataFrame:
        """Everyone outside a node's largest component against all members, block by block."""
        down, across = (F.ceil(F.col(n) / (2 * self.leaf)) for n in ("size", "others"))
        hashed = F.xxhash64("cid", "node")
        span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        key = F.xxhash64("node", "i", "j").alias("block")
        members = large.withColumn("i", F.pmod(hashed, down)).withColumn("j", span(across))
        others = large.where("comp <> main").withColumn("j", F.pmod(hashed, across)).withColumn("i", span(down))
        return members.select(key, F.lit(MEMBER).alias("role"), "cid", "comp").unionByName(
            others.select(key, F.lit(PIVOT).alias("role"), "cid", "comp"))

    def merged(self, nodes: DataFrame, most: int) -> DataFrame:
        """Nodes of one largest component as one node, so that their pairs are compared once and not in every tree.

        Only where at most ``most`` are then outside the component, so the node is
        compared as a whole, and where that is no more pairs than the nodes have apart.
        """
        apart = nodes.select("main", "node", "size", "others").distinct().groupBy("main").agg(
            F.sum(F.col("size") * F.col("others")).alias("apart"))
        once = nodes.select("main", "cid", "comp").distinct()
        whole = once.groupBy("main").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("comp") != F.col("main")).alias("others"))
        whole = store(whole.join(apart, "main").where(
            (F.col("others") <= most) & (F.col("size") * F.col("others") <= F.col("apart"))).drop("apart"), "whole")
        kept = nodes.join(whole.select("main"), "main", "left_anti")
        return kept.unionByName(once.join(whole, "main").withColumn("tree", F.lit(-1)).withColumn(
            "node", F.xxhash64("main", F.lit("merged"))).select(kept.columns))

    def connect(self, roots: DataFrame, signs: DataFrame, fetch) -> DataFrame | None:
        """(v, c) of all classes that are linked with another; None if none is.

        ``roots`` are the members (tree, node, cid) of all trees, ``signs`` holds
        (cid, n, sign).  The first tree goes first: what it connects need not be
        compared in the others.  Large nodes meet their pivots; those that then
        still hold several components are compared in a grid if few are left
        outside the largest, those of one component together, and branch otherwise.
        """
        live = store(self.sized(roots), "nodes")
        small, large = live.where(F.col("size") <= self.leaf), live.where(F.col("size") > self.leaf)
        any_large = bool(large.limit(1).count())
        links, comp = None, None

        def add(blocks):
            nonlocal links, comp
            more = self.confirm(blocks, signs, fetch)
            links = more if links is None else links.unionByName(more)
            if more.limit(1).count():
                comp = store(components(links, "near"), "near")

        def peers(rows):
            return rows.select(F.xxhash64("node", "tree").alias("block"), F.lit(PEER).alias("role"), "cid", "comp")

        for trees in ("tree = 0", "tree > 0"):
            blocks = peers(self.open_nodes(small.where(trees), comp))
            if any_large:
                met = self.ranked(self.open_nodes(large.where(trees), comp))
                blocks = blocks.unionByName(self.by_pivots(met))
            add(blocks)
        if not any_large:
            return comp
        left = store(self.ranked(self.open_nodes(large, comp)), "left")
        if not left.limit(1).count():
            return comp
        most = 32 * self.leaf
        few_left = F.col("others") <= most
        left = store(self.merged(left, most), "merged")
        blocks, wide = self.by_grid(left.where(few_left)), left.where(~few_left)
        for _ in range(self.depth - 1):
            if not wide.limit(1).count():
                break
            children = wide.join(signs, "cid").select("tree", "node", "cid", "sign").mapInArrow(
                lean(_branch), "tree int, node long, cid long")
            level = store(self.open_nodes(self.sized(children), comp), "level")
            blocks = blocks.unionByName(peers(level.where(F.col("size") <= self.leaf)))
            wide = self.ranked(level.where(F.col("size") > self.leaf))
            blocks = blocks.unionByName(self.by_grid(wide.where(few_left)))
            wide = store(wide.where(~few_left), "wide")
        add(blocks.unionByName(self.by_grid(wide)))
        return comp


class _Documents(NodeJoin):
    """Documents as classes of equal shingle sets, and the trees over them."""

    def __init__(self, rows: DataFrame, size: int, percent: int, trees: int, leaf: int, depth: int):
        super().__init__(percent, leaf, depth)
        self.size = size
        signed = rows.mapInArrow(lean(_sign(size, trees)), SIGNED)
        self.signed = store(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        some = self.signed.where("n > 0")
        # Equal sets are one class, named by its first row.
        self.classes = some.groupBy("digest").agg(F.min("row").alias("cid"), F.min("doc_id").alias("doc_id"))
        own = self.classes.select("cid")
        self.reps = store(some.join(own, some["row"] == own["cid"]).select(
            "cid", "doc_id", "n", "digest", "sign", "roots"), "representatives")

    def fetch(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted classes, from the text of their first document."""
        wanted = wanted.join(self.reps, "cid").select("cid", "digest", F.col("doc_id").alias("own"))
        wanted = store(wanted, "wanted")
        n = wanted.count()
        texts = docs.join(few(wanted), docs["doc_id"].eqNullSafe(F.col("own"))).select("cid", "digest", "text")
        sets = store(texts.mapInArrow(lean(_sets(self.size)), "cid long, tokens binary"), "sets")
        if sets.count() > n:  # repeated rows
            sets = store(sets.dropDuplicates(["cid"]), "sets")
        return sets

    def run(self, docs: DataFrame) -> DataFrame | None:
        roots = self.reps.select("cid", F.posexplode("roots").alias("tree", "node")).select("tree", "node", "cid")
        return self.connect(roots, self.reps.select("cid", "n", "sign"), lambda wanted: self.fetch(docs, wanted))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = 8, leaf: int = 64,
                    depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of
    ``shingle``-word shingles (A-Z lower-cased; fewer words are one shingle).
    ``component_id`` is the smallest id reachable, and ``kept`` says whether it is the
    document's own.  Null, empty and wordless texts have no shingles and are alone.
    Equal sets are one class from the start.  Repeated rows share all results;
    rows of one id with different texts are linked by their texts only; a null
    id counts as larger than any; an empty table gives no rows; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    join = _Documents(rows, shingle, percent, trees, leaf, depth)
    comp = join.run(rows)
    classes = join.classes
    if comp is not None:
        classes = classes.join(comp, F.col("cid") == F.col("v"), "left").select(
            "digest", "doc_id", F.coalesce("c", "cid").alias("c"))
        least = classes.groupBy("c").agg(F.min("doc_id").alias("least"))
        classes = classes.join(least, "c")
    else:
        classes = classes.withColumn("least", F.col("doc_id"))
    out = join.signed.join(classes.select("digest", "least"), "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
                      ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def few(ids: DataFrame, items: str | None = None) -> DataFrame:
    """``ids`` with a broadcast hint if they are counted to be few; else they are joined by shuffle.

    ``items`` names a column of lists whose elements count as well.
    """
    n = ids.count() + (ids.agg(F.sum(F.size(items))).first()[0] or 0 if items else 0)
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, with one document for each group of near-duplicates: that of the smallest id.

    Rows that share an id stay or go together; of those with one text, too, one stays.
    """
    found = store(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "groups")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    ids = store(ids.where(~F.col("kept") | (F.col("rows") > 1)).select(F.col("doc_id").alias("own"), "kept"), "ids")
    on = docs[id_col].cast("long").eqNullSafe(F.col("own"))
    rest = docs.join(few(ids.select("own")), on, "left_anti")
    twice = ids.where("kept").select("own")
    if not twice.limit(1).count():
        return rest
    return rest.unionByName(docs.join(few(twice), on, "left_semi").dropDuplicates([id_col, text_col]))
