"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities of lexicon words, how near second-person words
stand to them, and rates of capitals, punctuation and obfuscated spelling.  The
lexicon is a fixed seed list and the words, and word beginnings, that labelled
texts show to be toxic.  Trees and calibration are fitted in numpy on a bounded
sample of labelled rows; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlantern.llm.tables import lean

SEED = frozenset("idiot idiots stupid moron morons scum loser losers trash pathetic worthless disgusting clown dumb "
                 "imbecile jerk".split())
PERSONS = frozenset("you your you're u du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti vos"
                    .split())
PLAIN = str.maketrans("013457@$!", "oieastasi")
EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_~/\\=+`^"
STEMS = (5, 7)
NAMES = ("log_words", "seed_density", "seed_any", "learned_density", "learned_best", "learned_sum", "stem_density",
         "stem_best", "person_near", "person_density", "capitals", "shouted", "exclaimed", "punctuation", "digits",
         "obfuscated", "obfuscated_lexicon")


class Lexicon:
    """Toxic and other documents of every word and word beginning, as counted in the fitting sample."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean

    def weight(self, item: str, own: int | None) -> float:
        """Log odds of the item; a fitting row's own label is taken out of its counts."""
        found = self.counts.get(item)
        if found is None:
            return 0.0
        p, n = found
        if own is not None:
            p, n = p - own, n - (1 - own)
        if p < 2:
            return 0.0
        odds = math.log((p + 0.5) / (self.toxic + 1)) - math.log((n + 0.5) / (self.clean + 1))
        return odds if odds > 1.5 else 0.0


def items_of(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _plain(raw: str) -> tuple[str, bool]:
    """Lower-case word without edge marks, and whether marks or digits inside it were read as letters."""
    word = raw.strip(EDGE).lower()
    if word.isalpha():
        return word, False
    letters = "".join(c for c in word.translate(PLAIN) if c.isalpha())
    return letters, len(letters) > 2 and any(c.isalpha() for c in word)


class Word(NamedTuple):
    seed: bool
    weight: float
    stem: float
    hit: bool
    person: bool
    shouted: bool
    bent: bool


def read_word(raw: str, lexicon: Lexicon, own: int | None) -> Word:
    word, bent = _plain(raw)
    weight = lexicon.weight(word, own)
    stem = max((lexicon.weight(word[:k] + "*", own) for k in STEMS if len(word) > k), default=0.0)
    return Word(word in SEED, weight, stem, word in SEED or weight > 2.5, word in PERSONS,
                len(word) > 1 and raw.isupper(), bent)


def _nearest(raws: list[str], hits: set[str], persons: set[str]) -> int:
    """Words between the closest lexicon word and second-person word."""
    a = np.array([i for i, raw in enumerate(raws) if raw in hits])
    b = np.array([i for i, raw in enumerate(raws) if raw in persons])
    at = np.searchsorted(b, a)
    right = np.abs(b[np.minimum(at, len(b) - 1)] - a)
    left = np.abs(a - b[np.maximum(at - 1, 0)])
    return int(min(left.min(), right.min()))


def features(text: str, lexicon: Lexicon, own: int | None = None, known: dict[str, Word] | None = None) -> list[float]:
    """One row of NAMES.  ``known`` remembers words from text to text; not for fitting rows."""
    raws = text.split()
    n, known = len(raws) or 1, {} if known is None else known
    seed = learned = stems = persons = shouted = odd = odd_hits = 0
    best = best_stem = total = 0.0
    hit_words, person_words = set(), set()
    for raw, times in Counter(raws).items():
        word = known.get(raw)
        if word is None:
            if len(known) >= CACHED_WORDS:
                known.clear()
            word = known[raw] = read_word(raw, lexicon, own)
        if word == NOTHING:
            continue
        seed += times * word.seed
        learned += times * (word.weight > 0)
        stems += times * (word.stem > 0)
        best, best_stem, total = max(best, word.weight), max(best_stem, word.stem), total + times * word.weight
        odd += times * word.bent
        odd_hits += times * (word.bent and word.hit)
        shouted += times * word.shouted
        persons += times * word.person
        if word.hit:
            hit_words.add(raw)
        if word.person:
            person_words.add(raw)
    near = 1.0 / (1 + _nearest(raws, hit_words, person_words)) if hit_words and person_words else 0.0
    # Rates by UTF-8 byte; a byte that starts a longer character counts as a letter.
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, digits = int(count[65:91].sum()), int(count[48:58].sum())
    letters = capitals + int(count[97:123].sum()) + int(count[192:].sum())
    size = letters + int(count[:128].sum()) - capitals - int(count[97:123].sum()) or 1
    marks = size - letters - digits - int(count[[9, 10, 11, 12, 13, 32]].sum())
    return [math.log1p(n), seed / n, min(seed, 5), learned / n, best, min(total, 50.0), stems / n, best_stem, near,
            persons / n, capitals / max(letters, 1), shouted / n, int(count[33]) / size, marks / size, digits / size,
            odd / n, min(odd_hits, 5)]


NOTHING = Word(False, 0.0, 0.0, False, False, False, False)
CACHED_WORDS = 300_000


class Boosted:
    """Depth-limited regression trees on binned features, logistic loss, Newton steps."""

    def __init__(self, trees: int = 80, depth: int = 3, bins: int = 32, rate: float = 0.15, least: float = 1.0):
        self.size, self.depth, self.bins, self.rate, self.least = trees, depth, bins, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1]))
                      for k in range(x.shape[1])]
        binned = self._bin(x)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(rate / (1 - rate))
        raw, self.trees = np.full(len(y), self.base), []
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            raw += self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned, grad, hess):
        """Arrays (feature, bin) by heap position, and leaf values."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins)
        node, width = np.zeros(len(grad), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            gain_best = np.zeros(count)
            for k in range(binned.shape[1]):
                key = (node - first) * width + binned[:, k]
                g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g ** 2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt ** 2 / (ht + 1)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(count), at] > gain_best + 1e-9
                gain_best[better] = gain[np.arange(count), at][better]
                feature[first:first + count][better], cut[first:first + count][better] = k, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, -self.rate * g / (h + 1)

    def _walk(self, tree, binned):
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum((self._walk(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their rates, with one row of each label as a prior."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        blocks.append([m, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            m2, v2, n2 = blocks.pop()
            m1, v1, n1 = blocks[-1]
            blocks[-1] = [(m1 * n1 + m2 * n2) / (n1 + n2), v1 + v2, n1 + n2]
    at = np.array([b[0] for b in blocks])
    return at, np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])


class Scorer:
    """Lexicon, trees and calibration; one of them absent means a constant score."""

    def __init__(self, lexicon: Lexicon, trees: Boosted | None, steps: tuple[np.ndarray, np.ndarray] | None,
                 constant: float = 0.0):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant
        self.known: dict[str, Word] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.trees is None or not texts:
            return [self.constant] * len(texts)
        x = np.array([features(t or "", self.lexicon, None, self.known) for t in texts])
        margin = self.trees.margin(x)
        # Between the steps of the calibration, and a little by margin within a flat one, so that order is kept.
        flat = np.interp(margin, *self.steps)
        return list(np.clip(0.999 * flat + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_rows(rows: list[tuple[str, int]]) -> Scorer:
    """Four fifths of the rows grow the trees, every fifth calibrates them; all fill the lexicon."""
    y = np.array([label for _, label in rows], float)
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    if not toxic or not clean:
        return Scorer(Lexicon({}, 0, 0), None, None, float(y.mean()) if len(y) else 0.0)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, label in rows:
        seen[label].update(items_of({w for w in (_plain(raw)[0] for raw in set(text.split())) if w}))
    counts = {w: (p, seen[0][w]) for w, p in seen[1].items() if p >= 2 and p / toxic > 2 * seen[0][w] / clean}
    lexicon = Lexicon(counts, toxic, clean)
    x = np.array([features(text, lexicon, label) for text, label in rows])
    fold = np.arange(len(rows)) % 5 == 4
    trees = Boosted().fit(x[~fold], y[~fold])
    margin = trees.margin(x)
    use = fold if 0 < y[fold].sum() < fold.sum() else ~fold
    return Scorer(lexicon, trees, isotonic(margin[use], y[use]))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, longest: int = 100_000, id_col: str = "doc_id",
        text_col: str = "text") -> Scorer:
    """A scorer fitted on a bounded sample of labelled rows that are not held out.

    From each label about ``per_label`` rows are chosen by a hash of the id;
    texts over ``longest`` characters are left out of the fit (never of the scoring).
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = [min(1.0, per_label / counts[k]) if counts.get(k) else 0.0 for k in (0, 1)]
    mix = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.where(mix < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * float(1 << 30))
    # The sample's ids are few by the bound above, so no text is shuffled to find it.
    chosen = F.broadcast(chosen.limit(3 * per_label))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        F.length("text") <= longest)
    sample = texts.join(chosen, "doc_id").select("doc_id", "text", "toxic").limit(3 * per_label).collect()
    rows = sorted((hash_of(r["doc_id"]), r["text"], int(r["toxic"])) for r in sample)
    return fit_rows([(text, label) for _, text, label in rows])


def hash_of(doc_id: int) -> int:
    """A fixed shuffle of the sample, so that folds do not follow the order of ids."""
    return (doc_id * 2654435761 + 97) % (1 << 32)


def scorer(model: Scorer):
    """Arrow batches with the text as last column to the same without it, and score."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = model.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())],
                                             names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Scorer | None = None, id_col: str = "doc_id",
          text_col: str = "text", **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Without a ``model`` one is fitted on ``labels`` (doc_id, toxic); rows with a null or another
    label teach nothing.  Null texts are empty and scored as such; without labels of both kinds
    all scores are the rate of label 1, or 0; repeated rows are scored each; an empty table gives
    no rows; other columns are not read.
    """
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    out = rows.mapInArrow(lean(scorer(model)), "doc_id long, held_out boolean, score double")
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, text_col: str = "text", **bounds) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below ``limit``.

    Labels of one kind alone tell nothing apart: then every row is kept.  Null
    and empty texts are scored as empty; repeated rows are judged each; an empty
    table gives no rows.
    """
    model = fit(docs, labels, text_col=text_col, **bounds)
    if model.trees is None:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    judged = rows.mapInArrow(lean(scorer(model)), f"row {docs.schema.simpleString()}, score double")
    return judged.where(F.col("score") < limit).select("row.*")
