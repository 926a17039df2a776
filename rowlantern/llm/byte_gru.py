"""Language identification by a bidirectional gated recurrent network over bytes.

Numpy only: trained by backpropagation through time on windows of labelled
text, it gives every byte position of a text a distribution over languages; a
document's is the mean over its letters.  Activations are softsign and its
shifted form, several times cheaper than tanh and exp.

Texts are read whole, as consecutive windows; the states start anew at each
window, which bounds memory and lets all windows of a batch run side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlantern.llm.tables import lean

SPAN, SIDE = 64, 1024
#: Documents of each label in a sample of however many labels.
LEAST_SAMPLE = 16
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters: ASCII letters and everything from UTF-8 sequences.
IS_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def _soft(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place."""
    np.abs(x, out=room)
    room += 1
    x /= room


class ByteGRU:
    """Parameters by name; ``f`` and ``b`` are the two directions."""

    def __init__(self, labels: list[str], hidden: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 0.4, (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"W{d}"] = rng.normal(0, 0.4, (hidden, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def _run(self, bytes_: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after every byte; ``bytes_`` is (time, batch).  Works in place, with one row per unit."""
        h, (steps, batch) = self.hidden, bytes_.shape
        table, rec = self.p[f"E{d}"], np.ascontiguousarray(self.p[f"U{d}"].T)
        states = np.empty((steps, h, batch), np.float32)
        state = np.zeros((h, batch), np.float32)
        x, u, spare = (np.empty((3 * h, batch), np.float32) for _ in range(3))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x[...] = table[bytes_[t]].T
            np.matmul(rec, state, out=u)
            gates, a, c, room = x[:2 * h], u[2 * h:], x[2 * h:], spare[:2 * h]
            gates += u[:2 * h]
            _soft(gates, room)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h], gates[h:]
            c += np.multiply(r, a, out=spare[:h])
            _soft(c, spare[:h])
            if trace is not None:
                trace.append((t, *(v.T.copy() for v in (state, z, r, c, a))))
            c -= state
            c *= z
            state = np.add(state, c, out=states[t])
        return states.transpose(0, 2, 1)

    def positions(self, bytes_: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """(time, batch, label) probabilities."""
        logits = self.p["c"]
        for d in "fb":
            steps = None if trace is None else []
            states = self._run(bytes_, d, steps)
            logits = logits + states @ self.p[f"W{d}"]
            if trace is not None:
                trace[d] = (states, steps)
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient."""
        trace: dict = {}
        prob, h = self.positions(bytes_, trace), self.hidden
        steps, batch = bytes_.shape
        loss = -float(np.log(np.maximum(prob[:, np.arange(batch), target], 1e-9)).mean())
        prob[:, np.arange(batch), target] -= 1
        prob /= steps * batch
        grad = {"c": prob.sum(axis=(0, 1))}
        for d in "fb":
            states, past = trace[d]
            out = self.p[f"W{d}"]
            grad[f"W{d}"] = np.tensordot(states, prob, axes=([0, 1], [0, 1]))
            into = prob @ out.T
            rec, dx = self.p[f"U{d}"], np.empty((steps, batch, 3 * h), np.float32)
            drec, ahead = np.zeros_like(rec), np.zeros((batch, h), np.float32)
            for t, state, z, r, c, a in reversed(past):
                dh = into[t] + ahead
                dc = dh * z * (1 - np.abs(c)) ** 2
                dz = dh * (c - state) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dc * a * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dx[t, :, :2 * h], dx[t, :, 2 * h:] = du[:, :2 * h], dc
                drec += state.T @ du
                ahead = dh * (1 - z) + du @ rec.T
            flat, flat_dx = bytes_.ravel(), dx.reshape(-1, 3 * h)
            grad[f"U{d}"] = drec
            grad[f"E{d}"] = np.stack(
                [np.bincount(flat, flat_dx[:, k], 256) for k in range(3 * h)], axis=1).astype(np.float32)
        return loss, grad

    def train(self, texts: list[bytes], target: np.ndarray, steps: int = 300, batch: int = 256, rate: float = 0.02,
              seed: int = 11) -> list[float]:
        """Adam on random windows; a third of them are cut short, as short texts are."""
        rng = np.random.default_rng(seed)
        weights = 1.0 / np.bincount(target, minlength=len(self.labels))[target]
        weights /= weights.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.choice(len(texts), batch, p=weights)
            rows = np.full((batch, SPAN), 32, np.uint8)
            for i, k in enumerate(pick):
                at = rng.integers(0, max(1, len(texts[k]) - SPAN + 1))
                n = SPAN if rng.random() > 0.33 else int(rng.integers(4, SPAN))
                part = np.frombuffer(texts[k][at:at + n], np.uint8)
                rows[i, :len(part)] = part
            loss, grad = self.gradients(np.ascontiguousarray(rows.T), target[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (pace * (m[k] / (1 - 0.9 ** step))
                              / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(text, label): mean over the letters of each text, all windows of all texts side by side."""
        windows = [-(-len(t) // SPAN) for t in texts]
        rows = np.full((sum(windows), SPAN), 32, np.uint8)
        flat, at = rows.reshape(-1), 0
        for t, n in zip(texts, windows):
            flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
            at += n * SPAN
        total = np.zeros((len(rows), len(self.labels)), np.float64)
        side = max(16, SIDE * 32 // max(32, len(self.labels)))
        for start in range(0, len(rows), side):
            part = np.ascontiguousarray(rows[start:start + side].T)
            prob = self.positions(part)
            prob *= IS_LETTER[part][:, :, None]
            total[start:start + side] = prob.sum(axis=0)
        owner = np.repeat(np.arange(len(texts)), windows)
        pooled = np.stack([np.bincount(owner, total[:, k], len(texts)) for k in range(total.shape[1])], axis=1)
        return pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1500, languages: int = 32, hidden: int = 6, steps: int = 300,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGRU | None:
    """A network fitted on a bounded sample of labelled rows that are not held out.

    Every label is learned, from about ``per_language`` documents chosen by a hash
    of the id, 256 characters of each, from a place that the hash chooses.  Of more
    than ``languages`` labels each has fewer, ``LEAST_SAMPLE`` at least, so that the
    sample keeps its size, and there are more steps.  None if there is no such row.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    crowd = max(1.0, len(counts) / languages)
    share = max(min(LEAST_SAMPLE, per_language), per_language / crowd)
    mix = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30))
    chance = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, share / r["n"])) for r in counts], "lang string, chance double")
    at = 1 + F.pmod(F.xxhash64("lang", "id"), F.greatest(F.length("text") - 255, F.lit(1)))
    sample = known.join(F.broadcast(chance), "lang").where(mix < F.col("chance") * float(1 << 30)).select(
        "lang", mix.alias("mix"), F.substring("text", at.cast("int"), F.lit(256)).alias("text"))
    # Repeated rows are chosen together: a bound for each label, so that none crowds out another.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mix", "text"))
    sample = sample.withColumn("place", place).where(F.col("place") <= int(2 * share)).select("lang", "text")
    rows = [(r["lang"], r["text"].encode()) for r in sample.collect() if LETTER.search(r["text"])]
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    rows.sort()
    model = ByteGRU(labels, hidden)
    if len(labels) > 1:
        number = {lang: k for k, lang in enumerate(labels)}
        model.train([t for _, t in rows], np.array([number[lang] for lang, _ in rows]), int(steps * crowd))
    return model


OUT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predictor(model: ByteGRU | None, batch_bytes: int = 8 << 20):
    """Arrow batches with the text as last column to the same without it, and lang_pred and score."""
    def guesses(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        waiting: list[tuple[int, bytes]] = []

        def flush():
            for (k, _), row in zip(waiting, model.documents([t for _, t in waiting])):
                langs[k], scores[k] = model.labels[int(row.argmax())], float(min(1.0, row.max()))
            waiting.clear()

        size = 0
        for k, text in enumerate(texts):
            if model is not None and text and LETTER.search(text):
                waiting.append((k, text.encode()))
                size += len(waiting[-1][1])
                if size > batch_bytes:
                    flush()
                    size = 0
        if waiting:
            flush()
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            langs, scores = guesses(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: ByteGRU | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    Without a ``model`` one is fitted on ``docs`` (see ``fit``).  ``lang_pred`` is a
    learned label, or ``und`` with score 0 if the text is null or has no letter
    or nothing could be learned; ``score`` is the label's mean probability over
    the letters.  A null id is not held out; repeated rows are labelled each; an
    empty table gives no rows; other columns are not read.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(predictor(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with a score of at least ``least``.

    Without any label to learn from nothing is rejected.  Null texts and texts
    without a letter go; repeated rows are judged each; an empty table gives no rows.
    """
    model = fit(docs, text_col=text_col, **options)
    if model is None:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = docs.schema.simpleString()
    judged = rows.mapInArrow(lean(predictor(model)), f"row {kind}, lang_pred string, score double")
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
