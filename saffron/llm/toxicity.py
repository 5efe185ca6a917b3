"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence ends at a full stop, question mark, exclamation mark or line end. Its logit is a bias plus the weights of
its hashed byte n-grams (ORDERS; lower-cased, everything but letters read as a space), its probability p the
sigmoid of that. A document is toxic with probability 1 - product(1 - p): one bad sentence is enough, and only the
documents are labelled. The weights are trained in numpy (Adam on the noisy-or likelihood, each step drawing weights towards zero) on at most PER_LABEL
texts of each class; offending sentences are those with p >= 0.5, or the likeliest of a toxic document that has none.

Defined results: null reads as empty; a text without a letter has no sentence and scores 0. With fewer than two
classes among the training rows every score is that class's share, or 0.5 without any. Rows that repeat are scored
each for itself; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._spark import bounded_sample, held_out
from .langid import folded

ORDERS = (4, 5)
BITS = 18
#: Training texts of each label.
PER_LABEL = 1500
EPOCHS, PARTS, RATE, SPARSE, BIAS = 40, 12, 0.08, 0.05, -7.0

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!\n"]] = True


def sentences(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each sentence, its row); each row begins with a line end, so a sentence never spans rows."""
    first = np.flatnonzero(_STOP[data[:-1]])
    return first, np.searchsorted(starts[1:], first, "right")


def _grams(data: np.ndarray, starts: np.ndarray):
    """For each order the bucket at each position and whether it counts: a letter in its first bytes, and one row only."""
    b = folded(data).astype(np.uint32)
    h = b
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in ORDERS:
            counts = (b[: len(h)] != 32) | (b[1 : len(h) + 1] != 32)
            for back in range(1, n - 1):
                across = starts[1:-1] - back
                counts[across[(across >= 0) & (across < len(h))]] = False
            yield ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), counts


def _softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, weights, bias, constant=None):
        self.weights, self.bias, self.constant = weights, bias, constant

    def _logits(self, data, starts):
        first, row = sentences(data, starts)
        z = np.full(len(first), float(self.bias))
        letters = np.zeros(len(first), bool)
        for bucket, letter in _grams(data, starts):
            inside = first < len(bucket)
            at = first[inside]
            if len(at):
                z[inside] += np.add.reduceat(self.weights[bucket] * letter, at)
                letters[inside] |= np.logical_or.reduceat(letter, at)
        return first, row, z, letters

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        out = np.zeros(len(column))
        for lo, hi, data, starts in slices(column):
            _, row, z, letters = self._logits(data, starts)
            out[lo:hi] = -np.expm1(-np.bincount(row, _softplus(z) * letters, hi - lo))
        return out

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences of a text that reach `least`, in code points."""
        if self.constant is not None or not text:
            return []
        raw = text.encode()
        (_, _, data, starts), *_ = slices(pa.array([raw], pa.large_binary()), len(raw) + 1)
        first, _, z, letters = self._logits(data, starts)
        begins = np.concatenate([[0], np.cumsum((data[1:] & 0xC0) != 0x80)])  # code points before each byte of the text
        ends = np.append(first[1:], len(data) - 2)
        return [(int(begins[a]), int(begins[min(b, len(raw))]), float(p)) for a, b, p, ok in zip(first, ends, _sigmoid(z), letters, strict=True) if ok and p >= least]


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of a bounded sample; deterministic."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model(None, 0.0, constant=float(y[0]) if len(y) else 0.5)
    size = 1 << BITS
    model = Model(np.zeros(size, np.float32), BIAS)
    first, second = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    rng, step, steps = np.random.default_rng(10), 0, EPOCHS * min(PARTS, len(y))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), min(PARTS, len(y))):
            grad, bias_grad = np.zeros(size, np.float64), 0.0
            column = pa.array([texts[i].encode() for i in rows], pa.large_binary())
            for lo, hi, data, starts in slices(column):
                begin, row, z, letters = model._logits(data, starts)
                total = np.bincount(row, _softplus(z) * letters, hi - lo)
                toxic = y[rows[lo:hi]] == 1
                outer = np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(total, 40)), 1e-6), 1.0)
                dz = outer[row] * _sigmoid(z) * letters / len(rows)
                bias_grad += dz.sum()
                for bucket, letter in _grams(data, starts):
                    inside = begin < len(bucket)
                    spans = np.diff(np.append(begin[inside], len(bucket)))
                    spread = np.repeat(dz[inside], spans) if len(spans) else np.zeros(0)
                    lead = len(bucket) - len(spread)
                    grad += np.bincount(bucket[lead:], spread * letter[lead:], size)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            full = np.append(grad, bias_grad).astype(np.float32)
            first = 0.9 * first + 0.1 * full
            second = 0.999 * second + 0.001 * full * full
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
            moved = model.weights - move[:-1]
            model.weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0)
            model.bias -= float(move[-1])
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Fits on at most per_label texts of each class of labels (doc_id, <label>), none of a held-out row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    rows = bounded_sample(docs.where(F.col("text").isNotNull()), known, "_label", per_label).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_label"], r["text"]))
    return fit([r["text"] for r in rows], [r["_label"] for r in rows])


def offending_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score): a row for each sentence with p >= 0.5, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in shared.value.offending(t or "")]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "start", "end", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, start long, end long, score double")


def located(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_offending, spans) of each row of docs (doc_id, text): spans has the start:end of
    the offending sentences of a document that is predicted toxic, in code points, joined by commas."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = model.scores(batch.column(1))
            found = [[] for _ in scores]
            for i in np.flatnonzero(scores >= threshold):
                text = batch.column(1)[int(i)].as_py() or ""
                found[i] = model.offending(text) or sorted(model.offending(text, 0.0), key=lambda x: -x[2])[:1]
            spans = [",".join(f"{a}:{b}" for a, b, _ in x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(x) for x in found], pa.int64()), pa.array(spans, pa.string())], ["doc_id", "score", "n_offending", "spans"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = text.mapInArrow(run, "doc_id long, score double, n_offending long, spans string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "spans")
