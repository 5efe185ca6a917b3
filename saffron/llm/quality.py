"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Tokens are runs of letters, of digits and of other signs. Each token has a sparse index vector, NONZERO entries of +1
or -1 at places given by its hash. A word vector is the sum of the index vectors of the tokens around the word in the
training texts (WINDOW on each side), scaled to length one; words too rare there share the vectors of their shape
(lower, Title, UPPER, other). A document is the mean of its tokens' word vectors, with the length of its mean index
vector, which grows when few tokens make up the text, and its length. A network of one hidden layer is trained with
numpy on at most PER_LABEL labelled texts of each class; a temperature is fitted on texts kept back, and the logit is
moved to the classes' true shares.

Defined results: null reads as empty; an empty text gets the score of a document without tokens. With fewer than two
classes among the training rows every score is that class's share, or 0.5 without any. Rows that repeat are scored
each for itself; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACE, slices, span_hashes
from ._spark import bounded_sample, held_out

DIM, NONZERO, WINDOW = 64, 4, 2
#: Words with vectors of their own, and the training texts they must occur in.
WORDS, LEAST_TEXTS = 8192, 5
#: Training texts of each label.
PER_LABEL = 1500
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
SLOTS = 1 << 16
SHAPES = 5

_KIND = np.zeros(256, np.uint8)
_KIND[:] = 3
_KIND[SPACE] = 0
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def tokens(column: pa.Array):
    """Yields (first row, end row, hashes, shapes, bounds): row i has the tokens bounds[i] : bounds[i + 1]."""
    for lo, hi, data, starts in slices(column):
        kind = _KIND[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        first, end = edge, np.append(edge[1:], len(data))
        word = kind[first] != 0
        first, end = first[word], end[word]
        uppers = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
        upper, title = uppers[end] - uppers[first], _UPPER[data[first]] if len(first) else np.zeros(0, bool)
        shape = np.select([kind[first] != 1, upper == 0, (upper == end - first) & (upper > 1), title & (upper == 1)], [4, 0, 2, 1], 3)
        yield lo, hi, span_hashes(data, first, end), shape, np.searchsorted(first, starts)


def _index_entries(hashes: np.ndarray):
    """(place, sign) of each nonzero entry of the tokens' index vectors."""
    for i in range(NONZERO):
        part = (hashes >> np.uint64(7 * i)).astype(np.int64)
        yield part & (DIM - 1), 1.0 - 2.0 * ((part >> 6) & 1)


class Vectors:
    """Word vectors by slot: a word is known if its slot holds its hash."""

    def __init__(self, words: np.ndarray):
        self.slot_hash = np.zeros(SLOTS, np.uint64)
        self.slot_word = np.zeros(SLOTS, np.int32)
        slot = (words & np.uint64(SLOTS - 1)).astype(np.int64)
        for i in range(len(words) - 1, -1, -1):  # words come with the most frequent first, which keeps its slot
            self.slot_hash[slot[i]], self.slot_word[slot[i]] = words[i], i + SHAPES
        self.size = len(words) + SHAPES
        self.matrix = np.zeros((self.size, DIM), np.float32)

    def ids(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        return np.where(self.slot_hash[slot] == hashes, self.slot_word[slot], shape)

    def pooled(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), DIM + 2))
        for lo, _, hashes, shape, bounds in tokens(column):
            ids = self.ids(hashes, shape)
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), lo):
                n = int(b - a)
                if n:
                    known, times = np.unique(ids[a:b], return_counts=True)
                    out[row, :DIM] = times.astype(np.float32) @ self.matrix[known] / n
                    mean = sum(np.bincount(p, s, DIM) for p, s in _index_entries(hashes[a:b])) / n
                    out[row, DIM] = np.log((mean @ mean) + 1e-6)
                out[row, DIM + 1] = np.log1p(n)
        return out


def train_vectors(column: pa.Array) -> Vectors:
    parts = list(tokens(column))
    hashes = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64)
    shape = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
    text = np.concatenate([np.repeat(np.arange(p[0], p[1]), np.diff(p[4])) for p in parts]) if parts else np.zeros(0, np.int64)
    unique, place = np.unique(hashes, return_inverse=True)
    pairs = np.unique(place * (len(column) + 1) + text)
    texts = np.bincount(pairs // (len(column) + 1), minlength=len(unique))
    best = np.lexsort((unique, -texts))[:WORDS]
    vectors = Vectors(unique[best[texts[best] >= LEAST_TEXTS]])
    ids = vectors.ids(hashes, shape)
    for step in range(1, WINDOW + 1):
        near = text[step:] == text[:-step]
        for here, there in ((ids[:-step], hashes[step:]), (ids[step:], hashes[:-step])):
            for place, sign in _index_entries(there[near]):
                vectors.matrix += np.bincount(here[near] * DIM + place, sign, vectors.size * DIM).reshape(-1, DIM).astype(np.float32)
    vectors.matrix /= np.maximum(np.linalg.norm(vectors.matrix, axis=1, keepdims=True), 1e-9)
    return vectors


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Word vectors, the scaling of their pooled features, the network and its calibration."""

    def __init__(self, vectors, mean, scale, layers, temperature=1.0, shift=0.0, constant=None):
        self.vectors, self.mean, self.scale, self.layers = vectors, mean, scale, layers
        self.temperature, self.shift, self.constant = temperature, shift, constant

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((pooled - self.mean) / self.scale) @ w1 + b1, 0) @ w2 + b2

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return _sigmoid(self.raw(self.vectors.pooled(column)) / self.temperature + self.shift)


def fit(texts: list[str], labels: list[int], totals: dict[int, int] | None = None) -> Model:
    """The model of a bounded sample; totals: rows of each label in the whole data, for the classes' true shares."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model(None, None, None, None, constant=float(y[0]) if len(y) else 0.5)
    column = pa.array([t.encode() for t in texts], pa.large_binary())
    vectors = train_vectors(column)
    pooled = vectors.pooled(column)
    rng = np.random.default_rng(2)
    order = rng.permutation(len(y))
    kept_back, train = order[: len(y) // 6], order[len(y) // 6 :]
    mean, scale = pooled[train].mean(axis=0), pooled[train].std(axis=0) + 1e-6
    x = (pooled - mean) / scale
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) * (2 / x.shape[1]) ** 0.5, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * HIDDEN**-0.5, np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), 64):
            rows = train[lo : lo + 64]
            hidden = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            error = (_sigmoid(hidden @ layers[2] + layers[3]) - y[rows]) / len(rows)
            back = error[:, None] * layers[2] * (hidden > 0)
            grads = [x[rows].T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, layers)
    if len(kept_back):
        z = model.raw(pooled[kept_back])
        loss = {}
        for t in np.geomspace(0.2, 10, 50):
            p = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
            loss[t] = -(y[kept_back] * np.log(p) + (1 - y[kept_back]) * np.log(1 - p)).mean()
        model.temperature = float(min(loss, key=loss.get))
    if totals:
        true, sampled = totals[1] / totals[0], y.sum() / (len(y) - y.sum())
        model.shift = float(np.log(true / sampled))
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Fits on at most per_label texts of each class of labels (doc_id, <label>), none of a held-out row."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    rows = bounded_sample(docs.where(F.col("text").isNotNull()), known, "_label", per_label).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_label"], r["text"]))
    totals = {r["_label"]: r["count"] for r in known.where(~held_out(F.col("doc_id"))).groupBy("_label").count().collect()}
    return fit([r["text"] for r in rows], [r["_label"] for r in rows], totals)


def score(docs: DataFrame, model, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text), for any model with scores()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of words and weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = text.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
