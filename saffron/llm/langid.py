"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased (A-Z and the accented letters of Latin-1), everything but letters is read as a space, and the
byte n-grams of ORDERS are hashed into BUCKETS embeddings. Their average goes through a linear softmax; both are
trained by stochastic gradient descent in numpy on at most PER_LANG texts of each language.

The softmax has one class more than there are languages, for what is no language it knows: noise made from the training
texts by shuffling their letters, by exchanging letters for others throughout, and by drawing letters at random. A
score is the probability of the best language, so noise scores low. A part of the texts, with the noise made of it, is
kept back to fit a temperature and the score below which a prediction is rejected: a third of the way, in log odds, up
from what all but COST of the noise stays under to what all but COST of the genuine texts reach, or the latter where
these overlap. The model tells the shares of noise accepted and of genuine texts rejected there.

As average and softmax layer are both linear, prediction adds one row of (embedding x layer) for each n-gram.

Defined results: a null text and one without a letter are `und` with score 0 and rejected. With no training rows every
text is `und`. Rows that repeat are scored each for itself; extra columns are ignored by predict() and kept by
with_language().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import slices
from ._spark import bounded_sample

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 16
#: Training texts of each language.
PER_LANG = 500
EPOCHS, RATE, TEXTS = 12, 40.0, 16
#: Share of correct calibration texts that rejection may cost.
COST = 0.001
#: Letters of the short extracts that training adds to each text, and the fewest and most of a piece of noise.
EXTRACT, NOISE = (3, 120), (15, 1500)

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z, and the two-byte letters from U+00C0 to U+00DE), everything else as spaces."""
    b = _FOLD[data]
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    b[second] += 0x20
    return b


def _grams(data: np.ndarray):
    """For each order: the bucket at each position, and whether a letter is among its first two bytes."""
    b = folded(data).astype(np.uint32)
    h = b
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in ORDERS:
            bucket = ((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
            letters = (b[: len(h)] != 32) | (b[1 : len(h) + 1] != 32)
            yield n, bucket, letters


def _document_rows(data, starts, n):
    """Where the n-grams of each document begin and end among all positions."""
    first = starts[:-1]
    return first, np.maximum(starts[1:] + 2 - n, first)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    _, _, data, _ = next(slices(pa.array([text.encode()], pa.large_binary())))
    found = np.concatenate([bucket[letters] for _, bucket, letters in _grams(data)] or [np.zeros(0, np.uint32)])
    buckets, n = np.unique(found, return_counts=True)
    return buckets, (n / max(1, n.sum())).astype(np.float32)


def noise(text: str, kind: int, rng: np.random.Generator) -> str:
    """A piece of a text without its language. Kind 0 shuffles its letters, kind 1 exchanges each letter for another,
    kind 2 draws letters at random; what is no letter stays where it is."""
    size = int(rng.integers(*NOISE))
    at = int(rng.integers(max(1, len(text) - size)))
    points = np.frombuffer(text[at : at + size].encode("utf-32-le", "replace"), np.uint32).copy()
    letters = np.flatnonzero(np.array([chr(c).isalpha() for c in points], bool))
    if kind == 0:
        points[letters] = rng.permutation(points[letters])
    elif kind == 1:
        used, place = np.unique(points[letters], return_inverse=True)
        points[letters] = rng.permutation(used)[place] if len(used) > 9 else rng.integers(ord("a"), ord("z") + 1, len(letters))
    else:
        points[letters] = rng.integers(ord("a"), ord("z") + 1, len(letters))
    return points.tobytes().decode("utf-32-le")


def _extract(text: str, rng: np.random.Generator) -> str:
    size = int(rng.integers(*EXTRACT))
    at = int(rng.integers(max(1, len(text) - size)))
    return text[at : at + size]


class Model:
    """langs: the learned values; weights: a row for each bucket and one of zeros, a column for each language and one
    for noise; bias; temperature; threshold; accepted and rejected: shares of noise and of genuine texts kept back."""

    def __init__(self, langs, weights, bias, temperature=1.0, threshold=0.0, accepted=0.0, rejected=0.0):
        self.langs, self.weights, self.bias, self.temperature, self.threshold = langs, weights, bias, temperature, threshold
        self.accepted, self.rejected = accepted, rejected

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.weights.shape[1]))
        for lo, hi, data, starts in slices(column):
            total, seen = np.zeros((hi - lo, out.shape[1])), np.zeros(hi - lo)
            for n, bucket, letters in _grams(data):
                first, end = _document_rows(data, starts, n)
                some = np.flatnonzero(np.minimum(end, len(bucket)) > first)
                if len(some):
                    bounds = np.stack([first[some], np.minimum(end[some], len(bucket))], axis=1).ravel()
                    bounds = bounds[:-1] if bounds[-1] == len(bucket) else bounds
                    rows = self.weights[np.where(letters, bucket, np.uint32(BUCKETS))]
                    total[some] += np.add.reduceat(rows, bounds, axis=0, dtype=np.float64)[::2]
                    seen[some] += np.add.reduceat(letters, bounds, dtype=np.int64)[::2]
            out[lo:hi] = total / np.maximum(seen, 1)[:, None]
        return out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def guesses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text and its probability."""
        p = self.probabilities(self.logits(column))[:, :-1]
        return p.argmax(axis=1), p.max(axis=1)


def _trained(grams: list, y: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by stochastic gradient descent over texts given as counts(), each class with the same weight."""
    order = np.arange(len(y))
    embed = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    share = np.bincount(y, minlength=classes) / max(1, len(y))
    steps, step = EPOCHS * max(1, -(-len(y) // TEXTS)), 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for lo in range(0, len(order), TEXTS):
            rows = order[lo : lo + TEXTS]
            used, place = np.unique(np.concatenate([grams[i][0] for i in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            at = np.repeat(np.arange(len(rows)), [len(grams[i][0]) for i in rows])
            x[at, place] = np.concatenate([grams[i][1] for i in rows])
            mean = x @ embed[used]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (1 / (classes * np.maximum(share[y[rows]], 1e-9)))[:, None] / len(rows)
            rate = RATE * (1 - step / steps)
            back = p @ layer.T
            layer -= 0.05 * rate * (mean.T @ p)
            bias -= 0.005 * rate * p.sum(axis=0)
            embed[used] -= rate * (x.T @ back)
            if not step:  # the layer starts at zero, so the first step gives the embeddings a direction
                layer += (rng.standard_normal(layer.shape) / DIM).astype(np.float32)
            step += 1
    return np.vstack([embed @ layer, np.zeros((1, classes))]).astype(np.float32), bias.astype(np.float64)


def fit(texts: list[str], labels: list[str]) -> Model:
    """The model of a bounded sample of texts; deterministic."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(6)
    order = rng.permutation(len(texts))
    kept_back, train = order[: len(texts) // 8], order[len(texts) // 8 :]
    y = np.array([langs.index(x) for x in labels])
    junk = len(langs)
    false = [noise(texts[i], place % 3, rng) for place, i in enumerate(order)]  # of kept-back texts first
    grams = [counts(texts[i]) for i in train] + [counts(_extract(texts[i], rng)) for i in train] + [counts(t) for t in false[len(kept_back) :]]
    weights, bias = _trained(grams, np.concatenate([y[train], y[train], np.full(len(train), junk)]), junk + 1, rng)
    model = Model(langs, weights, bias)
    if len(kept_back):
        genuine = pa.array([texts[i].encode() for i in kept_back], pa.large_binary())
        false = pa.array([t.encode() for t in false[: len(kept_back)]], pa.large_binary())
        logits = np.concatenate([model.logits(genuine), model.logits(false)])
        truth = np.concatenate([y[kept_back], np.full(len(kept_back), junk)])
        loss = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = t
            loss[t] = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = min(loss, key=loss.get)
        best, score = model.guesses(genuine)
        right, wrong = score[best == y[kept_back]], model.guesses(false)[1]
        if len(right):
            high, low = (np.clip(q, 1e-6, 1 - 1e-6) for q in (np.quantile(right, COST), np.quantile(wrong, 1 - COST)))
            odds = (np.log(high / (1 - high)) + 2 * np.log(low / (1 - low))) / 3
            model.threshold = float(1 / (1 + np.exp(-odds)) if low < high else high)
            model.accepted, model.rejected = float((wrong >= model.threshold).mean()), float((score < model.threshold).mean())
    return model


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fits on at most per_lang texts of each non-null lang, none of a held-out row."""
    labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("_lang"))
    rows = bounded_sample(docs.where(F.col("text").isNotNull()), labels, "_lang", per_lang).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["_lang"] for r in rows])


def _guess(model: Model, text: pa.Array, has_letter: np.ndarray):
    if not model.langs:
        has_letter = np.zeros(len(text), bool)
        best, score = np.zeros(len(text), int), np.zeros(len(text))
    else:
        best, score = model.guesses(text)
    names = np.array([*model.langs, "und"], object)
    pred = names[np.where(has_letter, best, len(model.langs))]
    score = np.where(has_letter, score, 0.0)
    return pred, score, ~has_letter | (score < model.threshold)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number a language

    def run(batches):
        for batch in batches:
            pred, score, rejected = _guess(shared.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return _input(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def _input(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)).alias("has_letter"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = "_has_letter"
    while letter in docs.columns:
        letter = "_" + letter
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            flag = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            _, _, rejected = _guess(shared.value, batch.column(place), flag)
            kept = batch.filter(pa.array(~rejected))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    flagged = docs.withColumn(letter, F.coalesce(F.rlike(F.col("text"), F.lit(r"\p{L}")), F.lit(False)))
    return flagged.mapInArrow(run, docs.schema)
