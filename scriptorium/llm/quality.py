"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every term (a word's form, its shape, and a mark where a word repeats the one before it) has a fixed
sparse random index vector. A word's context vector sums the index vectors of the terms beside it in the
training sample, kept in hashed rows. A document is the mean of its shapes' index vectors and
of its words' context vectors; a two-layer network in numpy scores it, and its logits are divided by a
temperature fitted on rows kept out of training.

Cases: null and empty texts pool to zeros and get the network's score for that; equal texts get equal
scores; an empty table gives no rows; with no labels, or labels of one class, the score is the smoothed
share of label 1; rows with null ids are scored; further columns stay as they are, and where one has the score's name, the score's gets
underscores at its end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, bounded_texts, by_texts, fresh, give_back, held, mix, slices
from ._words import Words, words

DIM = 64
ROWS = 1 << 15
HIDDEN = 24
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8000
#: Bytes of their texts, at most, for each label.
SAMPLE_BYTES = 32 << 20
ECHO = np.uint64(0x1D8E4E27C47D124F)
CHARS = 1 << 17


def index_vectors(terms: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the terms' index vectors by row: four signed ones each, at places taken from the hash."""
    out = np.zeros(n * DIM)
    for k in range(4):
        h = mix(terms + np.uint64(k + 1))
        at = rows * DIM + (h % np.uint64(DIM)).astype(np.int64)
        out += np.bincount(at, weights=1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)), minlength=n * DIM)
    return out.reshape(n, DIM)


def _terms(w: Words) -> np.ndarray:
    """Each word's shape, or the repetition mark."""
    terms = w.shapes.copy()
    same = (w.words[1:] == w.words[:-1]) & (w.doc[1:] == w.doc[:-1])
    terms[1:][same] = ECHO
    return terms


@dataclass
class Model:
    context: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        parts = [pooled(texts[a:b], self.context) for a, b in slices((len(t or "") for t in texts), CHARS)]
        return np.concatenate(parts) if parts else np.zeros((0, 2 * DIM))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -40, 40)))


def pooled(texts: list[str | None], context: np.ndarray) -> np.ndarray:
    w = words(texts, lower=False, shapes=True)
    n = np.maximum(np.diff(w.first), 1)[:, None]
    shape = index_vectors(_terms(w), w.doc, len(texts)) / n
    mine = np.zeros((len(texts), DIM))
    if len(w.words):
        row = (w.words % np.uint64(ROWS)).astype(np.int64)
        full = np.flatnonzero(np.diff(w.first))
        for a in range(0, len(full), 64):
            some = full[a : a + 64]
            lo, hi = w.first[some[0]], w.first[some[-1] + 1]
            mine[some] = np.add.reduceat(context[row[lo:hi]], w.first[some] - lo, axis=0, dtype=np.float32)
    return np.hstack((shape, mine / n))


def context_vectors(texts: list[str | None]) -> np.ndarray:
    """Hashed words' summed neighbours, each row of unit length."""
    out = np.zeros((ROWS, DIM))
    for a, b in slices((len(t or "") for t in texts), CHARS):
        w = words(texts[a:b], lower=False, shapes=True)
        if len(w.words) < 2:
            continue
        terms, row = _terms(w), (w.words % np.uint64(ROWS)).astype(np.int64)
        near = w.doc[1:] == w.doc[:-1]
        out += index_vectors(terms[1:][near], row[:-1][near], ROWS)
        out += index_vectors(terms[:-1][near], row[1:][near], ROWS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)
    return out.astype(np.float32)


def fit(texts: list[str | None], y: np.ndarray, seed: int = 7, epochs: int = 60) -> Model:
    y = np.asarray(y, dtype=float)
    context = context_vectors(texts)
    model = Model(context, *(np.zeros(1),) * 4, np.zeros(1), 0.0, 1.0)
    if len(set(y.tolist())) < 2:
        model.prior = float((y.sum() + 1) / (len(y) + 2))
        return model
    x = model.features(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, train = order[: len(x) // 5], order[len(x) // 5 :]
    model.mean, model.spread = x[train].mean(0), x[train].std(0) + 1e-3
    model.w1, model.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    model.w2, model.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
    z = (x - model.mean) / model.spread
    p = [model.w1, model.b1, model.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[batch] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[batch]) / len(batch)
            back = np.outer(error, p[2]) * (1 - h**2)
            grads = [z[batch].T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            t += 1
            for q, g, a, b in zip(p, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    model.b2 = float(p[3][0])
    held = kept if len(kept) else train
    logits = model.logits(x[held])
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.logaddexp(0, -(2 * y[held] - 1) * logits / s).mean() for s in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled documents outside the held-out fold, by hashed id, and of each label as many as hold ``most``
    bytes of text, as (texts, labels)."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    found = bounded_texts(docs, [(r.doc_id, r.quality) for r in picked], most)
    return [t for t, _ in found], np.array([y for _, y in found])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score in a column ``fresh(docs, name)``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        held(None)
        return by_texts(texts, lambda some: shared.value.score(some), pa.float64())

    # Not deterministic in the planner's eyes, so that a filter on the score doesn't evaluate it twice.
    return docs.withColumn(fresh(docs, name), score.asNondeterministic()(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, name: str = "score") -> DataFrame:
    model = fit(*training_rows(docs, labels, rows))
    give_back()
    return scored(docs, model, name)
