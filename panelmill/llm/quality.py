"""Quality classifier on random-indexing word vectors.

1. Random indexing over all documents: each document has a sparse ternary index vector (drawn from a hash of its
   text), and each word bucket sums the index vectors of the documents it occurs in, each at most 8
   times; words share buckets by a hash.  Sums are integers, so the result
   doesn't depend on the order of tasks.  The table has `buckets` x `dims` numbers whatever the corpus.
2. A document is pooled: mean and spread of its words' vectors with inverse document frequencies as weights.
3. A two-layer numpy network is fitted on the driver to at most `sample` labelled documents, those with the smallest
   hashes; a fifth of them sets the temperature that calibrates the probabilities.

Labels, lang, source and doc_id are never inputs of a score.
Defined results: null and empty texts get the score of a pooled vector of zeros; repeated rows give repeated rows
(a null doc_id has no label); with
no labelled row, or labels of one kind, all scores are the share of label 1 (0.5 with none); other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of

#: Letter runs, single digits and single marks are words here.
TOKEN = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    dims: int = 48
    ones: int = 6
    sample: int = 20_000
    hidden: int = 24
    epochs: int = 40
    seed: int = 7


class _Buckets(dict):
    """Word -> bucket.  Upper-case words keep their own, so that shouting shows."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        shape = word if word.isupper() and len(word) > 1 else word.lower()
        if len(self) > 100_000:
            self.clear()
        bucket = self[word] = zlib.crc32(shape.encode()) % self.n
        return bucket


def _counted(text: str, known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    words = TOKEN.findall(text)
    return np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)


def word_vectors(documents: DataFrame, s: Settings, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (buckets x dims) and document frequencies (buckets) over all documents."""
    columns = ["bucket", "df", *(f"v{k}" for k in range(s.dims))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, df = _Buckets(s.buckets), np.zeros((s.buckets, s.dims), np.int64), np.zeros(s.buckets, np.int64)
        for batch in portions(batches, "_text"):
            for text in texts_of(batch, "_text"):
                if not text:
                    continue
                ids, counts = _counted(text, known)
                draw = np.random.default_rng(zlib.crc32(text.encode()))
                at = draw.choice(s.dims, s.ones, replace=False)
                sums[ids[:, None], at] += np.minimum(counts, 8)[:, None] * draw.choice([-1, 1], s.ones)
                df[ids] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used]), *(pa.array(sums[used, k]) for k in range(s.dims))], columns)

    partial = documents.select(F.col(text).alias("_text")).mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    rows = partial.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns[1:])).toPandas().to_numpy(np.int64)
    vectors, df = np.zeros((s.buckets, s.dims), np.float32), np.zeros(s.buckets, np.int64)
    if len(rows):
        df[rows[:, 0]] = rows[:, 1]
        vectors[rows[:, 0]] = rows[:, 2:]
        used = df > 0
        vectors[used] -= vectors[used].sum(0) / max(df[used].sum(), 1) * df[used][:, None]  # what all words share says nothing
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    return vectors, df


def pooled(texts: list[str], vectors: np.ndarray, weights: np.ndarray, known: _Buckets) -> np.ndarray:
    """A row for each text: weighted mean and spread of its word vectors, weighted share of repeats, log length."""
    dims = vectors.shape[1]
    out = np.zeros((len(texts), 2 * dims + 2), np.float32)
    for row, text in zip(out, texts):
        ids, counts = _counted(text, known)
        if len(ids):
            w = counts * weights[ids]
            w = w / max(w.sum(), 1e-9)
            v = vectors[ids]
            mean = w @ v
            row[:dims], row[dims : 2 * dims] = mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
            row[-2:] = len(ids) / counts.sum(), np.log1p(counts.sum()) / 10
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs; its size depends on the settings alone."""

    vectors: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    share: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Adam on cross-entropy; the layers are a hidden one with rectifiers and a logit."""
    draw = np.random.default_rng(s.seed)
    p = [draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), draw.normal(0, np.sqrt(1 / s.hidden), s.hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(s.epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), 128):
            bx, by = x[order[at : at + 128]], y[order[at : at + 128]]
            h = np.maximum(bx @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - by) / len(bx)
            back = error[:, None] * p[2] * (h > 0)
            grads = [bx.T @ back + 1e-4 * p[0], back.sum(0), h.T @ error + 1e-4 * p[2], error.sum(keepdims=True)]
            step += 1
            for a, g, m, v in zip(p, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The caller keeps held-out rows out of `labels`; word vectors come from all documents, without labels."""
    spark = documents.sparkSession
    vectors, df = word_vectors(documents, s, text)
    weights = np.log((df.max(initial=0) + 1) / (df + 1)).astype(np.float32) + 0.1
    table = spark.sparkContext.broadcast((vectors, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (v, w) = _Buckets(s.buckets), table.value
        for batch in portions(batches, "_text"):
            x = pooled(texts_of(batch, "_text"), v, w, known)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_y"))
    chosen = one.withColumn("_h", F.xxhash64("_key")).orderBy("_h", "_key").limit(s.sample)
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text")).select("_text", "_y").mapInArrow(run, "y int, x binary").toPandas()
    table.unpersist()
    dims = 2 * s.dims + 2
    x = np.frombuffer(b"".join(bytes(b) for b in rows["x"]), np.float32).reshape(-1, dims).astype(np.float64)
    y = rows["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T[:8], y)) if len(y) else np.arange(0)  # rows come in any order
    x, y = x[order], y[order]
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(dims), np.ones(dims))
    if len(y) < 10 or share in (0.0, 1.0):
        return Model(vectors, weights, mean, scale, None, 1.0, share)
    fifth = np.random.default_rng(s.seed).permutation(len(y)) % 5 == 0
    layers = _train((x[~fifth] - mean) / scale, y[~fifth], s)
    z = Model(vectors, weights, mean, scale, layers, 1.0, share).logits(x[fifth])
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, z / t) - y[fifth] * z / t) for t in grid]
    return Model(vectors, weights, mean, scale, layers, float(grid[int(np.argmin(loss))]), share)


def score(documents: DataFrame, model: Model, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """All columns and score double, the probability of label 1; a column of that name is replaced."""
    kept = documents.drop("score")
    schema = kept.withColumn("score", F.lit(0.5)).schema
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = _Buckets(s.buckets), shared.value
        for batch in portions(batches, text):
            p = m.scores(pooled(texts_of(batch, text), m.vectors, m.weights, known))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema)
