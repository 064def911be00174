"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

Trained by numpy stochastic gradient descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = (1 << 20) + 64


def _power_table(base: int) -> np.ndarray:
    table = np.empty(_POWERS, np.uint64)
    table[0] = 1
    table[1:] = np.uint64(base)
    return np.multiply.accumulate(table)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend((_power_table(int(_BASE)), _power_table(pow(int(_BASE), -1, 1 << 64))))
    return _TABLES


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def features(data: np.ndarray, buckets: int, char_n: int = 4) -> np.ndarray:
    """Bucket of every word, pair of neighbouring words and run of ``char_n`` bytes of a piece of text.

    ``data`` holds at most 2**20 bytes; n-grams come from one polynomial prefix sum.
    """
    if not len(data):
        return np.empty(0, np.int64)
    power, inverse = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = []
    word = _mix((sums[end] - sums[begin]) * inverse[begin])
    out.append(word)
    if len(word) > 1:
        out.append(_mix(word[:-1] * np.uint64(3) + word[1:]))
    if len(data) >= char_n:
        out.append(_mix((sums[char_n:] - sums[:-char_n]) * inverse[: len(data) - char_n + 1] + np.uint64(char_n)))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def pieces(text: bytes) -> list[np.ndarray]:
    """A whole text as arrays of at most 2**20 bytes."""
    data = np.frombuffer(text, np.uint8)
    return [data[i : i + (1 << 20)] for i in range(0, len(data), 1 << 20)]


@dataclass
class Model:
    """gain[b]: what an n-gram in bucket b adds to the log-odds of label 1, before the mean; the two-way softmax folded."""

    gain: np.ndarray
    bias: float
    char_n: int = 4

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for piece in pieces(text):
            f = features(piece, len(self.gain), self.char_n)
            total += float(self.gain[f].sum())
            n += len(f)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -40, 40))))


def train(texts: list[bytes], labels: list[int], buckets: int = 1 << 16, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents in seeded order, step size falling to 0.

    Document vector v = mean of its n-grams' vectors; p = softmax(v W + c). Without rows,
    or with rows of one label only, the scores are that label's smoothed share.
    """
    n1 = sum(labels)
    prior = float(np.log((n1 + 1.0) / (len(labels) - n1 + 1.0)))
    if not texts or n1 in (0, len(labels)):
        return Model(np.zeros(buckets, np.float32), prior)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    w, c = np.zeros((dim, 2), np.float32), np.array([0.0, prior], np.float32)
    rows = []
    for t in texts:
        f = [features(p, buckets) for p in pieces(t)]
        ids, counts = np.unique(np.concatenate(f) if f else np.empty(0, np.int64), return_counts=True)
        rows.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            step = rate * (1 - done / steps)
            done += 1
            v = share @ vectors[ids]
            z = v @ w + c
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = w @ p
            w -= step * np.outer(v, p)
            c -= 0.02 * step * p
            vectors[ids] -= (step * share)[:, None] * back
    return Model((vectors @ (w[:, 1] - w[:, 0])).astype(np.float32), float(c[1] - c[0]))


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 64 << 20, label: str = "quality", **options) -> Model:
    """Fits a model on at most ``sample`` labelled rows, ``sample_bytes`` together, that are not held out.

    The sample is bounded on purpose: rows with the lowest hash of their id, whole texts,
    as long as they fit; the driver holds no more. Rows with a null id or label are left
    out; an id that documents or labels repeat gives several rows, which count as such.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", F.col(label).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).withColumn("_size", F.octet_length("t"))
    rows = texts.where(F.col("_size") <= sample_bytes).join(F.broadcast(chosen), "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    rows = rows.orderBy("_h", "doc_id", "_y", "_size").limit(sample)
    total = F.sum("_size").over(Window.orderBy("_h", "doc_id", "_y", "_size", "t").rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("_total", total).where(F.col("_total") <= sample_bytes).select("doc_id", "t", "_y").toPandas().sort_values(["doc_id", "t"], kind="stable")
    return train([bytes(t) for t in got["t"]], [int(y) for y in got["_y"]], **options)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to every row; reads whole texts and nothing but texts.

    Null texts count as empty and get the model's bias. The model is a table of fixed size
    (buckets), sent to the executors once.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.gain, model.bias, model.char_n))

    @F.pandas_udf("double")
    def score(texts):
        m = Model(*sent.value)
        return texts.map(m.score)

    docs = docs.drop("score", "predicted")
    scored = docs.withColumn("score", score(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
