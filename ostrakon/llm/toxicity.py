"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words, of its words' first letters
(stems), of pairs of neighbouring words and of pairs one word apart, each at
most once a text.  Training keeps a rate for each coordinate and an L1 penalty,
so nearly all weights stay exactly zero; the others are broadcast as two short
arrays.  Their number is bounded by the features of the training sample.

Training reads a bounded sample of labelled rows: at most ``most_positive``
toxic and ``most_negative`` other documents, chosen by a hash of their id, and
of these in the order of another hash as many as have ``most_bytes`` of
features.  Labels are the only supervision; id, language and source are never
features.  Rates and penalties are ``SETTINGS``; ``choose`` gave them, which
compares settings by cross-validation among folds 1 to 4.  Fold 0 takes no
part in either.

Defined cases: null and empty texts have no features and get the score of the
intercept; null labels and ids are no training rows; an id labelled twice
counts as toxic if one label says so; without training rows of both classes
every score is the share of toxic rows (0 without any rows); equal texts get
equal scores; columns other than the id and the text are ignored.
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

from .common import WordHashes, bytes_of, frugal, materialise, mix64

BITS = 22
_TRIM = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


class Words(dict):
    """Kept within a task only.  raw token -> (hash of the word without marks around it, hash of its stem)."""

    def __init__(self):
        super().__init__()
        self.hashes = WordHashes()

    def __missing__(self, raw: bytes) -> tuple[int, int]:
        word = _TRIM.sub(b"", raw.lower()) or raw
        value = self.hashes[word], self.hashes[b"\x01" + word.decode("utf-8", "ignore")[:5].encode()]
        self.hashes.trim()
        if len(self) > 150_000:
            self.clear()
        self[raw] = value
        return value


def feature_ids(text: bytes, words: Words, bits: int = BITS) -> np.ndarray:
    """The distinct hashed features of a text, sorted."""
    raw = text.split()
    if not raw:
        return np.empty(0, np.int64)
    pairs = np.array([words[w] for w in raw], dtype=np.uint64)
    h = pairs[:, 0]
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    parts = [h, pairs[:, 1], mix64(h[:-1] * a + h[1:]), mix64(h[:-2] * b + h[2:] * c)]
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Weights:
    """A sparse model: sorted coordinates, their weights, the intercept."""

    ids: np.ndarray
    values: np.ndarray
    intercept: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        w = np.zeros(1 << bits, np.float32)
        w[self.ids] = self.values
        return w


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5, epochs: int = 8) -> Weights:
    """FTRL-proximal over the rows in their order, ``epochs`` times."""
    n_pos = int(labels.sum())
    if not n_pos or n_pos == len(labels):
        share = (n_pos / len(labels)) if len(labels) else 0.0
        return Weights(np.empty(0, np.int64), np.empty(0, np.float32), float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -30, 30)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = float(np.log(n_pos / (len(labels) - n_pos)))
    bias_n = 0.0
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            g = sigmoid(w.sum() + bias) - y
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= 0.1 * g / (1 + bias_n**0.5)
    kept = np.flatnonzero(np.abs(z) > l1)
    values = -(z[kept] - np.sign(z[kept]) * l1) / ((beta + np.sqrt(n[kept])) / alpha + l2)
    return Weights(kept, values.astype(np.float32), bias)


#: What ``choose`` gave on the labelled rows of sf0.1 that lie in folds 1 to 4.
SETTINGS = {"alpha": 3.0, "l1": 4.0, "l2": 0.5, "epochs": 8}


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_ids(labels: DataFrame, most_positive: int, most_negative: int, held_out: bool = True) -> dict[int, int]:
    """doc_id -> label of the bounded sample, in the order of a hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if held_out:
        known = known.where(fold_of(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    out: dict[int, int] = {}
    for value, most in ((1, most_positive), (0, most_negative)):
        rows = known.where((F.col("toxic") > 0) if value else (F.col("toxic") <= 0)).orderBy("h", "doc_id").limit(most).select("doc_id").collect()
        out |= {r.doc_id: value for r in rows}
    return out


def sample(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_negative: int = 5000, held_out: bool = True, most_bytes: int = 256 << 20) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Ids, labels and features of the training rows, in the order of a hash; the ids looked for are broadcast, so no text is shuffled.

    Of an id that repeats, the text with the fewest features counts.
    """
    wanted = training_ids(labels, most_positive, most_negative, held_out)
    if not wanted:
        return [], np.empty(0), []
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, v) for k, v in wanted.items()], "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [feature_ids(t, words).astype(np.int32).tobytes() for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "y", "n", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(frugal(run), "doc_id long, y int, n long, x binary")
    picked = materialise(picked.groupBy("doc_id", "y").agg(F.min(F.struct("n", "x")).alias("f")).select("doc_id", "y", "f.n", "f.x"), "toxic-sample")
    sizes = sorted(((hash_id(r.doc_id), r.doc_id, r.n) for r in picked.select("doc_id", "n").collect()))
    fit = int((np.cumsum([n for _, _, n in sizes]) <= most_bytes).sum()) if sizes else 0
    if fit < len(sizes):
        picked = picked.join(F.broadcast(spark.createDataFrame([(i,) for _, i, _ in sizes[:fit]], "doc_id long")), "doc_id", "left_semi")
    found = picked.select("doc_id", "y", "x").toArrow()
    ids, ys, xs = found.column("doc_id").to_pylist(), found.column("y").to_pylist(), found.column("x").to_pylist()
    del found
    order = sorted(range(len(ids)), key=lambda i: (hash_id(ids[i]), ids[i]))
    return [ids[i] for i in order], np.array([ys[i] for i in order], float), [np.frombuffer(xs[i], np.int32) for i in order]


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_negative: int = 5000, held_out: bool = True, most_bytes: int = 256 << 20, **options) -> Weights:
    """Weights from a bounded sample of labelled rows."""
    _, y, rows = sample(docs, labels, most_positive, most_negative, held_out, most_bytes)
    return ftrl(rows, y, **(SETTINGS | options))


def choose(ids: list[int], y: np.ndarray, rows: list[np.ndarray], grid: list[dict] | None = None) -> list[tuple[float, float, dict]]:
    """The mean of missed toxic and falsely rejected rows (shares), the log-loss, and the settings, over folds 1 to 4, each predicted by the other three; the best first.

    ``ids`` must not lie in fold 0, as those of ``sample`` do not.
    """
    grid = grid or [{"alpha": a, "l1": l1, "l2": 0.5, "epochs": e} for a in (0.3, 1.0, 3.0) for l1 in (1.0, 2.0, 4.0, 8.0) for e in (2, 4, 8)]
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    if (fold == 0).any():
        raise ValueError("rows of fold 0 may not choose settings")
    out = []
    for options in grid:
        told = np.full(len(y), 0.5)
        for k in range(1, 5):
            model = ftrl([r for r, f in zip(rows, fold) if f != k], y[fold != k], **options)
            dense = model.dense()
            told[fold == k] = [sigmoid(float(dense[r].sum(dtype=np.float64)) + model.intercept) for r, f in zip(rows, fold) if f == k]
        wrong = (told >= 0.5) != (y > 0)
        shares = [float(wrong[(y > 0) == c].mean()) for c in (True, False) if ((y > 0) == c).any()]
        loss = -np.log(np.clip(np.where(y > 0, told, 1 - told), 1e-12, 1))
        out.append((float(np.mean(shares)) if shares else 0.0, float(loss.mean()) if len(y) else 0.0, options))
    return sorted(out, key=lambda r: r[:2])


def hash_id(x: int) -> int:
    return int(mix64(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.ids, weights.values, weights.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(*shared.value)
        dense, words = model.dense(), Words()
        for batch in batches:
            scores = [sigmoid(float(dense[feature_ids(t, words)].sum(dtype=np.float64)) + model.intercept) for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    return score(docs, train(docs, labels, **options)).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    weights = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((weights.ids, weights.values, weights.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(*shared.value)
        dense, words = model.dense(), Words()
        for batch in batches:
            yield batch.filter(pa.array([sigmoid(float(dense[feature_ids(t, words)].sum(dtype=np.float64)) + model.intercept) < threshold for t in bytes_of(batch, "text")], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
