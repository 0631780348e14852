"""Quality classifier by co-training of two views.

The text view sees statistics of the content (shares of letters, digits,
marks and capitals, repetition of words and lines, lengths of words).  The
metadata view sees language, source and the length that the table states.
Both are logistic regressions; the text view's numbers are also cut at
quantiles, so each may act without being linear.  Over some rounds each view
labels the rows of an unlabelled pool that it is surest of and hands them to
the other as pseudo-labels.  Then each view is calibrated on labelled rows
that trained neither (Platt), the two log-odds are combined by a third
regression on those rows, and all documents are scored.

Labelled rows and pool are bounded samples by a hash of the id
(``most_labelled``, ``most_pool``); scoring covers every row.

Defined cases: null and empty texts have all-zero statistics and are scored by
them; null language or source is a value of its own; null labels are left out,
an id labelled twice is good if any label says so; with labels of one class
only, or none, every score is the smoothed share of good rows; equal rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, free_name, frugal

_CLASS = np.zeros(256, np.int64)
for _name, _code in ((range(0x61, 0x7B), 1), (range(0x41, 0x5B), 2), (range(0x30, 0x3A), 3), ((0x20, 0x09, 0x0D), 4), ((0x0A,), 5), (range(0x80, 0x100), 6), ((0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27, 0x22, 0x2D, 0x28, 0x29, 0x3D, 0x5F, 0x40, 0x2F, 0x2B, 0x3C, 0x3E), 7)):
    _CLASS[list(_name)] = _code
#: Statistics of the text view.
TEXT_FEATURES = ("lower", "upper", "digit", "space", "newline", "other_bytes", "marks", "symbols", "words", "word_length", "distinct", "top_word", "doubled", "capital_words", "symbol_words", "distinct_lines", "line_length", "long_words", "doubled_run")
HASHED_SOURCES = 64


def text_features(text: bytes) -> np.ndarray:
    """The statistics of one text; all zero if it has no words."""
    out = np.zeros(len(TEXT_FEATURES))
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, minlength=8)
    n, m = len(text), len(words)
    out[:8] = kinds[[1, 2, 3, 4, 5, 6, 7, 0]] / n
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    out[8] = np.log1p(m)
    out[9] = sum(map(len, words)) / m
    out[10] = len(seen) / m
    out[11] = max(seen.values()) / m if m > 3 else 0.0
    out[12] = doubled / m
    out[13] = sum(map(bytes.isupper, words)) / m
    out[14] = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!'\")-") / m
    out[15] = len(set(lines)) / max(1, len(lines))
    out[16] = np.log1p(n / max(1, len(lines)))
    out[17] = sum(c for w, c in seen.items() if len(w) > 25) / m
    out[18] = doubled / max(1, m - len(seen))
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the stated length."""
    out = np.zeros(8 + HASHED_SOURCES + 2)
    out[hashlib.md5(f"l{lang}".encode()).digest()[0] % 8] = 1
    out[8 + hashlib.md5(f"s{source}".encode()).digest()[0] % HASHED_SOURCES] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[-2:] = size / 10, (size / 10) ** 2
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weight: np.ndarray | None = None, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class Model:
    """Both views, their calibrations (slope, shift) and the combination."""

    edges: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray
    both: np.ndarray
    constant: float | None = None

    def widen(self, x: np.ndarray) -> np.ndarray:
        return widen(x, self.edges)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, combined), each a probability of being good."""
        if self.constant is not None:
            c = np.full(len(text), self.constant)
            return c, c, c
        a = log_odds(log_odds(self.widen(text), self.text)[:, None], self.text_fit)
        b = log_odds(log_odds(meta, self.meta)[:, None], self.meta_fit)
        c = log_odds(np.column_stack([a, b]), self.both)
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, c))


def widen(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Standardised numbers and, for each, steps at its quantiles; ``edges``: mean, deviation, then the cuts, by column."""
    z = np.clip((x - edges[0]) / edges[1], -4, 4)
    steps = [(x > cut).astype(float) for cut in edges[2:]]
    return np.hstack([z, *steps])


def cuts(x: np.ndarray) -> np.ndarray:
    return np.vstack([x.mean(0), x.std(0) + 1e-9, np.quantile(x, [0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99], axis=0)])


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = 4, share: float = 0.04, trust: float = 0.5, confident: float = 0.9) -> Model:
    """The model from labelled rows (every fifth row calibrates) and an unlabelled pool.

    In each round a view hands over the surest ``share`` of the pool, divided
    by its own estimate of both classes, if it is at least ``confident``;
    pseudo-labels weigh ``trust``.
    """
    good = float(y.sum())
    edges = cuts(np.vstack([text, pool_text])) if len(text) + len(pool_text) else np.ones((11, len(TEXT_FEATURES)))
    if not 0 < good < len(y) or len(y) < 10:
        share_good = (good + 1) / (len(y) + 2)
        return Model(edges, *(np.zeros(1),) * 5, constant=share_good)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit = ~held
    xt, pt = widen(text, edges), widen(pool_text, edges) if len(pool_text) else np.empty((0, len(TEXT_FEATURES) * 10))
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has received
    views = [(xt, pt), (meta, pool_meta)]
    models: list[np.ndarray] = [np.zeros(1), np.zeros(1)]
    for round_ in range(rounds + 1):
        for v, (x, pool) in enumerate(views):
            got = sorted(given[v])
            models[v] = logistic(np.vstack([x[fit], pool[got]]), np.concatenate([y[fit], [given[v][i] for i in got]]), weight=np.concatenate([np.ones(fit.sum()), np.full(len(got), trust)]))
        if round_ == rounds or not len(pool_text):
            break
        for v, (_, pool) in enumerate(views):
            p = 1 / (1 + np.exp(-log_odds(pool, models[v])))
            most = int(share * len(pool))
            prior = good / len(y)
            for order, label, n, sure in ((np.argsort(-p, kind="stable"), 1.0, int(most * prior), p), (np.argsort(p, kind="stable"), 0.0, int(most * (1 - prior)), 1 - p)):
                fresh = [i for i in order if i not in given[1 - v]][:n]
                given[1 - v].update({int(i): label for i in fresh if sure[i] >= confident})
    cal = held if held.any() else fit
    fits = [logistic(log_odds(x, m)[cal][:, None], y[cal], l2=0.01) for (x, _), m in zip(views, models)]
    both = np.column_stack([log_odds(log_odds(x, m)[:, None], f) for (x, _), m, f in zip(views, models, fits)])[cal]
    return Model(edges, models[0], models[1], fits[0], fits[1], logistic(both, y[cal], l2=0.01))


def sample_ids(labels: DataFrame, docs: DataFrame, most_labelled: int, most_pool: int) -> tuple[dict[int, int], list[int], float]:
    """The labelled sample (id -> label, in hash order; bad rows get half of the places), ids of the unlabelled pool, and
    by how much the log-odds of a good row among all labels exceed those in the sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    out = {}
    for value in (1, 0):
        rows = known.where((F.col("quality") > 0) if value else (F.col("quality") <= 0)).orderBy("h", "doc_id").limit(most_labelled // 2).select("doc_id").collect()
        out |= {r.doc_id: value for r in rows}
    pool = docs.select("doc_id").where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id", F.lit(1))).orderBy("h", "doc_id").limit(most_pool).select("doc_id").collect()
    n = known.agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")).collect()[0]
    good = sum(out.values())
    shift = float(np.log((n.good / n.bad) / (good / (len(out) - good)))) if 0 < good < len(out) else 0.0
    return out, [r.doc_id for r in pool if r.doc_id not in out], shift


def own_column(docs: DataFrame, name: str) -> F.Column:
    """A metadata column as the view reads it; a table without lengths gets those of its texts."""
    if name == "n_chars":
        return (F.col(name) if name in docs.columns else F.length("text")).cast("long")
    return F.col(name).cast("string")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", *(own_column(docs, c).alias(c) for c in ("lang", "source", "n_chars")))


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    text = np.array([text_features(t) for t in bytes_of(batch, "text")]).reshape(-1, len(TEXT_FEATURES))
    meta = np.array([meta_features(*x) for x in zip(*(batch.column(at(c)).to_pylist() for c in ("lang", "source", "n_chars")))]).reshape(-1, 10 + HASHED_SOURCES)
    return text, meta


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000, most_pool: int = 6000, **options) -> Model:
    """The model from bounded samples; their ids are broadcast, and only their statistics reach the driver."""
    known, pool, shift = sample_ids(labels, docs, most_labelled, most_pool)
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, y) for i, y in known.items()] + [(i, -1) for i in pool], "__id long, __y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _features(batch)
            both = [r.tobytes() for r in np.hstack([text, meta])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1), pa.array(both, pa.binary())], names=["id", "y", "x"])

    found = _columns(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("__id")).drop("__id").mapInArrow(run, "id long, y int, x binary").collect()
    order = hashlib.blake2b
    found.sort(key=lambda r: (order(str(r.id).encode(), digest_size=8).digest(), r.x))
    width = len(TEXT_FEATURES)
    x = np.array([np.frombuffer(r.x) for r in found]).reshape(len(found), width + 10 + HASHED_SOURCES)
    y = np.array([r.y for r in found], float)
    lab, un = y >= 0, y < 0
    model = co_train(x[lab, :width], x[lab, width:], y[lab], x[un, :width], x[un, width:], **options)
    if model.constant is None:
        model.both[-1] += shift  # the sample holds bad rows more often than the labels do
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_score, meta_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(*_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in scores)], names=["doc_id", "text_score", "meta_score", "score"])

    return _columns(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The scores of every row of ``docs`` and whether it is kept."""
    return score(docs, train(docs, labels, **options)).withColumn("keep", F.col("score") >= threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    columns = docs.columns
    own = {c: free_name(columns, f"__{c}") for c in ("lang", "source", "n_chars")}
    carried = docs.select(*(F.col(c) for c in columns), *(own_column(docs, c).alias(name) for c, name in own.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            text = np.array([text_features(t) for t in bytes_of(batch, "text")]).reshape(-1, len(TEXT_FEATURES))
            meta = np.array([meta_features(*x) for x in zip(*(batch.column(at(name)).to_pylist() for name in own.values()))]).reshape(-1, 10 + HASHED_SOURCES)
            keep = pa.array(shared.value.score(text, meta)[2] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], names=columns).filter(keep)

    return carried.mapInArrow(frugal(run), docs.schema)
