"""Labelled documents as feature rows: all of them as a DataFrame, or a bounded sample on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import bounded_sample, map_texts

FOLDS = 5


def fold(doc_id: Column | str) -> Column:
    """0 to 4 by the CRC of the id's text; a null id is in fold 0, which nothing is learnt from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % FOLDS, F.lit(0))


def training(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows outside fold 0 that are labelled 0 or 1, an id once."""
    return labels.select("doc_id", F.col(label).cast("double").alias("label")).where(
        "label in (0, 1) and doc_id is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("label").alias("label"))


def feature_rows(docs: DataFrame, known: DataFrame, features: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """(doc_id, label, features) of all documents in ``known``, features compressed; an id that several documents have
    counts once.

    No text is shuffled: every document that may be in ``known`` becomes features first, which take less room.
    """
    rows = map_texts(docs.where(fold("doc_id") != 0), "features binary", lambda t: {
        "features": pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in features(t).astype(np.float32)], pa.binary())})
    return rows.groupBy("doc_id").agg(F.min("features").alias("features")).join(known, "doc_id").select("doc_id", "label", "features")


def unpacked(features: pa.ChunkedArray, width: int) -> np.ndarray:
    """The compressed feature rows as one array."""
    x = np.zeros((len(features), width), np.float32)
    for i, value in enumerate(features):
        x[i] = np.frombuffer(pa.decompress(value.as_buffer(), 4 * width, "zstd"), np.float32)
    return x


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[list[bytes]], np.ndarray],
           bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels (0, 1) and ids of at most ``bound`` labelled documents outside fold 0, in order of id.

    The rows are those with the smallest hash of their id, so a run on the same
    tables has the same ones. Only their texts are read into features; an id
    that several documents have counts once.
    """
    chosen = bounded_sample(training(labels, label), "doc_id", bound)
    # At most ``bound`` rows of an id and a number.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = map_texts(texts, "features binary", lambda t: {
        "features": pa.array([x.tobytes() for x in features(t).astype(np.float32)], pa.binary())}, keep=("doc_id", "label"))
    got = rows.groupBy("doc_id", "label").agg(F.min("features").alias("features")).toArrow().sort_by("doc_id")
    raw = got.column("features")
    # Row by row into one array: the driver holds the features once more, and no second copy of them.
    x = np.zeros((len(raw), len(raw[0].as_buffer()) // 4 if len(raw) else 0), np.float32)
    for i, value in enumerate(raw):
        x[i] = np.frombuffer(value.as_buffer(), np.float32)
    return x, got.column("label").to_numpy().astype(float), got.column("doc_id").to_numpy()


def scaling(x: np.ndarray) -> np.ndarray:
    """A factor for each feature that gives it a root mean square near 1; rare ones are not blown up."""
    size = np.sqrt(np.mean(np.square(x), axis=0, dtype=np.float64))
    return (1.0 / np.maximum(size, 1e-3 * max(float(size.max(initial=0)), 1e-9) + 1e-6)).astype(np.float32)


def descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; the same numbers in every run."""
    w, m, v = (np.zeros(size) for _ in range(3))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(score: np.ndarray, label: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of P(label 1 | score), by Newton steps, with targets drawn in from 0 and 1 by the class counts;
    ``weight``: how often each row counts."""
    weight = np.ones(len(score)) if weight is None else weight
    pos, neg = float((label * weight).sum()), float(((1 - label) * weight).sum())
    goal = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    middle = float((score * weight).sum() / weight.sum())
    spread = float(np.sqrt((weight * (score - middle) ** 2).sum() / weight.sum())) or 1.0
    x = np.column_stack([(score - middle) / spread, np.ones(len(score))])
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - goal)) + 1e-6 * w)
        w -= np.clip(step, -5, 5)
    slope = max(w[0], 1e-6) / spread
    return slope, float(w[1] - slope * middle)
