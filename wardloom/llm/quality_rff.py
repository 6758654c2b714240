"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Random Fourier features approximate a Gaussian kernel over standardised statistics. The normal equations are summed
partition by partition over a bounded sample of labelled rows and solved once; the calibration uses labelled rows that
the regression did not see. Scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_column, settle, trimmed
from .textstats import N_QUALITY, quality_features
from .training import MAX_LABELLED, finish, isotonic, labelled_sample

PARTITIONS = 8
FEATURES = "doc_id long, y int, part int, x array<double>"


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [quality_features(t) for t in binary_column(b, "text")]
        yield pa.record_batch([b.column("doc_id"), b.column("y"), b.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])


class Fourier:
    """Standardisation and the random projection."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, width: int, gamma: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, N_QUALITY)


def _sums(phi: Fourier):
    """One row for each partition: its part of the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(phi.b) + 1
        a, v = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            z = phi(_matrix(b))
            a += z.T @ z
            v += z.T @ b.column("y").to_numpy().astype(float)
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["a", "v"])

    return run


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi, w, xs, ys = model.value
        for b in batches:
            if phi is None:
                score = np.full(b.num_rows, ys[0])
            else:
                x = np.array([quality_features(t) for t in binary_column(b, "text")], float).reshape(b.num_rows, N_QUALITY)
                score = np.interp(phi(x) @ w, xs, ys)
            yield pa.record_batch([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, width: int = 256, ridge: float = 1e-3, gamma: float = 0.02, seed: int = 5, max_labelled: int = MAX_LABELLED):
    """(projection, weights, calibration x, calibration y). Without labelled rows of both kinds: a constant score, the
    rate of label 1 (0.5 without any rows)."""
    table = settle(labelled_sample(docs, labels, "quality", mod, held, max_labelled).repartition(PARTITIONS).mapInArrow(_feature_rows, FEATURES))
    train, rest = table.where("part < 8"), table.where("part >= 8")
    moments = table.groupBy().agg({"y": "avg"}).first()[0]
    if table.select("y").distinct().count() < 2:
        return None, None, np.array([0.0]), np.array([0.5 if moments is None else float(moments)])
    x = np.array(train.select("x").toPandas()["x"].tolist(), float)  # bounded by max_labelled
    phi = Fourier(x.mean(0), x.std(0), width, gamma, seed)
    parts = train.mapInArrow(_sums(phi), "a binary, v binary").collect()  # one row for each of few partitions
    a = sum(np.frombuffer(r["a"]).reshape(width + 1, width + 1) for r in parts)
    v = sum(np.frombuffer(r["v"]) for r in parts)
    w = np.linalg.solve(a + ridge * np.trace(a) / (width + 1) * np.eye(width + 1), v)
    cal = rest.toPandas()
    raw = phi(np.array(cal["x"].tolist(), float).reshape(len(cal), N_QUALITY)) @ w if len(cal) else np.zeros(0)
    return phi, w, *isotonic(raw, cal["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, held: int = 0, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (chance of quality 1), predicted (score >= threshold).

    Null, empty and blank texts have all statistics 0 and are scored as such. Labels of documents whose crc32(doc_id)
    modulo ``mod`` is ``held`` are never used. Repeated rows are scored alike; ties in the score stay ties; very
    long texts are read whole. Only doc_id
    and text are read of ``docs``. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, held, **options))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return finish(texts.mapInArrow(trimmed(_score_rows(model)), "doc_id long, score double"), mod, held, threshold)
