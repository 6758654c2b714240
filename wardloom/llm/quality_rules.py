"""Quality rules: exact counts and a hashed n-gram logistic regression.

Words, word pairs and runs of four bytes are hashed to ``BUCKETS`` weights each. The model is trained by AdaGrad in each of
``GROUPS`` parts of a bounded labelled sample, in the order of doc_ids; the parts' weights are averaged between rounds, so
that reruns agree. A logistic calibration on
labelled rows that the training did not see turns its score into a probability, which is held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, binary_column, hash_words, settle, trimmed, windows
from .textstats import base_counts
from .training import MAX_LABELLED, labelled_sample

BUCKETS = 1 << 17
FAMILIES = 3
GROUPS = 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _buckets(h: np.ndarray, family: int) -> np.ndarray:
    return (((h * MIX) >> np.uint64(64 - 17)) + np.uint64(family * BUCKETS)).astype(np.int64)


def features(text: bytes | None) -> list[np.ndarray]:
    """Bucket numbers of the words, word pairs and byte runs of a text (a number for each occurrence)."""
    if not text:
        return [np.empty(0, np.int64)] * FAMILIES
    h = hash_words(text.lower().split())
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    runs = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24) if len(raw) > 3 else np.empty(0, np.uint64)
    return [_buckets(h, 0), _buckets(windows(h, 2), 1) if len(h) > 1 else np.empty(0, np.int64), _buckets(runs * MIX + np.uint64(1), 2)]


def logit(parts: list[np.ndarray], w: np.ndarray) -> float:
    """The mean weight of each family, summed, and the intercept (the last weight)."""
    return float(w[-1] + sum(w[p].mean() for p in parts if len(p)))


def _train(start, epochs: int, rate: float, l2: float):
    """The weights of one part of the sample, and its number of rows."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("g")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()
        rows = []
        for b in table.to_batches():
            for y, text in zip(b.column("y").to_pylist(), binary_column(b, "text"), strict=True):
                ids, weight = [], []
                for p in features(text):
                    if len(p):
                        u, c = np.unique(p, return_counts=True)
                        ids.append(u)
                        weight.append(c / len(p))
                rows.append((y, np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(weight) if ids else np.empty(0)))
        w = start.value.astype(np.float64)
        squares = np.full(len(w), 1e-6)
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                y, ids, x = rows[i]
                miss = 1 / (1 + np.exp(-np.clip(w[-1] + w[ids] @ x, -30, 30))) - y
                g = miss * x + l2 * w[ids] * x
                squares[ids] += g * g
                w[ids] -= rate * g / np.sqrt(squares[ids])
                squares[-1] += miss * miss
                w[-1] -= rate * miss / np.sqrt(squares[-1])
        return pa.table({"g": pa.array([part], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    return run


def _raw_rows(w):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("y"), pa.array([logit(features(t), w.value) for t in binary_column(b, "text")], pa.float64())], names=["y", "raw"])

    return run


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration, with smoothed targets; the slope is not negative."""
    if not len(raw):
        return 1.0, 0.0
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([raw, np.ones(len(raw))])
    ab = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        ab = ab - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(ab[0])), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = 2, epochs: int = 3, rate: float = 2.0, l2: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """(weights, slope, intercept). Without labelled rows of both kinds everything passes."""
    sc = docs.sparkSession.sparkContext
    table = settle(labelled_sample(docs, labels, "quality", 1, -1, max_labelled).select("y", "part", "doc_id", F.xxhash64("text").alias("h"), "text"))
    w = np.zeros(FAMILIES * BUCKETS + 1, np.float32)
    if table.select("y").distinct().count() < 2:
        return w, 0.0, 30.0
    train = table.where("part < 8").select((F.col("part") % GROUPS).alias("g"), "y", "doc_id", "h", "text")
    for _ in range(rounds):
        got = sorted(train.groupBy("g").applyInArrow(_train(sc.broadcast(w), epochs, rate, l2), "g int, n long, w binary").collect())  # a row for each of few parts
        if got:
            w = sum(np.frombuffer(r["w"], np.float32) * (r["n"] / sum(r["n"] for r in got)) for r in got).astype(np.float32)
    cal = table.where("part >= 8").select("y", "text").mapInArrow(_raw_rows(sc.broadcast(w)), "y int, raw double").toPandas().sort_values(["raw", "y"])
    return w, *platt(cal["raw"].to_numpy(float), cal["y"].to_numpy(float))


def _apply(model):
    names = ["doc_id", *COUNTS, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, slope, intercept = model.value
        for b in batches:
            rows = [(*base_counts(t), logit(features(t), w)) for t in binary_column(b, "text")]
            *counts, raw = list(zip(*rows, strict=True)) or [()] * (len(COUNTS) + 1)
            raw = np.array(raw, float)
            score = 1 / (1 + np.exp(-np.clip(slope * raw + intercept, -30, 30)))
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(score)], names=names)

    return run


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed and
    the model's probability of quality 1 is at least ``threshold``. Null, empty and blank texts have no words and fail.
    Repeated rows are judged alike, a score at the threshold is kept, very long texts are read whole. Only doc_id and text are read of ``docs``. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = texts.mapInArrow(trimmed(_apply(model)), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
