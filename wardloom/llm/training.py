"""What the trained operators share: labelled samples, folds, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, settle

#: Labelled rows that a model is fitted on, at most; chosen by a hash of their ids, then of ids and texts.
MAX_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y, part, text) of labelled documents whose crc32(doc_id) modulo ``mod`` is not ``held``; ``max_rows`` rows at most.

    Rows without doc_id or label are left out; of several labels of a document the largest counts. Rows that repeat an id and
    its text are one row, however many they are; an id with several texts has a row for each. ``part`` is 0 to 9.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(crc_mod("doc_id", mod) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    ids = settle(known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mine = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).withColumn("h", F.xxhash64("text"))
    pairs = mine.groupBy("doc_id", "h").agg(F.max("y").alias("y"), F.count("*").alias("n"))
    take = settle(pairs.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_rows).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "n"))
    rows = mine.join(F.broadcast(take), (F.col("doc_id") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left_semi")
    if take.where("n > 1").limit(1).count():  # texts are shuffled only where some are to be thrown together
        rows = rows.groupBy("doc_id", "h").agg(F.max("y").alias("y"), F.first("text").alias("text"))
    return rows.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).cast("int").alias("part"), "text")


def isotonic(x: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising scores x and their non-decreasing rates, for linear interpolation.

    Ties in x are pooled first. Each pool's rate is drawn towards the overall rate by ``smooth`` rows, so that none is
    exactly 0 or 1. No rows give the constant 0.5.
    """
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    at, first = np.unique(x[order], return_index=True)
    sums, counts = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(x))).astype(float)
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, s, c in zip(at, sums, counts, strict=True):
        pools.append([s, c, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, last = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += c2
            pools[-1][3] = last
    rate = y.mean()
    xs, ys = [], []
    for s, c, a, z in pools:
        p = (s + smooth * rate) / (c + smooth)
        xs += [a, z] if z > a else [a]
        ys += [p, p] if z > a else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def finish(scored: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
