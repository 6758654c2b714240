"""What the vector operators share: rows with whole finite vectors, their integers, and packed matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: A float64 holds every integer below this bound exactly.
EXACT = 2.0**53
#: Integers of scores, distances and thresholds stay below this bound, so that int64 holds them and their comparisons.
WHOLE = 2.0**62


def whole_vectors(rows: DataFrame, label: bool = True) -> DataFrame:
    """(vec_id, label, vec) of the rows whose vector is neither null nor empty and has no null or non-finite component.

    vec is an array of doubles. Other columns are left behind, whatever their names.
    """
    wanted = ("vec_id", "embedding", "label") if label else ("vec_id", "embedding")
    plain, names = numbered(rows, *wanted)
    vec = F.col(names[1]).cast("array<double>")
    fine = F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(vec) > 0)
    columns = [F.col(names[0]).cast("long").alias("vec_id"), vec.alias("vec")]
    if label:
        columns.insert(1, F.col(names[2]).cast("long").alias("label"))
    return plain.where(fine).select(*columns)


def measure(kept: DataFrame) -> tuple[int, int, float]:
    """Number of rows, length of their vectors and largest absolute component; vectors of several lengths are an error."""
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    n, least, most, top = kept.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec")), F.max(largest)).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components; all must have one length")
    return n, least or 0, top or 0.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of lists, all of ``dim`` doubles, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64."""
    return np.floor(scale * x).astype(np.int64)


def width_for(top: float) -> np.dtype:
    """The narrowest integer type for values up to ``top`` either way."""
    return next((np.dtype(t) for t in (np.int16, np.int32) if top < np.iinfo(t).max), np.dtype(np.int64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for integers, exact: by float64 where every partial sum stays below 2^53, else in int64."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top >= WHOLE:
        raise ArithmeticError("components are too large: their inner products pass 64-bit integers")
    return a.astype(np.int64) @ b.astype(np.int64).T


def unpack(data: bytes, dtype: np.dtype | type, dim: int | None = None) -> np.ndarray:
    got = np.frombuffer(data, dtype)
    return got if dim is None else got.reshape(-1, dim)


def first_per_key(key: np.ndarray, n: int) -> np.ndarray:
    """Which entries are among the first ``n`` of their key, for sorted keys."""
    if not len(key):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key)))) < n


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids with 0 for nulls, and which are null (1)."""
    gone = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), gone.astype(np.uint8)


def cell_of(column: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(cells)).cast("int")
