"""Compression of vectors into short codes, in exact integers.

A vector's components become integers and are cut into parts; each part is named by the nearest entry of a codebook of its
position. Codebooks are refined in rounds: partitions sum the parts that fall to each entry, Spark adds the sums up, and the
few entries (``entries`` x vector length integers) come back to the driver and go out again with the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import EXACT, WHOLE, floors, ids_of, matrix, measure, whole_vectors

#: Labels up to this number (16 bytes each) are broadcast with their sums; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows worked on at a time.
STEP = 4096


def limb_bits(dim: int) -> int:
    """Bits of a limb, so that the sum of ``dim`` products of two limbs stays below 2^53."""
    bits = 1
    while dim * float(2 ** (2 * (bits + 1))) < EXACT:
        bits += 1
    return bits


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices l0, l1, ... with x = l0 + 2^bits * l1 + ...; all but the last lie in [0, 2^bits)."""
    out = []
    while True:
        if np.abs(x).max(initial=0) < 2**bits:
            return [*out, x.astype(np.float64)]
        low = x & (2**bits - 1)
        out.append(low.astype(np.float64))
        x = (x - low) >> bits


def limb_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: float64 products of limbs, put together again in int64."""
    bits = bits or limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of ``book`` for each row of ``parts``, and its squared distance, in exact integers."""
    squares = lambda x: (x * x).sum(axis=1)
    apart = squares(parts)[:, None] - 2 * limb_products(parts, book) + squares(book)[None, :]
    best = apart.argmin(axis=1)  # the first of equal ones
    return best, apart[np.arange(len(parts)), best]


def _sums(books: list[np.ndarray], dim: int, scale: int):
    """Partition sums (part, entry, n, sums) of the parts that fall to each entry."""
    wide = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), wide), np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = floors(matrix(batch.column("vec").slice(at, STEP), dim), scale)
                for p, book in enumerate(books):
                    part = x[:, p * wide : (p + 1) * wide]
                    np.add.at(total[p], best := nearest(part, book)[0], part)
                    count[p] += np.bincount(best, minlength=len(book))
        rows = [(p, e, int(count[p][e]), total[p][e].tolist()) for p in range(len(books)) for e in range(len(books[p])) if count[p][e]]
        yield pa.RecordBatch.from_pylist([{"part": p, "entry": e, "n": n, "sums": s} for p, e, n, s in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def _codes(books: list[np.ndarray], dim: int, scale: int):
    wide = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                x = floors(matrix(some.column("vec"), dim), scale)
                found = [nearest(x[:, p * wide : (p + 1) * wide], book) for p, book in enumerate(books)]
                codes = np.column_stack([best for best, _ in found]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(error for _, error in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def learn_codebooks(kept: DataFrame, dim: int, scale: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """One matrix of entries for each part position, after so many rounds over all rows of ``kept``."""
    first = kept.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    start = floors(np.array([r["vec"] for r in first], float).reshape(-1, dim), scale)
    wide = dim // parts
    books = [start[:, p * wide : (p + 1) * wide].copy() for p in range(parts)]
    for _ in range(rounds):
        got = kept.select("vec").mapInArrow(_sums(books, dim, scale), "part int, entry int, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(wide)]
        for row in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(wide)]
    return books


def encode_vectors(rows: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``rows(vec_id, embedding, label)``.

    Components become floor(scale * x). Codebooks start as the parts of the rows with the smallest vec_ids (null ids last; of
    equal ids the smaller vector first) and are refined ``rounds`` times over all rows; a code names two hex digits a part.
    error is the sum of squared distances; label_error its sum over rows of the same label, null labels being one.

    Rows whose vector is null, empty or holds null or non-finite components take no part. Repeated rows and rows without
    vec_id are coded like others. Fewer rows than ``entries`` give fewer entries. Equal distances go to the lower index. No
    rows give none. Vectors of several lengths, or of a length that ``parts`` doesn't divide, are an error, and so are
    components whose distances would pass 64-bit integers (about 2^28 for 8 components a part, after scaling).
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part, so entries must be from 1 to 256")
    kept = whole_vectors(rows)
    _, dim, top = measure(kept)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    if (2 * (scale * top + 1)) ** 2 * dim >= WHOLE:
        raise ArithmeticError("components are too large: their squared distances pass 64-bit integers")
    books = learn_codebooks(kept, dim, scale, parts, entries, rounds) if dim else []
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()
    coded = settle(kept.mapInArrow(_codes(books, dim, scale), "vec_id long, label long, code string, error long")) if dim else kept.selectExpr("vec_id", "label", "'' AS code", "0L AS error")
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    small = sums.count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
