"""Hard negatives from blocks of vectors along a Hilbert curve.

Rows are ordered by label and by their place on a Hilbert curve through all dimensions, and written as Parquet blocks of one
label, each with the least and largest value of every dimension (its zone map). Interval arithmetic over a zone map bounds the
inner product of an anchor with any row of the block, so an anchor reads only blocks whose bounds meet one of its windows of
scores. Positives come first: the anchor's own block gives the score that they must reach. Each positive's score then makes a
window for negatives. Zone maps are read without the vectors, and a block meets only the anchors that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_database, settle, trimmed
from .vectors import WHOLE, cell_of, first_per_key, floors, ids_of, matrix, measure, products, unpack, whole_vectors, width_for

#: Rows in a block, blocks whose zone maps travel together, and anchors that do.
BLOCK, CHUNK, GROUP = 512, 1024, 512
#: Rows a task sorts into blocks, about.
SORTED = 8192
#: Bits of each dimension in the order.
CURVE_BITS = 4
#: Blocks a partition may have, as a power of two.
PART_BITS = 24
#: Bounds of a window that is open on one side.
LOWEST, HIGHEST = -int(WHOLE), int(WHOLE)


def curve_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of rows of unsigned integers below 2^bits, as bytes of equal length that sort in its order.

    Skilling's transform: undo the rotations from the highest bit down, then Gray-decode across dimensions.
    """
    axes = x.T.astype(np.uint32)
    for bit in range(bits - 1, 0, -1):
        lower = np.uint32((1 << bit) - 1)
        for axis in axes:
            high = (axis >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(high, np.uint32(0), (axes[0] ^ axis) & lower)
            axes[0] ^= np.where(high, lower, swap)
            axis ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    axes ^= turn
    planes = np.concatenate([(axes >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T.astype(np.uint8), axis=1)]


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest inner product of each row of ``q`` with anything between ``low`` and ``high`` (blocks x dims)."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


def best_in_windows(scores: np.ndarray, order: tuple[np.ndarray, ...], windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, row) of the ``k`` best rows in each window; ``order`` settles ties, its last key first."""
    found = []
    for w in range(windows.shape[1]):
        q, row = np.nonzero((scores >= windows[:, w, :1]) & (scores <= windows[:, w, 1:]))
        by = np.lexsort((*[o[row] for o in order], -scores[q, row], q))
        by = by[first_per_key(q[by], k)]
        found.append((q[by], np.full(len(by), w), row[by]))
    q, w, row = (np.concatenate(c) for c in zip(*found, strict=True))
    return q, w, row


def _encode(dim: int, scale: int, top: int, dtype: np.dtype):
    """Integer vectors as bytes, with their place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floors(matrix(batch.column("vec"), dim), scale)
            keys = curve_keys(((x + top).astype(np.float64) * ((1 << CURVE_BITS) / (2 * top + 1))).astype(np.int64), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())], ["vec_id", "label", "key", "data"])

    return run


BLOCKS = "block long, label long, n int, low binary, high binary, ids binary, nulls binary, data binary"


def _blocks(dim: int, dtype: np.dtype):
    fields = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("low", "high", "ids", "nulls", "data")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, label, held = TaskContext.get().partitionId() << PART_BITS, None, []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, nulls = ids_of(table.column("vec_id").combine_chunks())
            x = unpack(b"".join(table.column("data").to_pylist()), dtype, dim)
            row = {"block": block, "label": label, "n": len(x), "low": x.min(axis=0).tobytes(), "high": x.max(axis=0).tobytes(), "ids": ids.tobytes(), "nulls": nulls.tobytes(), "data": x.tobytes()}
            return pa.RecordBatch.from_pylist([row], fields)

        n = 0
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                at = int(start)
                while at < end:
                    if n and (n == BLOCK or labels[at] != label):
                        yield packed()
                        block, held, n = block + 1, [], 0
                    label, take = int(labels[at]), min(int(end) - at, BLOCK - n)
                    held, n, at = [*held, batch.slice(at, take)], n + take, at + take
        if n:
            yield packed()

    return run


ANCHORS = "anchor long, anchor_id long, label long, data binary, windows array<long>"


def _anchors(dim: int, dtype: np.dtype, every: int, k: int):
    """Anchors of each block, each with the window that its own block leaves for positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls, x = unpack(row["ids"], np.int64), unpack(row["nulls"], np.uint8), unpack(row["data"], dtype, dim)
                own = np.flatnonzero((ids % every == 0) & (nulls == 0))
                if not len(own):
                    continue
                least = np.full(len(own), LOWEST)
                if len(x) > k:
                    scores = products(x[own], x)
                    scores[np.arange(len(own)), own] = LOWEST
                    least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
                rows = [{"anchor": row["block"] * BLOCK + int(i), "anchor_id": int(ids[i]), "label": row["label"], "data": x[i].tobytes(), "windows": [int(lo), HIGHEST]} for i, lo in zip(own, least, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("data", pa.binary()), ("windows", pa.list_(pa.int64()))]))

    return run


GROUPS = "anchors binary, labels binary, widths binary, windows binary, vectors binary"


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors packed; windows of all in a row, ``widths`` saying how many each has."""
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            rows = batch.slice(at, GROUP).to_pylist()
            own = {"anchors": [r["anchor"] for r in rows], "labels": [r["label"] for r in rows], "widths": [len(r["windows"]) // 2 for r in rows], "windows": [w for r in rows for w in r["windows"]]}
            packed = {c: np.array(v, np.int64).tobytes() for c, v in own.items()} | {"vectors": b"".join(r["data"] for r in rows)}
            yield pa.RecordBatch.from_pylist([packed], pa.schema([(c, pa.binary()) for c in packed]))


def _windows(row: dict) -> np.ndarray:
    """(anchors, most windows, 2); what an anchor lacks is an empty window."""
    widths, flat = unpack(row["widths"], np.int64), unpack(row["windows"], np.int64, 2)
    out = np.tile(np.array([HIGHEST, LOWEST]), (len(widths), int(widths.max(initial=0)), 1))
    out[np.arange(out.shape[1])[None, :] < widths[:, None]] = flat
    return out


ZONES = "first long, blocks binary, block_labels binary, lows binary, highs binary"


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            whole = lambda c: some.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()  # noqa: B023, E731
            row = {"first": some.column("block")[0].as_py(), "blocks": whole("block"), "block_labels": whole("label"), "lows": b"".join(some.column("low").to_pylist()), "highs": b"".join(some.column("high").to_pylist())}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("first", pa.int64()), *[(c, pa.binary()) for c in row if c != "first"]]))


def _choose(dim: int, dtype: np.dtype, same: bool):
    """The blocks that each group must read, each with those of its anchors that need it."""
    fields = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("anchors", "widths", "windows", "vectors")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q, labels, anchors, widths = unpack(row["vectors"], dtype, dim), unpack(row["labels"], np.int64), unpack(row["anchors"], np.int64), unpack(row["widths"], np.int64)
                blocks, block_labels = unpack(row["blocks"], np.int64), unpack(row["block_labels"], np.int64)
                low, high = bounds(q.astype(np.int64), unpack(row["lows"], dtype, dim), unpack(row["highs"], dtype, dim))
                windows = _windows(row)
                need = np.zeros(low.shape, bool)
                for w in range(windows.shape[1]):
                    need |= (high >= windows[:, w, :1]) & (low <= windows[:, w, 1:]) & (windows[:, w, :1] <= windows[:, w, 1:])
                need &= (labels[:, None] == block_labels[None, :]) == same
                flat, ends = unpack(row["windows"], np.int64, 2), np.cumsum(widths)
                out = []
                for b in np.flatnonzero(need.any(axis=0)):
                    some = np.flatnonzero(need[:, b])
                    own = np.concatenate([flat[ends[i] - widths[i] : ends[i]] for i in some])
                    out.append({"block": int(blocks[b]), "anchors": anchors[some].tobytes(), "widths": widths[some].tobytes(), "windows": own.tobytes(), "vectors": q[some].tobytes()})
                yield pa.RecordBatch.from_pylist(out, fields)

    return run


FOUND = "anchor long, at_most long, vec_id long, score long"


def _read(dim: int, dtype: np.dtype, k: int):
    """The best rows of a block in each window of the anchors that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                anchors, q, windows = unpack(row["anchors"], np.int64), unpack(row["vectors"], dtype, dim), _windows(row)
                ids, nulls, x = unpack(row["ids"], np.int64), unpack(row["nulls"], np.uint8), unpack(row["data"], dtype, dim)
                scores = products(q, x)
                own = np.flatnonzero(anchors // BLOCK == row["block"])
                scores[own, anchors[own] % BLOCK] = LOWEST - 1  # below every window
                i, w, j = best_in_windows(scores, (ids, nulls), windows, k)
                yield pa.RecordBatch.from_arrays([pa.array(anchors[i]), pa.array(windows[i, w, 1]), pa.array(ids[j], mask=nulls[j] > 0), pa.array(scores[i, j])], ["anchor", "at_most", "vec_id", "score"])

    return run


class Blocks:
    """The blocks of a table of vectors, and searches over them."""

    def __init__(self, rows: DataFrame, home: str, dim: int, top: float, scale: int, n: int) -> None:
        """``rows(vec_id, label, vec)``; the blocks are written as the table ``blocks`` of the database ``home``."""
        most = int(np.floor(scale * top)) + 1
        self.dim, self.dtype, self.spark = dim, width_for(most), rows.sparkSession
        coded = rows.mapInArrow(_encode(dim, scale, most, self.dtype), "vec_id long, label long, key binary, data binary")
        order = ["label", "key", F.xxhash64("vec_id"), "_row"]  # equal vectors are dealt out by the last two
        coded = coded.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // SORTED)), *order).sortWithinPartitions(*order)
        coded.select("vec_id", "label", "data").mapInArrow(trimmed(_blocks(dim, self.dtype)), BLOCKS).write.saveAsTable(f"{home}.blocks")
        self.blocks = self.spark.table(f"{home}.blocks")
        self.cells = max(1, -(-self.blocks.count() // CHUNK))

    def anchors(self, every: int, k: int) -> DataFrame:
        return settle(self.blocks.select("block", "label", "ids", "nulls", "data").mapInArrow(trimmed(_anchors(self.dim, self.dtype, every, k)), ANCHORS))

    def chosen(self, anchors: DataFrame, same: bool) -> DataFrame:
        """(block, anchors, widths, windows, vectors): what each block must be read for."""
        groups = anchors.select("anchor", "label", "data", "windows").repartitionByRange(max(1, -(-anchors.count() // GROUP)), "anchor").mapInArrow(_group, GROUPS)
        groups = groups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))))
        zones = self.blocks.select("block", "label", "low", "high").mapInArrow(_zones, ZONES).withColumn("cell", cell_of(F.col("first"), self.cells))
        return groups.join(zones, "cell").mapInArrow(_choose(self.dim, self.dtype, same), "block long, anchors binary, widths binary, windows binary, vectors binary")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, at_most, vec_id, score, rank): the ``k`` best rows of the same label, or of others, in each window."""
        met = self.chosen(anchors, same).join(self.blocks.select("block", "ids", "nulls", "data"), "block")
        found = met.mapInArrow(trimmed(_read(self.dim, self.dtype, k)), FOUND)
        place = F.row_number().over(Window.partitionBy("anchor", "at_most").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
        return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, least_pct: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows(vec_id, label, embedding)``.

    Anchors are the rows whose vec_id ``every`` divides. Components become floor(scale * x), and a row's score is its integer
    inner product with the anchor; higher ones come first, ties by smaller vec_id, rows without vec_id last. For each of an
    anchor's first ``positives`` other rows of its label come the first ``negatives`` rows of other labels whose score is at most
    the positive's and at least ``least_pct`` percent of it; a positive without any gives no row.

    Rows with a null label, or a vector that is null, empty or holds null or non-finite components take no part. Rows are told
    apart by where they stand, not by vec_id, so repeated rows are positives of each other and each repeated anchor is answered.
    A table without anchors gives no rows. Vectors of several lengths are an error, and so are components whose scores would
    pass 64-bit integers. Other columns are not read. The blocks lie in a database of their own in the shared folder until
    the result is written.
    """
    spark = rows.sparkSession
    kept = whole_vectors(rows).where(F.col("label").isNotNull())
    n, dim, top = measure(kept)
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if 100.0 * dim * (scale * top + 1) ** 2 >= WHOLE:
        raise ArithmeticError("components are too large: their scores pass 64-bit integers")
    home = scratch_database(spark)
    try:
        blocks = Blocks(kept, home, dim, top, scale, n)
        anchors = blocks.anchors(every, positives)
        near = settle(blocks.search(anchors, True, positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        least = F.expr(f"({least_pct} * positive_score + pmod(-{least_pct} * positive_score, 100)) div 100")  # rounded up
        windows = near.where("positive_score >= 0").groupBy(F.col("anchor").alias("_anchor")).agg(F.flatten(F.collect_set(F.array(least, F.col("positive_score")))).alias("windows"))
        asking = settle(anchors.drop("windows").join(windows, F.col("anchor") == F.col("_anchor")).drop("_anchor"))
        far = blocks.search(asking, False, negatives).select(F.col("anchor").alias("_anchor"), F.col("at_most"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        named = near.join(anchors.select(F.col("anchor").alias("_a"), "anchor_id"), F.col("anchor") == F.col("_a"))
        out = named.join(far, (F.col("anchor") == F.col("_anchor")) & (F.col("positive_score") == F.col("at_most")))
        return settle(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    finally:
        spark.sql(f"DROP DATABASE {home} CASCADE")
