"""Nearest neighbours by cosine with a vantage-point tree for each shard.

Shards are runs of rows as Spark reads them, so the index is built without a shuffle. Trees work on unit vectors and their
straight distances, for which the triangle inequality holds: of a query at distance d from a vantage point, no row whose own
distance lies in [lo, hi] can be nearer than max(d - hi, lo - d). A branch is left out when that bound, times the factor, passes
the distance of the k-th best so far. Factor 1 leaves out only what can't matter, so it is the exact search; larger factors
leave out more. Queries travel in packed groups to every shard, and only their best rows of each shard come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_database, settle, trimmed
from .vectors import cell_of, first_per_key, ids_of, matrix, measure, unpack, whole_vectors

#: Bytes of vectors in a shard, and in a packed group of queries.
SHARD_BYTES, GROUP_BYTES = 2 << 20, 512 << 10
#: Rows in a leaf of a tree, at most.
LEAF = 128
#: Shards a partition may have, and rows in a shard, as powers of two; together a row's number.
SHARD_BITS, ROW_BITS = 20, 20
#: What rounding may do to a distance or a cosine; nothing is left out by less.
SLACK_DISTANCE, SLACK_COSINE = 1e-6, 1e-12
#: Pairs whose exact cosines are worked out at a time.
PAIRS = 1 << 15

NODES = np.dtype([("start", "i4"), ("end", "i4"), ("vantage", "i4"), ("left", "i4"), ("right", "i4"), ("left_lo", "f8"), ("left_hi", "f8"), ("right_lo", "f8"), ("right_hi", "f8")])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` and ``b``; each depends on its two vectors alone, so equal vectors get equal ones."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances between rows of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of unit vectors: rows in ``order`` lie leaf by leaf; node 0 is the root, and a leaf has no vantage (-1).

    The vantage point of a node is the row farthest from the node's first one. The half of the rows nearer to it goes left; each
    side keeps its least and largest distance, so equal distances on both sides do no harm.
    """
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), None)]
    while todo:
        start, end, parent = todo.pop()
        at = len(nodes)
        nodes.append([start, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
        if parent is not None:
            nodes[parent[0]][parent[1]] = at
        if end - start <= leaf:
            continue
        rows = order[start:end]
        vantage = rows[distances(x[rows[:1]], x[rows])[0].argmax()]
        d = distances(x[[vantage]], x[rows])[0]
        by = np.argsort(d, kind="stable")
        order[start:end], d, half = rows[by], d[by], (end - start) // 2
        nodes[at][2] = vantage
        nodes[at][5:] = [d[0], d[half - 1], d[half], d[-1]]
        todo += [(start, start + half, (at, 3)), (start + half, end, (at, 4))]
    made = np.array([tuple(n) for n in nodes], NODES)
    place = np.empty(len(x), np.int32)
    place[order] = np.arange(len(x), dtype=np.int32)
    inner = made["vantage"] >= 0
    made["vantage"][inner] = place[made["vantage"][inner]]
    return order, made


class Search:
    """The k nearest rows of one shard for a group of queries."""

    def __init__(self, rows: np.ndarray, nodes: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> None:
        """``own``: the place of each query's own row in this shard, or -1."""
        self.rows, self.nodes, self.queries, self.own, self.k, self.factor = unit(rows), nodes, unit(queries), own, k, factor
        self.best = np.full((len(queries), k), -np.inf)  # cosines so far, the smallest first
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.visited = 0

    def leaf(self, node: np.void, some: np.ndarray) -> None:
        start, end = int(node["start"]), int(node["end"])
        self.visited += (end - start) * len(some)
        near = self.queries[some] @ self.rows[start:end].T
        mine = np.flatnonzero((self.own[some] >= start) & (self.own[some] < end))
        near[mine, self.own[some][mine] - start] = -np.inf
        best = np.concatenate([self.best[some], near], axis=1)
        best.partition(best.shape[1] - self.k, axis=1)
        self.best[some] = np.sort(best[:, -self.k :], axis=1)
        i, j = np.nonzero((near >= self.best[some][:, :1] - SLACK_COSINE) & (near > -np.inf))
        self.found.append((some[i], j + start, near[i, j]))

    def first_leaves(self) -> np.ndarray:
        """Search the leaf that each query falls to, and say which it is."""
        where, todo = np.zeros(len(self.queries), np.int64), [(0, np.arange(len(self.queries)))]
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            if node["vantage"] < 0:
                where[some] = at
                self.leaf(node, some)
                continue
            d = distances(self.queries[some], self.rows[[node["vantage"]]])[:, 0]
            left = d <= (node["left_hi"] + node["right_lo"]) / 2
            todo += [(int(node[c]), some[m]) for c, m in (("left", left), ("right", ~left)) if m.any()]
        return where

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all rows that may be among a query's k nearest here, the k nearest surely if the factor is 1."""
        where, todo = self.first_leaves(), [(0, np.arange(len(self.queries)))]
        while todo:
            at, some = todo.pop()
            node = self.nodes[at]
            if node["vantage"] < 0:
                some = some[where[some] != at]
                if len(some):
                    self.leaf(node, some)
                continue
            d = distances(self.queries[some], self.rows[[node["vantage"]]])[:, 0]
            reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(self.best[some, 0], -1.0))) + SLACK_DISTANCE
            reach[self.best[some, 0] == -np.inf] = np.inf
            for side in ("right", "left"):
                bound = np.maximum(0.0, np.maximum(d - node[f"{side}_hi"], node[f"{side}_lo"] - d))
                go = self.factor * bound <= reach
                if go.any():
                    todo.append((int(node[side]), some[go]))
        q, place, near = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = near >= self.best[q, 0] - SLACK_COSINE
        return q[keep], place[keep]


SHARDS = "shard long, n int, ids binary, nulls binary, places binary, nodes binary, data binary"
QUERIES = "first long, n int, numbers binary, ids binary, nulls binary, data binary"
FOUND = "query_no long, query_id long, vec_id long, score double"


def _shards(dim: int, leaf: int):
    most = min(1 << ROW_BITS, max(1, SHARD_BYTES // (8 * dim)))

    def packed(shard: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        x = matrix(table.column("vec").combine_chunks(), dim)
        ids, nulls = ids_of(table.column("vec_id").combine_chunks())
        order, nodes = build_tree(unit(x), leaf)
        row = {"shard": shard, "n": len(x), "ids": ids[order].tobytes(), "nulls": nulls[order].tobytes(), "places": order.astype(np.int32).tobytes(), "nodes": nodes.tobytes(), "data": np.ascontiguousarray(x[order]).tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "nulls", "places", "nodes", "data")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n = TaskContext.get().partitionId() << SHARD_BITS, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - n)
                held, n, at = [*held, some], n + some.num_rows, at + some.num_rows
                if n == most:
                    yield packed(shard, held)
                    shard, held, n = shard + 1, [], 0
        if n:
            yield packed(shard, held)

    return run


def _groups(dim: int, every: int):
    """Queries of the shards, packed; a row's number is its shard's and its place in it."""
    most = max(1, GROUP_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            row = {"first": int(rows[0][0]), "n": len(rows), "numbers": np.array([r[0] for r in rows], np.int64).tobytes(), "ids": np.array([r[1] for r in rows], np.int64).tobytes(), "nulls": b"\0" * len(rows), "data": np.array([r[2] for r in rows]).tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("first", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("numbers", "ids", "nulls", "data")]]))

        for batch in batches:
            for row in batch.to_pylist():
                ids, nulls, x = unpack(row["ids"], np.int64), unpack(row["nulls"], np.uint8), unpack(row["data"], np.float64, dim)
                for i in np.flatnonzero((ids % every == 0) & (nulls == 0)):
                    held.append(((row["shard"] << ROW_BITS) + int(i), ids[i], x[i]))
                    if len(held) == most:
                        yield packed(held)
                        held = []
        if held:
            yield packed(held)

    return run


def _search(dim: int, k: int, factor: float):
    names = ["query_no", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("numbers", "q_ids", "q_data", "shard", "ids", "nulls", "nodes", "data")}
                numbers, q_ids, q = unpack(row["numbers"], np.int64), unpack(row["q_ids"], np.int64), unpack(row["q_data"], np.float64, dim)
                ids, nulls, x = unpack(row["ids"], np.int64), unpack(row["nulls"], np.uint8), unpack(row["data"], np.float64, dim)
                own = np.where(numbers >> ROW_BITS == row["shard"], numbers & ((1 << ROW_BITS) - 1), -1)
                i, j = Search(x, unpack(row["nodes"], NODES), q, own, k, factor).run()
                score = np.concatenate([np.zeros(0), *[cosines(q[i[s : s + PAIRS]], x[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]])
                by = np.lexsort((ids[j], nulls[j], -score, i))
                by = by[first_per_key(i[by], k)]
                i, j, score = i[by], j[by], score[by]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(q_ids[i]), pa.array(ids[j], mask=nulls[j] > 0), pa.array(score)], names)

    return run


def build_index(rows: DataFrame, dim: int, leaf: int = LEAF) -> DataFrame:
    """One row a shard: its tree and its vectors, leaf by leaf. ``rows(vec_id, vec)``."""
    return rows.mapInArrow(trimmed(_shards(dim, leaf)), SHARDS)


def nearest_neighbours(rows: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides, the ``k`` other rows of largest cosine.

    Nearest first, equal cosines by smaller vec_id, rows without vec_id last; fewer than ``k`` other rows give all of them.
    Scores are cosines of the vectors as given, in double precision. ``factor`` 1 searches exactly; above 1 branches are left
    out more readily and neighbours may be missed (at least 1).

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as candidate.
    Rows are told apart by where they stand, not by vec_id: repeated rows are candidates of each other, and each repeated
    query is answered. A table without queries or candidates gives no rows. Vectors of several lengths are an error. Only
    vec_id and embedding are read. The index lies in a database of its own in the shared folder until the result is written.
    """
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    spark = rows.sparkSession
    kept = whole_vectors(rows, label=False)
    _, dim, _ = measure(kept)
    kept = kept.where(F.exists("vec", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    home = scratch_database(spark)
    try:
        build_index(kept, dim, leaf).write.saveAsTable(f"{home}.shards")
        shards = spark.table(f"{home}.shards")
        groups = settle(shards.select("shard", "ids", "nulls", "data").mapInArrow(trimmed(_groups(dim, every)), QUERIES))
        cells = max(1, shards.count())
        asked = groups.select("numbers", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        pairs = asked.join(shards.drop("places").withColumn("cell", cell_of(F.col("shard"), cells)), "cell")
        found = pairs.mapInArrow(trimmed(_search(dim, k, factor)), FOUND)
        place = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
        return settle(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    finally:
        spark.sql(f"DROP DATABASE {home} CASCADE")
