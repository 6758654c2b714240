"""Sharding by a minimax contiguous partition of atomic groups.

All rows with the same text form one group, which no cut divides. Groups are ordered by a 64-bit hash of their text; a
shard is a range of that order. The smallest feasible shard capacity is found by binary search with a greedy check,
and the cuts are made at that capacity. Only DataFrame operations touch rows; the driver sees sums of hash ranges:

* The first pass sums sizes over ranges of the order (at most ``2 ** FIRST_BITS``).
* Treating ranges as atoms bounds the capacity from above, treating them as divisible bounds it from below. Only ranges
  in which a cut can still fall are summed again, ``STEP_BITS`` finer, until both bounds meet. Then the capacity is the
  optimum over single groups, though the driver never held more than the ranges near the cuts.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, settle

FIRST_BITS, STEP_BITS = 16, 6
#: Bytes that each row costs besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Atom:
    """A range of the group order: its first hash, the sum of sizes, whether it is one group, the bits it spans."""

    first: int
    size: int
    single: bool
    bits: int
    bin: int


def _cut(bounds: list[int], atoms: list[Atom], start: int, capacity: int, fluid: bool) -> int:
    """The furthest position within capacity of ``start``; in fluid form a range of several groups may be divided."""
    i = bisect_right(bounds, start + capacity) - 1
    if i >= len(atoms):
        return bounds[-1]
    return start + capacity if fluid and not atoms[i].single else bounds[i]


def greedy_cuts(bounds: list[int], atoms: list[Atom], shards: int, capacity: int, fluid: bool = False, start: int = 0) -> list[int] | None:
    """The positions at which filling each shard as far as it goes cuts; None if the capacity is too small."""
    cuts = []
    for _ in range(shards):
        if start >= bounds[-1]:
            return cuts
        end = _cut(bounds, atoms, start, capacity, fluid)
        if end <= start:
            return None
        cuts.append(start := end)
    return cuts if start >= bounds[-1] else None


def smallest_capacity(bounds: list[int], atoms: list[Atom], shards: int, fluid: bool = False) -> int:
    low, high = -(-bounds[-1] // shards), bounds[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(bounds, atoms, shards, middle, fluid) is None:
            low = middle + 1
        else:
            high = middle
    return high


def _bounds(atoms: list[Atom]) -> list[int]:
    out = [0]
    for a in atoms:
        out.append(out[-1] + a.size)
    return out


def balanced_cuts(bounds: list[int], atoms: list[Atom], shards: int, capacity: int) -> list[int]:
    """Indices of the atoms at which shards 1.. begin: no shard over capacity, each as near as may be to an even share
    of what is left. A cut that would leave more than the remaining shards can hold is moved on."""
    starts, at = [], 0
    for left in range(shards, 1, -1):
        share = (bounds[-1] - bounds[at]) / left
        i = bisect_right(bounds, bounds[at] + share) - 1
        if i + 1 < len(bounds) and abs(bounds[i + 1] - bounds[at] - share) < abs(bounds[i] - bounds[at] - share):
            i += 1
        furthest = bisect_right(bounds, bounds[at] + capacity) - 1
        i = min(max(i, at + 1), furthest) if at < len(atoms) else at
        while i < furthest and greedy_cuts(bounds, atoms, left - 1, capacity, start=bounds[i]) is None:
            i += 1
        starts.append(i)
        at = i
    return starts


def _ranges(rows: DataFrame, bits: int) -> list[Atom]:
    got = rows.groupBy(F.shiftright("h", bits).alias("bin")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b")).orderBy("bin").toLocalIterator()
    return [Atom(r["a"], r["size"], r["a"] == r["b"], bits, r["bin"]) for r in got]


def find_cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """The hashes at which shards 1.. begin, and the smallest feasible capacity, for ``rows(h long, size long)``.

    Ties (equal hashes) are one group. No rows give no cuts and capacity 0. With fewer groups than shards some shards
    stay empty.
    """
    atoms = _ranges(rows, 64 - FIRST_BITS)
    if not atoms:
        return [], 0
    while True:
        bounds = _bounds(atoms)
        high, low = smallest_capacity(bounds, atoms, shards), smallest_capacity(bounds, atoms, shards, fluid=True)
        if low == high:
            break
        # the k-th cut lies between what the atoms allow at the lower capacity and what divisible ranges allow at the upper one
        upper = greedy_cuts(bounds, atoms, shards, high, fluid=True)
        lower, at = [], 0
        for _ in range(shards):
            lower.append(at := _cut(bounds, atoms, at, low, False))
        open_: set[int] = set()
        for k, end in enumerate(upper or []):
            begin = lower[k]
            for i in range(max(0, bisect_right(bounds, begin) - 1), min(len(atoms), bisect_right(bounds, end))):
                if not atoms[i].single:
                    open_.add(i)
        if not open_:
            break
        split = [atoms[i] for i in sorted(open_)]
        # ranges of one width are read together; the list of their numbers is bounded by the windows around the cuts
        finer: list[Atom] = []
        spark = rows.sparkSession
        for bits in sorted({a.bits for a in split}):
            wanted = spark.createDataFrame([(a.bin,) for a in split if a.bits == bits], "wanted long")
            finer += _ranges(rows.join(F.broadcast(wanted), F.shiftright("h", bits) == F.col("wanted"), "left_semi"), max(0, bits - STEP_BITS))
        atoms = sorted([a for i, a in enumerate(atoms) if i not in open_] + finer, key=lambda a: a.first)
    begins = [atoms[i].first if i < len(atoms) else None for i in balanced_cuts(bounds, atoms, shards, high)]
    return [b for b in begins if b is not None], high


def shard_number(h: Column, cuts: list[int]) -> Column:
    """How many cuts are at or before ``h``."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= h)) if cuts else F.lit(0)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size in bytes (UTF-8 text plus ``ROW_BYTES``), text_crc32 and the hash of the text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Equal texts share a shard, and so do null and empty ones, whose text_crc32 is that of no bytes, 0; the largest shard is
    as small as the order allows. Slots run from 0 without gaps in each shard, in an order that only the row decides;
    identical rows may swap. A very long text is one atom, whole. Other columns are not read. An empty table gives no rows.
    """
    rows = settle(describe(docs))
    cuts, _ = find_cuts(rows, shards)
    placed = rows.withColumn("shard", shard_number(F.col("h"), cuts).cast("int"))
    return positions(placed, ["shard"], ["doc_id", "h", "size"], F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> list[int]:
    """Write ``docs`` as Parquet under ``path/shard=N`` and return the cuts; a column named shard is replaced."""
    cuts, _ = find_cuts(settle(describe(docs)), shards)
    docs.withColumn("shard", shard_number(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), cuts)).write.partitionBy("shard").parquet(path)
    return cuts
