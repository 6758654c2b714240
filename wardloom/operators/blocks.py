"""Plans packed by ranges of units, so that what happens inside a range is worked out where it lies.

``Blocks(assignments)`` holds the rows of ``assignments(plan, unit, district)`` as tables of districts, plans by units, one for each
block of plans and range of units, packed into bytes and written once. Frames by unit or edge meet them range by range; units of
another range that an edge leads to are lent to it. Within a range plans of the same districts are worked out once. No task holds
more than ``CELLS`` districts or so, and what leaves a range is as large as its border. Any numbers of units are right; neighbours
with near numbers are faster.

Plans and units must be whole numbers; rows without one are left out. Units may be missing from plans, or be in several districts.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import settle

#: Plans in a block, districts in a range of a block, rows that are packed at once.
PLAN_BLOCK, CELLS, CHUNK = 256, 1 << 20, 1 << 20
#: In place of a district: no row for this plan and unit, and a row whose district is null.
ABSENT, NONE = -(1 << 63), -(1 << 63) + 1
#: (block, part) pairs that are sent to every task; more meet rows in a shuffle.
FEW = 1_000_000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def grid(plan: np.ndarray, unit: np.ndarray, district: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plans, units, districts): a row a plan and a column a unit, both in order; a unit that a plan has twice gets two columns."""
    cut = np.flatnonzero(unit[1:] != unit[:-1]) + 1
    n = len(cut) + 1
    wide = len(unit) // n
    if n * wide == len(unit) and (cut == np.arange(1, n) * wide).all():  # the same plans for each unit in turn
        plans, units = plan.reshape(n, wide), unit[::wide]
        order = np.argsort(units, kind="stable")
        if (plans == plans[0]).all() and (np.diff(plans[0]) > 0).all() and (np.diff(units[order]) > 0).all():
            return plans[0], units[order], district.reshape(n, wide)[order].T
    plans, p = np.unique(plan, return_inverse=True)
    units, u = np.unique(unit, return_inverse=True)
    at = u * len(plans) + p
    if np.bincount(at).max() > 1:
        order = np.lexsort((district, at))
        at, p, u, district = at[order], p[order], u[order], district[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        again = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        most = int(again.max()) + 1
        columns, u = np.unique(u * most + again, return_inverse=True)
        units = units[columns // most]
    out = np.full((len(plans), len(units)), ABSENT)
    out[p, u] = district
    return plans, units, out


def _packed(plans: np.ndarray, units: np.ndarray, held: np.ndarray) -> bytes:
    known = held > NONE
    low, high = (int(held[known].min()), int(held[known].max())) if known.any() else (0, 0)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if high - low + 2 <= np.iinfo(k).max), None)
    codes = held if kind is None else np.where(known, held - low + 2, held == NONE).astype(kind)
    return zlib.compress(pickle.dumps((plans, units, low, np.ascontiguousarray(codes)), 5), 1)


def _unpacked(rows: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plans, units, low, codes = pickle.loads(zlib.decompress(rows))
    if codes.dtype == np.int64:
        return plans, units, codes
    return plans, units, np.where(codes > 1, codes.astype(np.int64) + (low - 2), np.where(codes == 1, NONE, ABSENT))


def _together(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several grids as one."""
    if len(held) == 1:
        return held[0]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    units = np.concatenate([u for _, u, _ in held])
    order = np.argsort(units, kind="stable")
    apart = (np.diff(units[order]) > 0).all()
    if apart and all(np.array_equal(p, held[0][0]) for p, _, _ in held):
        return held[0][0], units[order], np.concatenate([d for _, _, d in held], axis=1)[:, order]
    at = [np.nonzero(d != ABSENT) for _, _, d in held]
    return grid(*(np.concatenate(x) for x in zip(*((p[i], u[j], d[i, j]) for (i, j), (p, u, d) in zip(at, held, strict=True)), strict=True)))


class Range:
    """One range of units of a block of plans: ``plans``, ``units`` and ``own`` (whether a unit is of this range, or lent) by column,
    ``kinds`` (each different row of districts once), ``turn`` (which of them a plan has) and ``n``, how many there are."""

    def __init__(self, table: pa.Table) -> None:
        home = table.column("home").to_numpy()
        rows = [_unpacked(x.as_buffer()) for x in table.column("rows")]
        plans, units, held = _together([x for x, h in zip(rows, home, strict=True) if h])
        more, lent, across = _together([x for x, h in zip(rows, home, strict=True) if not h])
        own = np.ones(len(units), bool)
        if len(lent) and len(units):
            at = np.searchsorted(more, plans)
            hit = np.isin(plans, more)
            beside = np.full((len(plans), len(lent)), ABSENT)
            beside[hit] = across[at[hit]]
            units, own, held = np.concatenate([units, lent]), np.concatenate([own, np.zeros(len(lent), bool)]), np.concatenate([held, beside], axis=1)
            order = np.argsort(units, kind="stable")
            units, own, held = units[order], own[order], held[:, order]
        self.plans, self.units, self.own = plans, units, own
        held = np.ascontiguousarray(held)
        seen: dict[bytes, int] = {}
        self.turn = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in held], np.int64)
        self.n = len(seen)
        first = np.full(self.n, 0)
        first[self.turn[::-1]] = np.arange(len(plans))[::-1]
        self.kinds = held[first]
        self._by = np.argsort(self.turn, kind="stable")
        self._count = np.bincount(self.turn, minlength=self.n)
        self._start = np.cumsum(self._count) - self._count

    def columns(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, column) for each column of each of ``units``."""
        low, high = (np.searchsorted(self.units, units, s) for s in ("left", "right"))
        size = high - low
        i = np.repeat(np.arange(len(units)), size)
        return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)

    def pairs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, column of u, column of v) for each pair of units."""
        i, a = self.columns(u)
        j, b = self.columns(v[i])
        return i[j], a[j], b

    def spread(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, plan): rows that hold for one kind of districts, for each plan that has it."""
        size = self._count[kind]
        i = np.repeat(np.arange(len(kind)), size)
        at = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self._start[kind], size)
        return i, self.plans[self._by[at]]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Kinds by pairs of columns: whether both are in one district."""
        left = self.kinds[:, a]
        return (left == self.kinds[:, b]) & (left > NONE)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Kinds by pairs of columns: whether both are in districts, but not in the same."""
        left, right = self.kinds[:, a], self.kinds[:, b]
        return (left != right) & (left > NONE) & (right > NONE)


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to ``n - 1`` the smallest one that it is connected with over pairs (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def districts(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values <= NONE)


def unique(*columns: np.ndarray) -> list[np.ndarray]:
    """Different rows of columns of whole numbers."""
    if not len(columns[0]):
        return list(columns)
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in rows], axis=0)])
    return [c[new] for c in rows]


def _chunk(batches: list[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    plan, unit = (t.column(c).to_numpy() for c in ("plan", "unit"))
    district = pc.fill_null(t.column("district"), NONE).to_numpy()
    new = np.concatenate([[True], unit[1:] != unit[:-1]])
    part = np.searchsorted(bounds, unit[new], side="right")[np.cumsum(new) - 1]
    at = np.floor_divide(plan, PLAN_BLOCK) * (len(bounds) + 1) + part
    order = np.argsort(at, kind="stable")
    for i in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        rows = _packed(*grid(plan[i], unit[i], district[i]))
        yield pa.record_batch([pa.array([plan[i[0]] // PLAN_BLOCK], pa.int64()), pa.array([part[i[0]]], pa.int32()), pa.array([True]), pa.array([rows], pa.binary())], names=["block", "part", "home", "rows"])


class Blocks:
    """``assignments`` packed; operators that know nothing of it read ``source``."""

    SCHEMA = "block long, part int, home boolean, rows binary"

    def __init__(self, assignments: DataFrame) -> None:
        types = dict(assignments.dtypes)
        if any(types[c] not in WHOLE for c in ("plan", "unit", "district")):
            raise ValueError("plans, units and districts must be whole numbers")
        self.source, self.types, self.spark = assignments, types, assignments.sparkSession
        rows = assignments.where("plan IS NOT NULL AND unit IS NOT NULL").select(*[F.col(c).cast("long").alias(c) for c in ("plan", "unit", "district")])
        by = rows.groupBy("unit").agg(F.min("plan").alias("low"), F.max("plan").alias("high"))

        def facts(steps: int):
            ends = F.percentile_approx("unit", F.array(*[F.lit(i / steps) for i in range(1, steps)]), 10 * steps) if steps > 1 else F.array().cast("array<long>")
            return by.agg(F.count("*").alias("units"), F.min("low").alias("low"), F.max("high").alias("high"), ends.alias("ends")).first()

        steps = 1024
        found = facts(steps)
        parts = max(1, math.ceil(found["units"] * PLAN_BLOCK / CELLS))
        if parts > steps:
            found = facts(steps := parts)
        ends = found["ends"] or []
        bounds = self.bounds = np.unique(np.array([ends[i * steps // parts - 1] for i in range(1, parts)] if ends else [], np.int64))
        blocks = (found["high"] or 0) // PLAN_BLOCK - (found["low"] or 0) // PLAN_BLOCK + 1
        #: Tasks; few bytes mean much work, so they are not to be put together again.
        self.tasks = max(1, min(blocks * (len(bounds) + 1), 1000))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            n = 0
            for b in batches:
                if b.num_rows:
                    held, n = [*held, b], n + b.num_rows
                if n >= CHUNK:
                    # the last unit may go on in the next batch
                    unit = held[-1].column("unit").to_numpy()
                    cut = int((np.flatnonzero(unit[1:] != unit[:-1])[-1:] + 1).sum())
                    rest, held[-1] = held[-1].slice(cut), held[-1].slice(0, cut)
                    if cut:
                        yield from _chunk(held, bounds)
                        held, n = [rest], rest.num_rows
                    elif n >= 2 * CHUNK:
                        yield from _chunk([*held[:-1], rest], bounds)
                        held, n = [], 0
                    else:
                        held[-1] = rest
            if held:
                yield from _chunk(held, bounds)

        self.frame = settle(self.dealt(rows.mapInArrow(pack, self.SCHEMA)))
        self.keys = settle(self.frame.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct())
        self.few = self.keys.count() <= FEW

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.tasks, "block", "part")

    def placed(self, rows: DataFrame, *units: str) -> DataFrame:
        """``rows`` with _at0, _at1, ...: the ranges of the units in these columns. Rows in which one is null are left out."""
        bounds = self.bounds
        held = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in units)).withColumns({c: F.col(c).cast("long") for c in units})
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + "".join(f", _at{i} int" for i in range(len(units)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [pa.array(np.searchsorted(bounds, b.column(c).to_numpy(), side="right"), pa.int32()) for c in units]
                yield pa.RecordBatch.from_arrays([*b.columns, *at], [*b.schema.names, *[f"_at{i}" for i in range(len(units))]])

        return held.mapInArrow(run, schema)

    def in_blocks(self, rows: DataFrame, on: str = "part") -> DataFrame:
        """``rows`` by part (or block) for each block (or part) that has it."""
        return rows.join(F.broadcast(self.keys) if self.few else self.keys, on)

    def by_unit(self, rows: DataFrame, unit: str = "unit") -> DataFrame:
        """``rows`` in the ranges of their units."""
        return self.in_blocks(self.placed(rows, unit).withColumnRenamed("_at0", "part"))

    def by_edge(self, edges: DataFrame, both: bool = True) -> tuple[DataFrame, DataFrame]:
        """``edges(u, v, ...)`` in the range of u (``first``) and, with ``both``, in that of v; and the units to be lent for them."""
        at = self.placed(edges, "u", "v")
        parts = F.array_distinct(F.array("_at0", "_at1")) if both else F.array("_at0")
        rows = at.select("*", F.explode(parts).alias("part")).withColumn("first", F.col("part") == F.col("_at0")).drop("_at0", "_at1")
        lent = lambda unit, home, to: F.struct(F.col(unit).alias("unit"), F.col(home).alias("part"), F.col(to).alias("to"))
        needs = [lent("v", "_at1", "_at0"), *([lent("u", "_at0", "_at1")] if both else [])]
        needed = at.where("_at0 <> _at1").select(F.inline(F.array(*needs))).distinct()
        return self.in_blocks(rows), self.in_blocks(needed)

    def alone(self, run: Callable[[Range], pa.Table], schema: str) -> DataFrame:
        """``run`` over each range by itself."""
        return self.dealt(self.frame).groupBy("block", "part").applyInArrow(lambda t: run(Range(t)), schema)

    def meet(self, rows: DataFrame, run: Callable[[Range, pa.Table], pa.Table], schema: str, needs: DataFrame | None = None) -> DataFrame:
        """``run(range, rows)`` over each range and its ``rows(block, part, ...)``, with the units that it ``needs`` from others."""
        held = self.frame
        if needs is not None:

            def lend(table: pa.Table, wanted: pa.Table) -> pa.Table:
                out = []
                if table.num_rows and wanted.num_rows:
                    plans, units, grid_ = _together([_unpacked(x.as_buffer()) for x in table.column("rows")])
                    unit, to = wanted.column("unit").to_numpy(), wanted.column("to").to_numpy()
                    for t in np.unique(to):
                        here = np.isin(units, unit[to == t])
                        if here.any():
                            out.append((table.column("block")[0].as_py(), int(t), False, _packed(plans, units[here], grid_[:, here])))
                return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["block", "part", "home", "rows"])

            held = held.unionByName(self.dealt(held).groupBy("block", "part").cogroup(self.dealt(needs).groupBy("block", "part")).applyInArrow(lend, self.SCHEMA))

        def both(table: pa.Table, beside: pa.Table) -> pa.Table:
            return run(Range(table), beside) if table.num_rows and pc.any(table.column("home")).as_py() else pa.table({})

        return self.dealt(held).groupBy("block", "part").cogroup(self.dealt(rows).groupBy("block", "part")).applyInArrow(both, schema)

    def sums(self, values: DataFrame, columns: list[str]) -> DataFrame:
        """(plan, district, units, *columns): different units of ``values(unit, ...)`` in each district, and the sums of its columns.

        Units that either side lacks are left out. A sum is null if all its values are.
        """
        kinds = {c: "double" if t in ("float", "double") else "long" for c, t in values.dtypes if c in columns}
        rows = self.by_unit(values.select("unit", *[F.col(c).cast(kinds[c]).alias(f"v{i}") for i, c in enumerate(columns)]))

        def run(r: Range, table: pa.Table) -> pa.Table:
            unit = table.column("unit").to_numpy()
            i, c = r.columns(unit)
            held = r.kinds[:, c]
            names, code = np.unique(held, return_inverse=True)
            code = code.reshape(held.shape) + np.arange(r.n)[:, None] * len(names)
            k, j = np.nonzero(held != ABSENT)
            kind, name, _ = unique(k, held[k, j], unit[i][j])
            cells = r.n * len(names)
            at = kind * len(names) + np.searchsorted(names, name)
            units = np.bincount(at, minlength=cells)
            out = np.flatnonzero(units)
            spread, plan = r.spread(out // max(1, len(names)))
            out = out[spread]
            cols = [pa.array(plan, pa.int64()), districts(names[out % max(1, len(names))]), pa.array(units[out], pa.int64())]
            for x in range(len(columns)):
                column = table.column(f"v{x}")
                here, value = pc.is_valid(column).to_numpy()[i], pc.fill_null(column, 0).to_numpy()[i]
                total, known = np.zeros(cells, value.dtype), np.zeros(cells, np.int64)
                np.add.at(total, code, np.broadcast_to(value, code.shape))
                np.add.at(known, code, np.broadcast_to(here.astype(np.int64), code.shape))
                cols += [pa.array(total[out]), pa.array(known[out], pa.int64())]
            return pa.table(cols, names=["plan", "district", "units", *[f"{a}{x}" for x in range(len(columns)) for a in "vk"]])

        schema = "plan long, district long, units long" + "".join(f", v{i} {kinds[c]}, k{i} long" for i, c in enumerate(columns))
        some = self.meet(rows, run, schema).groupBy("plan", "district")
        total = [F.when(F.sum(f"k{i}") > 0, F.sum(f"v{i}")).alias(c) for i, c in enumerate(columns)]
        return self.typed(some.agg(F.sum("units").alias("units"), *total))

    def typed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with plans, units and districts of the types that they came in."""
        return rows.select(*[F.col(c).cast(self.types[c]).alias(c) if c in ("plan", "unit", "district") else F.col(c) for c in rows.columns])

    def order(self) -> DataFrame:
        """(plan, order): arrays that sort as the districts of plans do, read in the order of units; a unit that a plan lacks comes last.

        A plan's place among the others in each range, so districts are never put together. Places compare within a block; where
        there are several, plans are compared by the text of their range.
        """
        one = self.keys.select("block").distinct().count() < 2

        def run(r: Range) -> pa.Table:
            held = np.where(r.kinds == ABSENT, np.iinfo(np.int64).max, r.kinds)
            raw = lambda x: (x.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
            if one:
                keys = [raw(row).tobytes() for row in held]
                place = {k: i for i, k in enumerate(sorted(set(keys)))}
                keys = [place[k].to_bytes(8, "big") for k in keys]
            else:
                keys = [raw(np.column_stack([r.units[here], row[here]]).ravel()).tobytes() + b"\xff" * 9 for row, here in zip(r.kinds, r.kinds != ABSENT, strict=True)]
            plans = [r.plans[r.turn == k].tolist() for k in range(r.n)]
            part = int(np.searchsorted(bounds, r.units[0], side="right"))
            return pa.table({"part": pa.array([part] * r.n, pa.int32()), "key": pa.array(keys, pa.binary()), "plans": pa.array(plans, pa.list_(pa.int64()))})

        bounds = self.bounds
        ranks = self.alone(run, "part int, key binary, plans array<long>")
        placed = ranks.withColumn("place", F.dense_rank().over(Window.partitionBy("part").orderBy("key"))).select("part", "place", F.explode("plans").alias("plan"))
        parts = placed.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("part", "place"))).alias("o"))
        end = F.array(F.lit(int(np.iinfo(np.int32).max)))
        return self.typed(parts.select("plan", F.concat(F.flatten(F.transform("o", lambda x: F.array(x["part"], x["place"]))), end).alias("order")))


def of(assignments: DataFrame | Blocks) -> Blocks:
    return assignments if isinstance(assignments, Blocks) else Blocks(assignments)


def block_of(plan: str | Column) -> Column:
    return F.floor((F.col(plan) if isinstance(plan, str) else plan) / PLAN_BLOCK).cast("long")
