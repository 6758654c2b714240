"""Polygons of any shape: what two layers share, and the outlines of districts from those of their units.

A polygon is ``rings``, an array of arrays of struct (x, y), read by the even-odd rule: holes are rings like others. Rings may
touch but not cross themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import NONE, Blocks, Range, of
from .components import settle

#: Numbers in one working matrix, at most.
WORK = 1 << 21


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Few bytes, much work: in as many tasks as the setting says, not to be put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sides_of(rings: list[list[dict]]) -> np.ndarray:
    """Rows x0, y0, x1, y1 of all sides that aren't upright; upright ones bound no strip."""
    out = [np.concatenate([xy, np.roll(xy, -1, axis=0)], axis=1) for ring in rings if ring and len(xy := np.array([(p["x"], p["y"]) for p in ring], float)) > 2]
    sides = np.concatenate(out) if out else np.zeros((0, 4))
    return sides[sides[:, 0] != sides[:, 2]]


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the places where sides of ``a`` meet sides of ``b``."""
    found = [np.zeros(0)]
    step = max(1, WORK // max(1, len(b)))
    for at in range(0, len(a), step):
        p, r = a[at : at + step, None, :2], a[at : at + step, None, 2:] - a[at : at + step, None, :2]
        q, s = b[None, :, :2], b[None, :, 2:] - b[None, :, :2]
        turn = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
        gap = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[..., 0] * s[..., 1] - gap[..., 1] * s[..., 0]) / turn
            u = (gap[..., 0] * r[..., 1] - gap[..., 1] * r[..., 0]) / turn
        hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append((p[..., 0] + t * r[..., 0])[hit])
    return np.concatenate(found)


def _heights(sides: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Heights at which each upright line x meets the sides; infinite where one doesn't reach it."""
    x0, y0, x1, y1 = sides.T
    reached = (np.minimum(x0, x1) < x[:, None]) & (x[:, None] < np.maximum(x0, x1))
    return np.where(reached, y0 + (x[:, None] - x0) / (x1 - x0) * (y1 - y0), np.inf)


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area inside both of two polygons, given by their sides.

    Cut at every corner and crossing, the plane falls into strips in which no sides cross; there the shared length is linear, so
    its value in the middle times the width is the area of the strip.
    """
    if not len(a) or not len(b):
        return 0.0
    low, high = (f(g(s[:, ::2]) for s in (a, b)) for f, g in ((max, np.min), (min, np.max)))
    cuts = np.concatenate([a[:, ::2].ravel(), b[:, ::2].ravel(), _crossings(a, b)])
    cuts = np.unique(cuts[(cuts >= low) & (cuts <= high)])
    middle, width, total = (cuts[1:] + cuts[:-1]) / 2, np.diff(cuts), 0.0
    step = max(1, WORK // (len(a) + len(b)))
    for at in range(0, len(middle), step):
        heights = np.concatenate([_heights(s, middle[at : at + step]) for s in (a, b)], axis=1)
        order = np.argsort(heights, axis=1, kind="stable")
        heights, of_a = np.take_along_axis(heights, order, axis=1), order < len(a)
        inside = (np.cumsum(of_a, axis=1) % 2 == 1) & (np.cumsum(~of_a, axis=1) % 2 == 1)
        ends = np.where(np.isfinite(heights), heights, 0.0)
        lengths = np.where(inside[:, :-1] & np.isfinite(heights[:, 1:]), ends[:, 1:] - ends[:, :-1], 0.0).sum(axis=1)
        total += float((lengths * width[at : at + step]).sum())
    return total


def polygon_areas(polygons: DataFrame, key: str) -> DataFrame:
    """(key, area) of ``polygons(key, rings)``."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [sides_of(r or []) for r in b.column("rings").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([shared_area(s, s) for s in sides], pa.float64())], [key, "area"])

    return _dealt(polygons.select(key, "rings"), key).mapInArrow(run, f"{key} {kind}, area double")


def _tiled(polygons: DataFrame, key: str, tile: float) -> DataFrame:
    """Polygons in the tiles that their boxes touch."""
    corners = F.flatten("rings")
    ends = {f"{key}_{c}{i}": f(F.transform(corners, lambda p: p[c])) for c in "xy" for i, f in ((0, F.array_min), (1, F.array_max))}  # noqa: B023
    boxed = polygons.where(F.size(corners) > 0).select(key, F.col("rings").alias(f"{key}_rings"), *[e.alias(n) for n, e in ends.items()])
    span = lambda c: F.sequence(F.floor(F.col(f"{key}_{c}0") / tile), F.floor(F.col(f"{key}_{c}1") / tile))
    return boxed.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))


def overlay(units: DataFrame, zones: DataFrame, tile: float) -> DataFrame:
    """(unit, zone, area, share) of ``units(unit, rings)`` and ``zones(zone, rings)``: the area they share, where there is any, and
    as a part of the unit's.

    Polygons meet in square tiles by their boxes; a pair is measured once, in the tile of the lower corner that both boxes have
    in common. A polygon without rings shares nothing, a unit without area has no share.
    """
    unit_kind, zone_kind = (df.schema[k].dataType.simpleString() for df, k in ((units, "unit"), (zones, "zone")))
    low = {c: F.greatest(f"unit_{c}0", f"zone_{c}0") for c in "xy"}
    apart = [F.least(f"unit_{c}1", f"zone_{c}1") <= low[c] for c in "xy"]
    here = (F.floor(low["x"] / tile) == F.col("tx")) & (F.floor(low["y"] / tile) == F.col("ty"))
    met = _tiled(units, "unit", tile).join(_tiled(zones, "zone", tile), ["tx", "ty"]).where(here & ~(apart[0] | apart[1])).select("unit", "zone", "unit_rings", "zone_rings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            area = [shared_area(sides_of(u), sides_of(z)) for u, z in zip(b.column("unit_rings").to_pylist(), b.column("zone_rings").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("zone"), pa.array(area, pa.float64())], ["unit", "zone", "area"])

    found = _dealt(met, "unit").mapInArrow(run, f"unit {unit_kind}, zone {zone_kind}, area double").where("area > 0")
    whole = polygon_areas(units, "unit").select(F.col("unit").alias("_unit"), F.col("area").alias("_area"))
    return found.join(whole, F.col("unit") == F.col("_unit")).select("unit", "zone", "area", F.try_divide("area", "_area").alias("share"))


def uncovered(units: DataFrame, shares: DataFrame) -> DataFrame:
    """(unit, area, covered, outside) of ``units(unit, rings)`` under the zones of their ``overlay``, which must not overlap."""
    by = shares.groupBy(F.col("unit").alias("_unit")).agg(F.sum("area").alias("covered"))
    covered = F.coalesce(F.col("covered"), F.lit(0.0))
    return polygon_areas(units, "unit").join(by, F.col("unit") == F.col("_unit"), "left").select("unit", "area", covered.alias("covered"), F.greatest(F.col("area") - covered, F.lit(0.0)).alias("outside"))


# --- outlines of districts ----------------------------------------------------------------------------------------

def turned_area(points: Column) -> Column:
    """Area of a ring, positive if it runs counter-clockwise."""
    n = F.size(points)
    term = lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, b: a + b) / 2


def unit_sides(unit_geom: DataFrame, digits: int = 6) -> DataFrame:
    """(unit, side, ax, ay, bx, by, other): the sides of ``unit_geom(unit, ring)`` with the unit on their left, and the unit that
    has the same side from its other end."""
    ring = F.transform("ring", lambda p: F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y")))
    rows = unit_geom.where(F.size("ring") > 2).select("unit", ring.alias("ring"))
    rows = rows.select("unit", F.when(turned_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"))
    n = F.size("ring")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b")))
    s = rows.select("unit", F.posexplode(ends).alias("side", "e")).select("unit", "side", *[F.col(f"e.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    s = s.where("ax <> bx OR ay <> by")
    t = s.select(F.col("unit").alias("other"), *[F.col(f"{e}{c}").alias(f"_{f}{c}") for e, f in ("ab", "ba") for c in "xy"])
    return s.join(t, [F.col(c) == F.col(f"_{c}") for c in ("ax", "ay", "bx", "by")], "left").select("unit", "side", "ax", "ay", "bx", "by", "other")


def district_sides(assignments: DataFrame | Blocks, unit_geom: DataFrame) -> DataFrame:
    """(plan, district, node, ax, ay, bx, by): the sides of units that no unit of the same district has from its other end.

    Sides meet the plans in the ranges of their units, and only those that bound a district leave it.
    """
    blocks, corners = of(assignments), ["ax", "ay", "bx", "by"]
    node = F.shiftleft(F.col("unit").cast("long"), 16) + F.col("side")
    # a side without another unit leads back to its own one, and is marked
    sides = unit_sides(unit_geom).select(F.col("unit").alias("u"), F.coalesce("other", "unit").alias("v"), F.col("other").isNull().alias("open"), node.alias("node"), *corners)
    rows, needs = blocks.by_edge(sides, both=False)

    def run(r: Range, table: pa.Table) -> pa.Table:
        u, v, open_ = (table.column(c).to_numpy() for c in ("u", "v", "open"))
        i, a = r.columns(u)
        j, b = r.columns(v[i])
        held = r.kinds[:, a]
        shared = np.zeros(held.shape, np.int64)
        k, x = np.nonzero((held[:, j] == r.kinds[:, b]) & ~open_[i][j])
        np.add.at(shared, (k, j[x]), 1)
        k, x = np.nonzero((shared == 0) & (held > NONE))
        y, plan = r.spread(k)
        k, x = k[y], x[y]
        row = pa.array(i[x])
        return pa.table([pa.array(plan, pa.int64()), pa.array(held[k, x], pa.int64()), *[table.column(c).take(row) for c in ("node", *corners)]], names=["plan", "district", "node", *corners])

    return blocks.typed(blocks.meet(rows, run, "plan long, district long, node long, ax double, ay double, bx double, by double", needs))


#: Sides of one district's border that a task takes at once; more are refused.
MOST_SIDES = 8_000_000


def _rings(table: pa.Table) -> pa.Table:
    """(plan, district, ring, points, area) of one district, from its sides."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    ax, ay, bx, by = (table.column(c).to_numpy()[order] for c in ("ax", "ay", "bx", "by"))
    _, at = np.unique(np.stack([np.concatenate([ax, bx]), np.concatenate([ay, by])]), axis=1, return_inverse=True)
    at = at.ravel()
    n = len(ax)
    first = np.argsort(at[:n], kind="stable")
    low, high = (np.searchsorted(at[:n][first], at[n:], s) for s in ("left", "right"))
    size = high - low
    i = np.repeat(np.arange(n), size)
    j = first[np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
    whole = 2 * np.pi
    turn = np.mod(np.arctan2(ay[i] - by[i], ax[i] - bx[i]) - np.arctan2(by[j] - by[i], bx[j] - bx[i]), whole)
    turn[(turn < 1e-9) | (turn > whole - 1e-9)] = whole  # straight back comes last
    best = np.lexsort((j, turn, i))
    best = best[np.concatenate([[True], i[best][1:] != i[best][:-1]])] if len(best) else best
    after = np.full(n, -1)
    after[i[best]] = j[best]
    left, follow, rings = [True] * n, after.tolist(), []
    for start in range(n):
        path, u = [], start
        while u >= 0 and left[u]:
            left[u] = False
            path.append(u)
            u = follow[u]
        if path and u == start:
            rings.append(path)
    ends = np.cumsum([0, *map(len, rings)])
    x, y = ax[flat := np.array([u for r in rings for u in r], np.int64)], ay[flat]
    points = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    plan, district = (pa.array([table.column(c)[0].as_py()] * len(rings), table.schema.field(c).type) for c in ("plan", "district"))
    area = [float(np.cumsum(x[a:b] * np.roll(y[a:b], -1) - np.roll(x[a:b], -1) * y[a:b])[-1]) / 2 for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([plan, district, pa.array(range(len(rings)), pa.int32()), points, pa.array(area, pa.float64())], names=["plan", "district", "ring", "points", "area"])


def dissolve(assignments: DataFrame | Blocks, unit_geom: DataFrame) -> DataFrame:
    """(plan, district, ring, points, area): the rings of every district of every plan.

    Outer rings run counter-clockwise and have positive areas, holes run clockwise and have negative ones; the areas of a district
    add up to those of its units. Where rings touch in a corner they stay apart. ``ring`` is its number in the district, from 0.

    Sides of units that occur once in a district are its border. Each points to the one that follows with the district on the
    left: of the sides that start at its end, the first one clockwise from it. A district's border is followed in one task, which
    takes more than ``MOST_SIDES`` sides for an error. A ring starts at its smallest side, and rings come in order of theirs. Units
    must share whole sides; unit numbers must be whole and below 2^47, sides of a unit below 2^16.
    """
    sides = settle(district_sides(assignments, unit_geom))
    large = sides.groupBy("plan", "district").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SIDES).limit(1).collect()
    if large:
        raise ValueError(f"district {large[0]['district']} of plan {large[0]['plan']} has {large[0]['n']} sides on its border; at most {MOST_SIDES} are followed in one task")
    kind = ", ".join(f"{c} {sides.schema[c].dataType.simpleString()}" for c in ("plan", "district"))
    return sides.groupBy("plan", "district").applyInArrow(_rings, f"{kind}, ring int, points array<struct<x: double, y: double>>, area double")


def outlines(rings: DataFrame) -> DataFrame:
    """(plan, district, rings) from ``dissolve``, as polygons that ``overlay`` reads."""
    return rings.groupBy("plan", "district").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
