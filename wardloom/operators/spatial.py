"""Neighbours and containment from outlines: equi-joins on shared segments, corners and grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import of
from .forest import spanning_forest


def segments(unit_geom: DataFrame, digits: int = 6) -> DataFrame:
    """(unit, ax, ay, bx, by, length): sides of ``unit_geom(unit, ring)``, each written from its smaller end."""
    n = F.size("ring")
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", (i + 1) % n).alias("q")))
    s = unit_geom.select("unit", F.explode(side).alias("s")).select("unit", *[F.round(F.col(f"s.{e}.{c}"), digits).alias(f"{e}{c}") for e in "pq" for c in "xy"])
    first = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    out = s.select("unit", pick("px", "qx").alias("ax"), pick("py", "qy").alias("ay"), pick("qx", "px").alias("bx"), pick("qy", "py").alias("by"))
    return out.withColumn("length", F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))).where("length > 0")


def rook_edges(unit_geom: DataFrame) -> DataFrame:
    """(u, v, shared_len): units that share whole sides, with their length."""
    s = segments(unit_geom)
    t = s.select(F.col("unit").alias("v"), *[F.col(c).alias(f"_{c}") for c in ("ax", "ay", "bx", "by")])
    same = [F.col(c) == F.col(f"_{c}") for c in ("ax", "ay", "bx", "by")]
    return s.join(t, [*same, F.col("unit") < F.col("v")]).groupBy(F.col("unit").alias("u"), "v").agg(F.sum("length").alias("shared_len"))


def queen_edges(unit_geom: DataFrame, digits: int = 6) -> DataFrame:
    """(u, v): units that share a corner."""
    c = unit_geom.select("unit", F.explode("ring").alias("p")).select("unit", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    d = c.select(F.col("unit").alias("v"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return c.join(d, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("unit") < F.col("v"))).select(F.col("unit").alias("u"), "v").distinct()


def _inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) crosses the ring an odd number of times."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def locate_points(points: DataFrame, unit_geom: DataFrame, cell: float = 1.0) -> DataFrame:
    """(point, unit) for ``points(point, x, y)``: the unit whose outline holds the point, null where none does. Outlines meet
    points in grid cells of width ``cell``."""
    low = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    span = lambda c: F.sequence(F.floor(low(c) / cell), F.floor(high(c) / cell))
    boxes = unit_geom.select("unit", "ring", F.explode(span("x")).alias("cx"), span("y").alias("ys")).select("unit", "ring", "cx", F.explode("ys").alias("cy"))
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    hits = at.join(boxes, ["cx", "cy"]).where(_inside(F.col("ring"), F.col("x"), F.col("y"))).groupBy("point").agg(F.min("unit").alias("unit"))
    return points.select("point").join(hits, "point", "left")


def pieces_by_contact(assignments: DataFrame, rook: DataFrame, queen: DataFrame) -> DataFrame:
    """(plan, district, rook, queen): connected parts of each district over shared sides, and over shared corners as well.

    ``rook(u, v)`` and ``queen(u, v)`` are the edges of either kind; a district with fewer parts by corners hangs together at points.
    """

    blocks = of(assignments)

    def pieces(edges: DataFrame, name: str) -> DataFrame:
        rows = spanning_forest(blocks, edges.select("u", "v"), nodes="parts")
        return rows.groupBy("plan", "district").agg(F.count_if(F.col("parent").isNull()).alias(name))

    return pieces(rook, "rook").join(pieces(queen, "queen"), ["plan", "district"])


def water_share(units: DataFrame, areas: DataFrame) -> DataFrame:
    """(unit, land, water, share) of ``areas(unit, land, water)``: which part of a unit is water; null without any area, and for units
    that the table lacks."""
    met = units.select("unit").join(areas.select("unit", "land", "water"), "unit", "left")
    return met.select("unit", "land", "water", F.try_divide(F.col("water").cast("double"), F.col("land") + F.col("water")).alias("share"))


def district_summary(assignments: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(plan, district, units, pop, deviation, share): against the ideal population of k districts."""
    total = units.agg(F.sum("pop").alias("_total"))
    rows = assignments.join(units.select("unit", "pop"), "unit").groupBy("plan", "district").agg(F.count("*").alias("units"), F.sum("pop").alias("pop"))
    ideal = F.col("_total") / F.lit(float(k))
    return rows.crossJoin(F.broadcast(total)).select("plan", "district", "units", "pop", (F.col("pop") - ideal).alias("deviation"), F.when(ideal > 0, (F.col("pop") - ideal) / ideal).alias("share"))


def threshold_counts(values: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n): rows at or below each threshold."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    return values.select(column, at.alias("threshold")).groupBy("threshold").agg(F.count_if(F.col(column) <= F.col("threshold")).alias("n"))


def overlay_boxes(units: DataFrame, zones: DataFrame, tile: float) -> DataFrame:
    """(unit, zone, share): which part of each unit's area a zone covers, for ``units(unit, x0, y0, x1, y1)`` and
    ``zones(zone, x0, y0, x1, y1)``. Boxes meet in square tiles; a pair is measured in the tile of its overlap's lower corner
    alone, so it counts once however many tiles both touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))

    def tiled(boxes: DataFrame, key: str) -> DataFrame:
        named = boxes.select(key, *[F.col(c).alias(f"{key}_{c}") for c in ("x0", "y0", "x1", "y1")])
        return named.withColumn("tx", F.explode(span(f"{key}_x0", f"{key}_x1"))).withColumn("ty", F.explode(span(f"{key}_y0", f"{key}_y1")))

    low = {c: F.greatest(f"unit_{c}0", f"zone_{c}0") for c in "xy"}
    wide = {c: F.least(f"unit_{c}1", f"zone_{c}1") - low[c] for c in "xy"}
    met = tiled(units, "unit").join(tiled(zones, "zone"), ["tx", "ty"]).where((F.floor(low["x"] / tile) == F.col("tx")) & (F.floor(low["y"] / tile) == F.col("ty")) & (wide["x"] > 0) & (wide["y"] > 0))
    return met.select("unit", "zone", (wide["x"] * wide["y"] / ((F.col("unit_x1") - F.col("unit_x0")) * (F.col("unit_y1") - F.col("unit_y0")))).alias("share"))


def main_zone(units: DataFrame, shares: DataFrame, least: float = 0.0) -> DataFrame:
    """(unit, zone, share): the zone that covers most of each unit, of equal ones the smallest; null where that part is below
    ``least`` or no zone covers any. All units stay."""
    best = shares.groupBy("unit").agg(F.max_by(F.struct("zone", "share"), F.struct("share", -F.col("zone"))).alias("_b")).select("unit", F.col("_b.zone").alias("zone"), F.col("_b.share").alias("share"))
    return units.select("unit").join(best.where(F.col("share") >= least), "unit", "left")
