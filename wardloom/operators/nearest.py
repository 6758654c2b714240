"""Records brought to units: by their own id, else by the outline that holds them, else by the nearest outline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import settle
from .spatial import _inside


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """How far (x, y) is from an outline: 0 inside and on it, else the distance to its nearest side."""
    n = F.size(ring)

    def side(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        along = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        ox, oy = p["x"] + t * dx - x, p["y"] + t * dy - y
        return F.sqrt(ox * ox + oy * oy)

    return F.when(_inside(ring, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), n - 1), side)))


#: Levels that a search goes down at a time: a cell has 4^STRIDE below it.
STRIDE = 2
#: Outlines in one array, about.
MET = 256


def _pyramid(boxes: DataFrame, outlines: DataFrame, cell: float, top: int) -> DataFrame:
    """(level, cx, cy, anchored): the cells of width cell * 2^level that an outline's box touches, for every STRIDE-th level, and
    whether a corner of an outline lies there."""
    corners = outlines.select(F.explode("ring").alias("p")).select(_cell("p.x", cell).alias("cx"), _cell("p.y", cell).alias("cy"), F.lit(True).alias("anchored"))
    bottom = corners.unionByName(boxes.select("cx", "cy", F.lit(False).alias("anchored"))).groupBy("cx", "cy").agg(F.bool_or("anchored").alias("anchored"))
    up = bottom.select("*", F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(STRIDE))).alias("level"))
    shifted = [F.expr(f"shiftright({c}, level)").alias(c) for c in ("cx", "cy")]
    return settle(up.select("level", *shifted, "anchored").groupBy("level", "cx", "cy").agg(F.bool_or("anchored").alias("anchored")))


def _cell(at: str, width: float | Column) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def _around(homes: DataFrame, level: Column) -> DataFrame:
    """``homes(hx, hy, ...)`` for each of the nine cells (cx, cy) of a level at and around them."""
    near = lambda c: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.call_function("shiftright", F.col(c), level) + d)
    return homes.select("*", F.explode(near("hx")).alias("cx")).select("*", F.explode(near("hy")).alias("cy"))


def _apart(low: dict[str, Column], high: dict[str, Column], cell: float) -> tuple[Column, Column]:
    """The least and the greatest distance from a place in cell (hx, hy) to one in a box."""
    h0, h1 = ({c: (F.col(f"h{c}") + d) * cell for c in "xy"} for d in (0, 1))
    gap = {c: F.greatest(low[c] - h1[c], h0[c] - high[c], F.lit(0.0)) for c in "xy"}
    reach = {c: F.greatest(high[c] - h0[c], h1[c] - low[c]) for c in "xy"}
    return tuple(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]) for d in (gap, reach))


def _still_near(met: DataFrame, width: float, cell: float) -> DataFrame:
    """The cells that may hold the nearest outline of a point of (hx, hy): not farther than the far side of some cell with a corner."""
    gap, reach = _apart({c: F.col(f"c{c}") * width for c in "xy"}, {c: (F.col(f"c{c}") + 1) * width for c in "xy"}, cell)
    far = F.min(F.when(F.col("anchored"), reach)).over(Window.partitionBy("hx", "hy"))
    rows = met.withColumn("bound", F.least(F.col("bound"), far))
    return rows.where(gap <= F.col("bound") * (1 + 1e-12)).select("hx", "hy", "bound", "cx", "cy")


def nearest_units(points: DataFrame, unit_geom: DataFrame, cell: float) -> DataFrame:
    """(point, unit, distance) for ``points(point, x, y)``: the nearest of ``unit_geom(unit, ring)``, of equal ones the smallest.

    Points that an outline of their own grid cell holds are done. The cells of the others look around in a pyramid of grids, each
    level 2^STRIDE times as wide as the one below, for the first at which a cell around them holds a corner of an outline; one
    level up, nothing beyond the nine cells can be nearer. From there they go down again, and at each level keep only the cells
    that are not farther than the far side of some cell with a corner. At the bottom few outlines are left, however far away
    they are. Only there the points meet them, as arrays of at most about ``MET`` outlines by cell; a point measures those whose
    box is not farther than the far corner of another's. So what a search moves follows the cells, and a point moves once.

    ``cell`` is about the width of an outline. Numbers of points must be unique. Points without finite coordinates, and all
    points where there is no outline, get null.
    """
    edge = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    outlines = unit_geom.where(F.size("ring") > 0).select("unit", "ring", *[edge(c, f).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.array_min), (1, F.array_max))])
    boxes = outlines.select("*", F.explode(F.sequence(_cell("x0", cell), _cell("x1", cell))).alias("cx")).select("*", F.explode(F.sequence(_cell("y0", cell), _cell("y1", cell))).alias("cy"))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    asked = points.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def measured(met: DataFrame) -> DataFrame:
        met = met.repartition(parts, "point")  # few bytes, much work: not to be put together again
        hit = F.struct(ring_distance(F.col("ring"), F.col("x"), F.col("y")).alias("distance"), F.col("unit"))
        return met.select("point", hit.alias("hit")).groupBy("point").agg(F.min("hit").alias("hit")).select("point", F.col("hit.unit").alias("unit"), F.col("hit.distance").alias("distance"))

    at_home = asked.withColumns({"cx": _cell("x", cell), "cy": _cell("y", cell)}).join(boxes, ["cx", "cy"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    held = settle(measured(at_home).where("distance = 0"))
    left = settle(asked.join(held, "point", "left_anti"))
    span = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide = outlines.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    found = held
    if span[0] is not None and wide[0] is not None:
        extent = max(max(wide[1], span[1]) - min(wide[0], span[0]), max(wide[3], span[3]) - min(wide[2], span[2]), cell)
        top = STRIDE * (math.ceil(math.log2(extent / cell) / STRIDE) + 1)  # here all lies in the nine cells around any point
        pyramid = _pyramid(boxes, outlines, cell, top)
        left = left.withColumns({"hx": _cell("x", cell), "hy": _cell("y", cell)})
        homes = settle(left.select("hx", "hy").distinct())
        level = F.explode(F.sequence(F.lit(0), F.lit(top), F.lit(STRIDE))).alias("level")
        wider = _around(homes.select("*", level), F.col("level"))
        begun = wider.join(pyramid.where("anchored"), ["level", "cx", "cy"]).groupBy("hx", "hy").agg(F.least(F.min("level") + STRIDE, F.lit(top)).alias("start"))
        begun = settle(begun)
        cells = None
        for now in range(begun.agg(F.max("start")).first()[0], -1, -STRIDE):
            width, here = cell * 2**now, pyramid.where(F.col("level") == now).drop("level")
            met = _around(begun.where(F.col("start") == now).drop("start"), F.lit(now)).join(here, ["cx", "cy"]).withColumn("bound", F.lit(float("inf")))
            if cells is not None:
                below = here.select(F.shiftright("cx", STRIDE).alias("_x"), F.shiftright("cy", STRIDE).alias("_y"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "anchored")
                met = met.unionByName(cells.join(below, (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y"))).select(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), "hx", "hy", "anchored", "bound"))
            cells = _still_near(met, width, cell)
        gap, _ = _apart(*({c: F.col(f"{c}{i}") for c in "xy"} for i in (0, 1)), cell)
        close = cells.join(boxes, ["cx", "cy"]).where(gap <= F.col("bound") * (1 + 1e-12)).dropDuplicates(["hx", "hy", "unit"])
        block = F.pmod(F.xxhash64("unit"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("hx", "hy")) / MET))
        lists = close.withColumn("block", block).groupBy("hx", "hy", "block").agg(F.collect_list(F.struct("unit", "ring", "x0", "x1", "y0", "y1")).alias("near")).drop("block")
        x, y = F.col("x"), F.col("y")
        size = lambda dx, dy: F.sqrt(dx * dx + dy * dy)
        least = lambda o: size(F.greatest(o["x0"] - x, x - o["x1"], F.lit(0.0)), F.greatest(o["y0"] - y, y - o["y1"], F.lit(0.0)))
        most = lambda o: size(F.greatest(o["x1"] - x, x - o["x0"]), F.greatest(o["y1"] - y, y - o["y0"]))
        met = left.repartition(parts, "hx", "hy").join(lists, ["hx", "hy"])
        far = F.array(F.array_min(F.transform("near", most)))  # an array of one: else found anew for each outline
        asked_of = F.flatten(F.transform(far, lambda d: F.filter("near", lambda o: least(o) <= d * (1 + 1e-12))))
        hit = F.array_min(F.transform(asked_of, lambda o: F.struct(ring_distance(o["ring"], x, y).alias("distance"), o["unit"].alias("unit"))))
        best = met.select("point", hit.alias("hit")).groupBy("point").agg(F.min("hit").alias("hit"))
        found = held.unionByName(best.select("point", F.col("hit.unit").alias("unit"), F.col("hit.distance").alias("distance")))
    return points.select("point").join(found, "point", "left")


def placed_records(records: DataFrame, units: DataFrame, unit_geom: DataFrame, cell: float) -> DataFrame:
    """(record, unit, how, distance) for ``records(record, claimed, x, y)``.

    A record that claims a unit of ``units(unit)`` is there (``id``), whatever its place; outlines are drawn a little apart by
    different hands, so the id is the better witness. Others go to the outline that holds their point (``inside``), and to the
    nearest one if none does (``nearest``, with the distance). Without id and coordinates: unit null, how ``none``.
    """
    known = units.select(F.col("unit").alias("_unit")).distinct()
    met = records.join(known, F.col("claimed") == F.col("_unit"), "left")
    by_id = met.where(F.col("_unit").isNotNull()).select("record", F.col("_unit").alias("unit"), F.lit("id").alias("how"), F.lit(0.0).alias("distance"))
    others = met.where(F.col("_unit").isNull()).select(F.col("record").alias("point"), "x", "y")
    near = nearest_units(others, unit_geom, cell)
    how = F.when(F.col("unit").isNull(), "none").when(F.col("distance") > 0, "nearest").otherwise("inside")
    return by_id.unionByName(near.select(F.col("point").alias("record"), "unit", how.alias("how"), "distance"))


def claimed_elsewhere(records: DataFrame, units: DataFrame, unit_geom: DataFrame, cell: float) -> DataFrame:
    """(record, claimed, unit): records whose id names a unit and whose point lies in another, which ``placed_records`` overrules."""
    known = records.join(units.select(F.col("unit").alias("claimed")).distinct(), "claimed", "left_semi")
    at = nearest_units(known.select(F.col("record").alias("point"), "x", "y"), unit_geom, cell).where("distance = 0")
    return known.join(at, F.col("record") == F.col("point")).where("unit <> claimed").select("record", "claimed", "unit")


def summed_on_units(records: DataFrame, placed: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """(unit, *columns): sums of the records' columns on every unit, 0 where none fell.

    Sums on units must equal those of all records, null values counting as 0; else the records that were placed nowhere are
    named and the sums refused.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = records.select("record", *[zero(c).alias(c) for c in columns]).join(placed.select("record", "unit"), "record", "left")
    by = rows.groupBy("unit").agg(*[F.sum(c).alias(c) for c in columns])
    out = settle(units.select("unit").distinct().join(by, "unit", "left").select("unit", *[zero(c).alias(c) for c in columns]))
    total = lambda df: df.agg(*[zero_sum(c) for c in columns]).first()
    zero_sum = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    before, after = total(records.select(*columns)), total(out)
    if before != after:
        lost = [str(r["record"]) for r in rows.where(F.col("unit").isNull()).select("record").orderBy("record").limit(8).collect()]
        raise ValueError(f"sums on units {after.asDict()} differ from those of the records {before.asDict()}; records without a unit: {', '.join(lost) or 'none'}")
    return out
