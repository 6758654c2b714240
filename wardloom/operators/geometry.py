"""Compactness of districts.

``unit_geom(unit, area, perimeter, ring)`` holds a unit's area, perimeter and outline (array of struct x, y); ``edges`` the
length that two units share. Area and perimeter of a district are additive: the sum over its units, less twice the shared
lengths inside it. Reock and convex hull need the outline: corners are reduced to their hull where units lie, and only those of a
district's hulls meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NONE, Blocks, Range, of
from .graph import contacts

MEASURES = ("polsby_popper", "schwartzberg", "reock", "convex_hull")


def area_perimeter(assignments: DataFrame, unit_geom: DataFrame, edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(plan, district, area, perimeter); ``met`` are the ``contacts`` of the edges, if at hand."""
    if isinstance(assignments, Blocks):
        sums = assignments.sums(unit_geom, ["area", "perimeter"]).withColumnRenamed("perimeter", "outer").drop("units")
    else:
        sums = assignments.join(unit_geom.select("unit", "area", "perimeter"), "unit").groupBy("plan", "district").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("outer"))
    met = contacts(assignments, edges) if met is None else met
    inner = met.where("du = dv").select("plan", F.col("du").alias("district"), F.col("shared_len").alias("inner"))
    return sums.join(inner, ["plan", "district"], "left").select("plan", "district", "area", (F.col("outer") - 2 * F.coalesce("inner", F.lit(0.0))).alias("perimeter"))


def shape_ratios(parts: DataFrame) -> DataFrame:
    """(plan, district, polsby_popper, schwartzberg) of ``area_perimeter``; null without area or perimeter."""
    a, p = F.col("area"), F.col("perimeter")
    fine = (a > 0) & (p > 0)
    return parts.select("plan", "district", F.when(fine, 4 * math.pi * a / (p * p)).alias("polsby_popper"), F.when(fine, p / (2 * F.sqrt(math.pi * a))).alias("schwartzberg"))


def compactness_summary(ratios: DataFrame, measures: tuple[str, ...] = ("polsby_popper", "schwartzberg")) -> DataFrame:
    """Mean, least and most of each measure by plan."""
    return ratios.groupBy("plan").agg(*[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


#: Directions in which the outermost points are sought, and how many points make that worth while.
_TURNS = np.linspace(0, 2 * np.pi, 16, endpoint=False)
_WAYS = np.array([np.cos(_TURNS), np.sin(_TURNS)])
_MANY = 64


def _outer(pts: np.ndarray) -> np.ndarray:
    """Sorted points without those that can't be corners of their hull: between others of the same x, or well inside the polygon of
    the outermost points in sixteen directions."""
    new = pts[1:, 0] != pts[:-1, 0]
    pts = pts[np.concatenate([[True], new]) | np.concatenate([new, [True]])]
    if len(pts) < _MANY:
        return pts
    far = pts[(pts @ _WAYS).argmax(axis=0)]
    side = np.roll(far, -1, axis=0) - far
    far, side = far[here := (side != 0).any(axis=1)], side[here]
    if len(far) < 3:
        return pts
    slack = 1e-9 * float(np.abs(pts).max() + 1) * np.abs(side).max()
    inside = np.ones(len(pts), bool)
    for p, s in zip(far, side, strict=True):
        inside &= s[0] * (pts[:, 1] - p[1]) - s[1] * (pts[:, 0] - p[0]) > slack
    return pts[~inside]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise."""
    pts = np.unique(points, axis=0)
    if len(pts) >= _MANY:
        pts = _outer(pts)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def shoelace(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def bounding_circle(points: np.ndarray) -> float:
    """Radius of the smallest circle around points: grown from the farthest point until none lies outside."""
    pts = hull(points)
    if len(pts) < 2:
        return 0.0
    rng = np.random.default_rng(1)
    pts = pts[rng.permutation(len(pts))]

    def two(a, b):
        return (a + b) / 2, float(np.hypot(*(a - b))) / 2

    def three(a, b, c):
        d = 2 * ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if abs(d) < 1e-12:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda t: t[1])
        bb, cc = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        o = np.array([(c[1] - a[1]) * bb - (b[1] - a[1]) * cc, (b[0] - a[0]) * cc - (c[0] - a[0]) * bb]) / d
        return a + o, float(np.hypot(*o))

    inside = lambda p, c: np.hypot(*(p - c[0])) <= c[1] * (1 + 1e-12) + 1e-12
    circle = (pts[0], 0.0)
    for i in range(1, len(pts)):
        if inside(pts[i], circle):
            continue
        circle = (pts[i], 0.0)
        for j in range(i):
            if inside(pts[j], circle):
                continue
            circle = two(pts[i], pts[j])
            for k in range(j):
                if not inside(pts[k], circle):
                    circle = three(pts[i], pts[j], pts[k])
    return circle[1]


def _hulls(r: Range, table: pa.Table) -> pa.Table:
    """(plan, district, x, y): the hull of each district's corners in one range."""
    i, c = r.columns(table.column("unit").to_numpy())
    points = np.column_stack([table.column(k).to_numpy() for k in "xy"])[i]
    order = np.lexsort((points[:, 1], points[:, 0]))
    points, held = points[order], r.kinds[:, c[order]]
    kind, district, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for k in range(r.n):
        for d in np.unique(held[k]):
            if d > NONE:
                corners = hull(points[held[k] == d])
                kind.append(np.full(len(corners), k))
                district.append(np.full(len(corners), d))
                found.append(corners)
    kind, district, found = (np.concatenate(x) for x in (kind, district, found))
    i, plan = r.spread(kind)
    return pa.table({"plan": pa.array(plan, pa.int64()), "district": pa.array(district[i].astype(np.int32), pa.int32()), "x": pa.array(found[i, 0]), "y": pa.array(found[i, 1])})


def outline_measures(assignments: DataFrame | Blocks, unit_geom: DataFrame, edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(plan, district, reock, convex_hull): area over that of the smallest circle, and of the hull, around the outline.

    Corners are reduced to the hulls of ranges of units, and only those meet in the district, so no task holds all corners.
    """
    assignments = of(assignments)
    corners = unit_geom.select("unit", F.explode("ring").alias("p")).select("unit", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    outer = assignments.meet(assignments.by_unit(corners), _hulls, "plan long, district int, x double, y double")
    outer = outer.groupBy("plan", "district").agg(F.collect_set(F.struct("x", "y")).alias("points"))
    rows = outer.join(area_perimeter(assignments, unit_geom, edges, met).select("plan", "district", "area"), ["plan", "district"])

    def measure(batches):
        for b in batches:
            reock, convex = [], []
            for points, area in zip(b["points"], b["area"], strict=True):
                xy = np.array([(p["x"], p["y"]) for p in points], float)
                r, h = bounding_circle(xy), hull(xy)
                around = shoelace(h) if len(h) > 2 else 0.0
                reock.append(area / (math.pi * r * r) if r > 0 else None)
                convex.append(area / around if around > 0 else None)
            yield pd.DataFrame({"plan": b["plan"], "district": b["district"], "reock": pd.array(reock, "Float64"), "convex_hull": pd.array(convex, "Float64")})

    return rows.mapInPandas(measure, "plan long, district int, reock double, convex_hull double")
