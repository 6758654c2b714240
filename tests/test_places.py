"""Nearest outlines, shared areas, outlines of districts and joins by name, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wardloom.operators import graph as gr
from wardloom.operators import nearest, polygons
from wardloom.sources import names
from wardloom.sources.tables import InvalidTable

RING = "array<struct<x: double, y: double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, w=1.0):
    return ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))


def inside(points, x, y):
    n, odd = len(points), False
    for i in range(n):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % n]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def distance(points, x, y):
    if inside(points, x, y):
        return 0.0
    best = math.inf
    for i in range(len(points)):
        (ax, ay), (bx, by) = points[i], points[(i + 1) % len(points)]
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        best = min(best, math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
    return best


def test_nearest_outline_whatever_the_distance(spark):
    rng, cell = random.Random(3), 1.2
    stars = {}
    for u in range(25):
        cx, cy = rng.uniform(0, 12), rng.uniform(0, 12)
        stars[u] = [(cx + rng.uniform(0.2, 1.5) * math.cos(a), cy + rng.uniform(0.2, 1.5) * math.sin(a)) for a in np.arange(7) * 2 * math.pi / 7]
    points = [(i, rng.uniform(-3, 15), rng.uniform(-3, 15)) for i in range(60)] + [(60 + i, 60.0 * (i - 2) + 7, -30.0 * i) for i in range(5)] + [(90, None, 1.0), (91, float("nan"), 1.0)]
    geom = spark.createDataFrame([(u, ring(*p)) for u, p in stars.items()], f"unit long, ring {RING}")
    got = {r["point"]: (r["unit"], r["distance"]) for r in nearest.nearest_units(spark.createDataFrame(points, "point long, x double, y double"), geom, cell).collect()}
    assert got[90] == got[91] == (None, None) and len(got) == len(points)
    for i, x, y in points[:65]:
        want = min((distance(p, x, y), u) for u, p in stars.items())
        assert got[i][1] == pytest.approx(want[0]) and distance(stars[got[i][0]], x, y) == pytest.approx(want[0])
    nothing = nearest.nearest_units(spark.createDataFrame(points, "point long, x double, y double"), geom.limit(0), cell).collect()
    assert len(nothing) == len(points) and all(r["unit"] is None for r in nothing)


def test_records_by_id_then_outline_then_nearest(spark):
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit long")
    geom = spark.createDataFrame([(1, square(0, 0)), (2, square(1, 0)), (3, square(5, 5))], f"unit long, ring {RING}")
    rows = [(1, 2, 0.5, 0.5, 5), (2, 9, 0.5, 0.5, 7), (3, None, 4.0, 4.0, 1), (4, None, 1.5, 0.2, None)]
    records = spark.createDataFrame(rows, "record long, claimed long, x double, y double, dem long")
    placed = nearest.placed_records(records, units, geom, 1.0)
    assert {r["record"]: (r["unit"], r["how"]) for r in placed.collect()} == {1: (2, "id"), 2: (1, "inside"), 3: (3, "nearest"), 4: (2, "inside")}
    assert [(r["record"], r["claimed"], r["unit"]) for r in nearest.claimed_elsewhere(records, units, geom, 1.0).collect()] == [(1, 2, 1)]
    assert {r["unit"]: r["dem"] for r in nearest.summed_on_units(records, placed, units, ["dem"]).collect()} == {1: 7, 2: 5, 3: 1}
    lost = records.unionByName(spark.createDataFrame([(5, None, None, None, 4)], records.schema))
    with pytest.raises(ValueError, match="without a unit: 5"):
        nearest.summed_on_units(lost, nearest.placed_records(lost, units, geom, 1.0), units, ["dem"])


def clipped(subject, clip):
    """Area of a polygon cut by a convex one running counter-clockwise, side by side."""
    out = subject
    for i in range(len(clip)):
        (ax, ay), (bx, by) = clip[i], clip[(i + 1) % len(clip)]
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        new = []
        for j, p in enumerate(out):
            q = out[(j + 1) % len(out)]
            if side(p) >= 0:
                new.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = new
        if not out:
            return 0.0
    return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(out, out[1:] + out[:1], strict=True))) / 2


def test_shared_areas_of_bent_and_holed_polygons(spark):
    rng = random.Random(5)
    star = lambda cx, cy, n, low: [(cx + rng.uniform(low, 2) * math.cos(a), cy + rng.uniform(low, 2) * math.sin(a)) for a in (np.arange(n) + rng.random()) * 2 * math.pi / n]
    bent = {u: star(rng.uniform(0, 6), rng.uniform(0, 6), 9, 0.4) for u in range(12)}
    boxes = {z: [(x, y), (x + 2.5, y - 0.5), (x + 2.9, y + 2.2), (x - 0.3, y + 2.0)] for z, (x, y) in enumerate((rng.uniform(-1, 6), rng.uniform(-1, 6)) for _ in range(12))}
    hole = lambda p: [(sum(x for x, _ in p) / 4 + 0.3 * (x - sum(x for x, _ in p) / 4), sum(y for _, y in p) / 4 + 0.3 * (y - sum(y for _, y in p) / 4)) for x, y in p]
    units = spark.createDataFrame([(u, [ring(*p)]) for u, p in bent.items()] + [(99, [])], f"unit long, rings array<{RING}>")
    zones = spark.createDataFrame([(f"z{z}", [ring(*p), ring(*hole(p))]) for z, p in boxes.items()], f"zone string, rings array<{RING}>")
    want = {(u, f"z{z}"): a for u, p in bent.items() for z, q in boxes.items() if (a := clipped(p, q) - clipped(p, hole(q))) > 1e-9}
    for tile in (0.6, 4.0):
        rows = polygons.overlay(units, zones, tile).collect()
        assert {(r["unit"], r["zone"]): r["area"] for r in rows if r["area"] > 1e-9} == pytest.approx(want)
    area = {u: clipped(p, [(-9, -9), (20, -9), (20, 20), (-9, 20)]) for u, p in bent.items()}
    assert all(r["share"] == pytest.approx(r["area"] / area[r["unit"]]) for r in rows)
    one = polygons.overlay(units, zones.where("zone = 'z0'"), 4.0)
    for r in polygons.uncovered(units, one).collect():
        assert r["outside"] == pytest.approx(area.get(r["unit"], 0.0) - want.get((r["unit"], "z0"), 0.0), abs=1e-9)


def pieces(cells, corners):
    """Connected sets of grid cells, with or without touching corners."""
    left, out = set(cells), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            x, y = todo.pop()
            seen.append((x, y))
            near = [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
            todo += [c for c in near if c in left]
            left -= set(near)
        out.append(seen)
    return out


def test_outlines_with_islands_holes_and_touching_corners(spark):
    rng, w = random.Random(8), 7
    plans = {p: {(x, y): rng.randrange(1, 4) for x in range(w) for y in range(w)} for p in range(4)}
    plans[4] = {(x, y): 1 + (1 <= x < 6 and 1 <= y < 6 and (x, y) != (3, 3)) for x in range(w) for y in range(w)}
    plans[300] = {(x, y): 1 for x in range(w) for y in range(w)}
    rows = [(p, x * w + y, d) for p, cells in plans.items() for (x, y), d in cells.items() if not (p == 2 and (x, y) == (4, 4))]  # plan 2 lacks a unit
    del plans[2][4, 4]
    flip = lambda u, points: points[::-1] if u % 2 else points  # noqa: E731  either direction will do
    geom = spark.createDataFrame([(x * w + y, flip(x * w + y, square(x, y))) for x in range(w) for y in range(w)], f"unit long, ring {RING}")
    got: dict = {}
    rings = polygons.dissolve(spark.createDataFrame(rows, "plan long, unit long, district int"), geom)
    for r in rings.collect():
        points = [(p["x"], p["y"]) for p in r["points"]]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(points, points[1:] + points[:1], strict=True))
        assert r["area"] == pytest.approx(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2)
        got.setdefault((r["plan"], r["district"]), []).append(r["area"])
    for p, cells in plans.items():
        for d in set(cells.values()):
            own = {c for c, k in cells.items() if k == d}
            rest = {(x, y) for x in range(-1, w + 1) for y in range(-1, w + 1)} - own
            holes = [h for h in pieces(rest, True) if (-1, -1) not in h]
            found = got.pop((p, d))
            assert sorted(a for a in found if a > 0) == sorted(len(c) + cut_off(c) for c in pieces(own, False))
            assert sorted(-a for a in found if a < 0) == sorted(len(h) + cut_off(h, False) for h in holes) and sum(found) == len(own)
    assert not got
    shares = polygons.overlay(polygons.outlines(rings.where("plan = 4")).select(F.col("district").alias("unit"), "rings"), spark.createDataFrame([(1, [square(0, 0, 4.0)])], f"zone long, rings array<{RING}>"), 3.0)
    assert {r["unit"]: r["area"] for r in shares.collect()} == {1: 8.0, 2: 8.0}


def cut_off(part, corners=True):
    """How many cells a connected set keeps from the edge."""
    cells = {(x, y) for x in range(-1, 8) for y in range(-1, 8)} - set(part)
    return sum(len(h) for h in pieces(cells, corners) if (-1, -1) not in h)


def test_edges_of_plans_that_leave_units_out(spark):
    rng = random.Random(1)
    rows = [(p, u, rng.randrange(3)) for p in (0, 1, 2, 255, 256, 700) for u in range(12) if rng.random() < 0.8]
    edges = [(u, v, 1.0) for u in range(12) for v in range(u + 1, 12) if rng.random() < 0.4]
    at = {(p, u): d for p, u, d in rows}
    want: dict = {}
    for p in {p for p, _, _ in rows}:
        for u, v, s in edges:
            if (p, u) in at and (p, v) in at:
                n, total = want.get((p, at[p, u], at[p, v]), (0, 0.0))
                want[p, at[p, u], at[p, v]] = (n + 1, total + s)
    got = gr.contacts(spark.createDataFrame(rows, "plan long, unit long, district int"), spark.createDataFrame(edges, "u long, v long, shared_len double"))
    assert {(r["plan"], r["du"], r["dv"]): (r["edges"], r["shared_len"]) for r in got.collect()} == want


def test_names_meet_and_refusals_name_them(spark):
    units = spark.createDataFrame([(1, "Adair County"), (2, "O'Brien County"), (3, "Van Buren County")], "unit long, name string")
    rows = [("ADAIR", 3, 1), (" o brien", 2, None), ("OBrien county", 5, 1), ("VanBuren", 0, 0)]
    records = spark.createDataFrame(rows, "name string, dem long, rep long")
    got = names.summed_by_name(units, records, ["dem", "rep"], {"dem": 10, "rep": 2})
    assert {r["unit"]: (r["dem"], r["rep"]) for r in got.collect()} == {1: (3, 1), 2: (7, 1), 3: (0, 0)}
    assert [(r["key"], r["spellings"]) for r in names.name_collisions(records.select("name")).collect()] == [("OBRIEN", 2)]
    with pytest.raises(InvalidTable, match="sums .*9"):
        names.summed_by_name(units, records, ["dem", "rep"], {"dem": 9})
    with pytest.raises(InvalidTable, match="records of no unit: Polk"):
        names.summed_by_name(units, records.unionByName(spark.createDataFrame([("Polk", 1, 1)], records.schema)), ["dem", "rep"])
    with pytest.raises(InvalidTable, match="units without records: Van Buren County"):
        names.summed_by_name(units, records.where("name <> 'VanBuren'"), ["dem", "rep"])
    with pytest.raises(InvalidTable, match="units of one name"):
        names.summed_by_name(units.unionByName(spark.createDataFrame([(4, "ADAIR")], units.schema)), records, ["dem", "rep"])
    with pytest.raises(InvalidTable, match="records of no unit"):
        names.summed_by_name(units, records.unionByName(spark.createDataFrame([(None, 1, 1)], records.schema)), ["dem"])


@pytest.mark.parametrize("name", ["placed_votes", "polygon_overlay", "area_outside_zones", "dissolved_districts", "articulation_units", "legality_with_contiguity", "null_cases", "anchor_starts", "county_sums_by_name"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert [x.replace("np.", "") for x in key(got)] == [x.replace("np.", "") for x in key(want)]


def test_cases_are_written_with_a_manifest(spark, tmp_path):
    from wardloom.operators import contexts
    from wardloom.sources import tables

    rows = [(p, f"{u:03d}", u * (p + 1) % 3 + 1) for p in range(3) for u in range(6)]
    plans = spark.createDataFrame(rows, "plan long, unit string, district int")
    manifest = tables.write_cases(plans, str(tmp_path / "cases"))
    assert {r["plan"]: (r["units"], r["digest"]) for r in manifest.collect()} == {r["plan"]: (6, r["digest"]) for r in gr.plan_digest(plans).collect()}
    assert sorted(map(tuple, tables.read_cases(spark, str(tmp_path / "cases")).collect())) == sorted(rows)
    tables.write_plans(plans.withColumn("district", F.when(F.col("plan") == 1, 1).otherwise(F.col("district"))), str(tmp_path / "cases" / "plans"))
    with pytest.raises(InvalidTable, match="manifest.*1"):
        tables.read_cases(spark, str(tmp_path / "cases"))
    units = spark.createDataFrame([("19001", 5), ("19003", 6)], "unit string, pop long")
    votes = spark.createDataFrame([("19001", 1, 2), ("19003", 3, 4)], "unit string, dem long, rep long")
    got = contexts.analysis_context(units, units, {"a": votes})
    assert {r["parent"] for r in got["counties"].collect()} == {"19001", "19003"} and got["votes_a"] is votes
    with pytest.raises(ValueError, match="contest a .* 19003"):
        contexts.analysis_context(units, units, {"a": votes.limit(1)})


def test_contexts_meet_locations(spark):
    from wardloom.operators import contexts

    context = spark.createDataFrame([(1, "a", False, "why"), (1, "b", True, None)], "plan long, metric string, usable boolean, reason string")
    places = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case_id long, metric string")
    got = {(r["case_id"], r["metric"]): (r["trusted"], r["reason"]) for r in contexts.usable_locations(places, context).collect()}
    assert got == {(1, "a"): (False, "why"), (1, "b"): (True, None), (2, "a"): (True, None)}


def test_polygons_are_dealt_to_all_tasks(spark):
    square = lambda k: [[(x, y) for x, y in ((k, 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0), (k, 1.0))]]
    shape = "rings array<array<struct<x double, y double>>>"
    units = spark.createDataFrame([(i, square(float(i))) for i in range(64)], f"unit long, {shape}").coalesce(1)
    zones = spark.createDataFrame([(i, square(i + 0.5)) for i in range(64)], f"zone long, {shape}").coalesce(1)
    assert polygons.polygon_areas(units, "unit").select(F.spark_partition_id()).distinct().count() == 4
    got = polygons.overlay(units, zones, tile=5.0)
    assert {(r["unit"], r["zone"]): r["share"] for r in got.collect()} == {(i, z): 0.5 for i in range(64) for z in (i - 1, i) if z >= 0}
    assert "repartition" in got._jdf.queryExecution().analyzed().toString().lower()


def test_searches_move_cells_and_not_points(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(nearest, "settle", lambda df, f=nearest.settle: kept.append(f(df)) or kept[-1])
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    geom = spark.createDataFrame([(1, ring), (2, [(x + 1, y) for x, y in ring])], "unit long, ring array<struct<x double, y double>>")
    points = spark.range(2000).selectExpr("id as point", "30.0 + id / 4000.0 as x", "0.5D as y")
    got = nearest.nearest_units(points, geom, 1.0)
    assert [df.count() for df in kept if "start" in df.columns] == [1]  # all points are in one cell
    assert {(r["unit"], round(r["distance"] - 28 - r["point"] / 4000, 9)) for r in got.collect()} == {(2, 0.0)}
