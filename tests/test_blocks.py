"""Plans packed by ranges of units, against the same operators over rows and against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardloom.operators import blocks, components, forest, polygons, spatial
from wardloom.operators import geometry as geo
from wardloom.operators import graph as gr
from wardloom.operators import partisan as par
from wardloom.plans import bench
from wardloom.plans.mapping import State

WIDTH, N = 12, 180


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Some ten units in a range."""
    monkeypatch.setattr(blocks, "CELLS", 20 * blocks.PLAN_BLOCK)
    monkeypatch.setattr(blocks, "CHUNK", 300)


@pytest.fixture(scope="module")
def state(spark):
    """A grid of squares, some far pairs, and plans that leave units out, hold one twice, or have a null district."""
    rng = random.Random(8)
    edges = [(u, v, rng.choice([0.5, 1.0, None])) for u in range(N) for v in (u + 1, u + WIDTH) if v < N and (v > u + 1 or v % WIDTH)]
    edges += [(3, 170, 2.0), (170, 90, None), (7, 7, 1.0), (5, 999, 1.0)]
    rows = []
    for p in (0, 1, 2, 3, 40, 300, 301, 700):
        cut = [rng.randrange(N) for _ in range(3)]
        rows += [(p, u, 7 if rng.random() < 0.06 else 1 + sum(u >= c for c in cut)) for u in range(N) if p < 3 or rng.random() < 0.95]
    rows += [(1, u, d) for u, d in ((4, 9), (4, 9), (100, 2))] + [(2, N, None), (2, N + 1, 1)]
    ring = lambda u: [(float(u % WIDTH + x), float(u // WIDTH + y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    geom = [(u, 1.0 + u / 8, 4.0, ring(u)) for u in range(N)]
    units = [(u, rng.randrange(9) if u % 11 else None, u % 5, u % 3) for u in range(N + 3)]
    rng.shuffle(rows)
    return (
        spark.createDataFrame(rows, "plan long, unit long, district int").repartition(3),
        spark.createDataFrame(edges, "u long, v long, shared_len double"),
        spark.createDataFrame(geom, "unit long, area double, perimeter double, ring array<struct<x:double,y:double>>"),
        spark.createDataFrame(units, "unit long, pop long, dem long, rep long"),
        rows,
    )


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def settled(monkeypatch, *modules):
    kept = []
    for m in modules:
        monkeypatch.setattr(m, "settle", lambda df, f=components.settle: kept.append(f(df)) or kept[-1])
    return kept


def test_packed_plans_give_the_same_rows(state):
    a, e, g, units, _ = state
    b = blocks.of(a)
    assert b.frame.select("part").distinct().count() > 5 and b.keys.select("block").distinct().count() == 3
    for f in (lambda x: gr.contacts(x, e), lambda x: gr._sides(x, e), lambda x: par.district_votes(x, units), lambda x: gr.legality(x, units, 3, 0.1), lambda x: gr.canonical_key(x), lambda x: geo.area_perimeter(x, g, e), lambda x: gr.move_candidates(x, e, units, 3.0)):
        assert rows_of(f(b)) == rows_of(f(a)) and f(b).dtypes == f(a).dtypes
    for f in (lambda x: gr.contacts(x, e), lambda x: par.district_votes(x, units), lambda x: gr.canonical_key(x)):
        assert f(blocks.of(a.limit(0))).count() == 0


@pytest.mark.parametrize("most", [256, 1000])
def test_null_cases_order_plans_by_places_in_ranges(spark, state, most):
    rows = list({r[:2]: r for r in state[4] if r[0] < most}.values())
    order = blocks.of(spark.createDataFrame(rows, "plan long, unit long, district int")).order()
    assert order.agg(F.max(F.size("order"))).first()[0] < N // 3  # less than a number a unit
    got = [r["plan"] for r in order.orderBy("order").collect()]
    held = {p: {u: d or -1 for q, u, d in rows if q == p} for p in {r[0] for r in rows}}
    assert got == sorted(held, key=lambda p: [held[p].get(u, 99) for u in range(N + 2)])


def test_null_scenarios_keep_orders_short(spark, monkeypatch):
    pool = []
    monkeypatch.setattr(State, "once", lambda self, name, make, f=State.once: pool.append(f(self, name, make)) or pool[-1])
    got = bench.null_scenarios(State(spark, "/root/testdata/sf0.001"))
    assert got.columns == ["case_id", "kind", "shift", "in_gate_sample"]
    kept = [df for df in pool if "order" in df.columns]
    assert kept and all(df.count() == 200 and df.agg(F.max(F.size("order"))).first()[0] < 150 // 3 for df in kept)  # before, a number a unit


def brute(rows, edges):
    """{(plan, unit): smallest unit of its part}; a unit in two districts joins them."""
    out = {}
    for p in {r[0] for r in rows}:
        held: dict = {}
        for q, u, d in rows:
            if q == p:
                held.setdefault(u, set()).add(d)
        root = {u: u for u in held}
        moved = True
        while moved:
            moved = False
            for u, v in edges:
                if u in held and v in held and (held[u] & held[v]) - {None} and root[u] != root[v]:
                    root[u] = root[v] = min(root[u], root[v])
                    moved = True
        out |= {(p, u): root[u] for u in held}
    return out


def test_connected_components_send_borders_only(state, monkeypatch):
    a, e, _, _, rows = state
    kept = settled(monkeypatch, components)
    nowhere = a.limit(1).selectExpr("CAST(NULL AS long) AS plan", "unit", "district")
    got = gr.components(a.unionByName(nowhere), e).collect()
    want = brute(rows, [(r["u"], r["v"]) for r in e.collect()])
    assert {(r["plan"], r["unit"]): r["component"] for r in got if r["plan"] is not None} == want
    assert len(got) == len(rows) + 1 and [r["component"] == r["unit"] for r in got if r["plan"] is None] == [True]
    assert kept and max(df.count() for df in kept) < len(rows) // 2  # before, an edge for each unit of each plan


def test_pieces_by_contact_walk_joined_units(state, monkeypatch):
    a, e, g, _, rows = state
    kept = settled(monkeypatch, forest)
    rook, queen = spatial.rook_edges(g), spatial.queen_edges(g)
    got = {(r["plan"], r["district"]): (r["rook"], r["queen"]) for r in spatial.pieces_by_contact(a, rook, queen).collect()}
    pieces = lambda edges: {(r["plan"], r["district"]): r["n"] for r in forest.spanning_forest(a, edges).groupBy("plan", "district").agg(F.count_if(F.col("parent").isNull()).alias("n")).collect()}
    left, right = pieces(rook.select("u", "v")), pieces(queen)
    assert got == {k: (left[k], right[k]) for k in left if k[1] is not None}
    assert len(kept) == 2 and all(df.select("plan", "district", "u").distinct().count() < len(rows) // 2 for df in kept)


def test_legal_moves_walk_boundaries(state):
    a, e, _, units, _ = state
    a, moves = a.where("district IS NOT NULL").dropDuplicates(["plan", "unit"]), None
    whole, less = forest.spanning_forest(a, e), forest.spanning_forest(a, e, nodes="boundary")
    assert less.count() < whole.count() * 0.8
    moves = gr.move_candidates(a, e, units.fillna(1), 3.0)
    want, got = (forest.legal_moves(moves, f) for f in (whole, less))
    assert rows_of(got) == rows_of(want) and got.where("NOT legal").count() > 5
    assert rows_of(gr.contiguity(forest.parts(less))) == rows_of(gr.contiguity(forest.parts(whole)))
    with pytest.raises(ValueError, match="nodes are"):
        forest.spanning_forest(a, e, nodes="other")


def test_reock_and_hull_reduce_corners_where_units_lie(state):
    a, e, g, _, rows = state
    found = geo.outline_measures(a, g, e)
    got = {(r["plan"], r["district"]): (r["reock"], r["convex_hull"]) for r in found.collect()}
    area = {(r["plan"], r["district"]): r["area"] for r in geo.area_perimeter(a, g, e).collect()}
    corners = lambda u: [(float(u % WIDTH + x), float(u // WIDTH + y)) for x in (0, 1) for y in (0, 1)]
    for p, d in {(p, d) for p, u, d in rows if d is not None}:
        points = geo.np.array([c for q, u, k in rows if (q, k) == (p, d) and u < N for c in corners(u)], float)
        r = geo.bounding_circle(points)
        assert got[p, d] == pytest.approx((area[p, d] / (geo.math.pi * r * r), area[p, d] / geo.shoelace(geo.hull(points))))
    assert "_group_hull" not in found._jdf.queryExecution().toString()  # before, all corners of all plans were shuffled


def test_hulls_lose_no_corner():
    rng = geo.np.random.default_rng(3)
    for points in (rng.normal(size=(500, 2)), rng.integers(0, 9, (500, 2)).astype(float), geo.np.column_stack([geo.np.arange(200.0), 3 * geo.np.arange(200.0)]), rng.normal(size=(300, 2)) * [1, 1e-7] + 1e3):
        many, geo._MANY = geo._MANY, 10**9
        try:
            want = geo.hull(points)
        finally:
            geo._MANY = many
        assert geo.np.array_equal(geo.hull(points), want)


def test_plan_disagreements_need_no_rows_of_plans_moved(state):
    a, e, g, _, _ = state
    met = gr.contacts(blocks.of(a), e)
    plan = met._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "cogroup" in plan.lower()
    got = geo.outline_measures(blocks.of(a), g, e, met)
    assert rows_of(got) == rows_of(geo.outline_measures(a, g, e))


def test_dissolved_districts_are_followed_at_once(state, spark, monkeypatch):
    a, _, g, _, rows = state
    a = a.where("plan < 3 AND district IS NOT NULL AND unit < 180").dropDuplicates(["plan", "unit"])
    kept = settled(monkeypatch, polygons)
    got = polygons.dissolve(a, g).collect()
    assert len(kept) == 1  # before, once more for each doubling of the longest ring
    held = {(r["plan"], r["unit"]): r["district"] for r in a.collect()}
    sides: dict = {}
    for (p, u), d in held.items():
        x, y = u % WIDTH, u // WIDTH
        for s, v in ((((x, y), (x + 1, y)), u - WIDTH), (((x + 1, y), (x + 1, y + 1)), u + 1 if x < WIDTH - 1 else -1), (((x + 1, y + 1), (x, y + 1)), u + WIDTH), (((x, y + 1), (x, y)), u - 1 if x else -1)):
            if held.get((p, v)) != d:
                sides.setdefault((p, d), []).append(s)
    found: dict = {}
    for r in got:
        ring = [(q["x"], q["y"]) for q in r["points"]]
        assert ring == list(dict.fromkeys(ring)) or len(ring) > 4
        found.setdefault((r["plan"], r["district"]), []).extend(zip(ring, ring[1:] + ring[:1], strict=True))
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        assert r["area"] == turn
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in sides.items()}
    polygons_of = polygons.outlines(polygons.dissolve(a, g))
    assert polygons_of.count() == len(sides)
    monkeypatch.setattr(polygons, "MOST_SIDES", 3)
    with pytest.raises(ValueError, match="at most 3"):
        polygons.dissolve(a, g)


def test_units_meet_again_across_chunks(spark):
    rows = [(p, u, p % 3 + 1) for u in range(90) for p in range(7)]
    for order in (rows, sorted(rows)):
        b = blocks.of(spark.createDataFrame(order, "plan int, unit int, district long").coalesce(1))
        one = spark.range(90).selectExpr("id AS unit", "1 AS one")
        assert {tuple(r) for r in b.sums(one, ["one"]).collect()} == {(p, p % 3 + 1, 90, 90) for p in range(7)}
        assert b.sums(one, ["one"]).dtypes[0] == ("plan", "int")
    with pytest.raises(ValueError, match="whole numbers"):
        blocks.of(spark.createDataFrame([("a", 1, 1)], "plan string, unit long, district int"))
