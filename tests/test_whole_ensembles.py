"""Registered queries that take all 200 plans, on a small state, against brute force."""

from __future__ import annotations

import itertools
import json
import random
import re

import pytest

from wardloom.operators import administrative as adm
from wardloom.operators import geometry as geo
from wardloom.operators import graph as gr
from wardloom.operators import partisan as par
from wardloom.operators import reports
from wardloom.plans import catalog
from wardloom.plans.mapping import PLANS, State

N = 64


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("state"))
    spark.createDataFrame([(u, u % 5) for u in range(N)], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    orders = [(i, rng.randrange(N), rng.choice("FO")) for i in range(600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.fixture(scope="module")
def plans(spark, home):
    """Districts, edges and populations as plain Python."""
    s = State(spark, home)
    where: dict[int, dict[int, int]] = {}
    for r in s.assignments().collect():
        where.setdefault(r["plan"], {})[r["unit"]] = r["district"]
    assert len(where) == PLANS
    return where, [(r["u"], r["v"]) for r in s.edges().collect()], {r["unit"]: r["pop"] for r in s.units().collect()}


def moves_of(d, edges):
    return {(a, d[a], d[b]) for u, v in edges for a, b in ((u, v), (v, u)) if d[u] != d[v]}


def test_moves_of_all_plans(spark, home, plans):
    where, edges, pop = plans
    ideal, want = sum(pop.values()) / 8, {}
    for p, d in where.items():
        held = {k: sum(pop[u] for u in d if d[u] == k) for k in range(1, 9)}
        for u, a, b in moves_of(d, edges):
            want[p, u, a, b] = (held[a] - pop[u] - ideal) ** 2 + (held[b] + pop[u] - ideal) ** 2 - (held[a] - ideal) ** 2 - (held[b] - ideal) ** 2
    got = {(r["plan"], r["unit"], r["source"], r["target"]): r["delta"] for r in catalog.QUERIES["move_candidates"](spark, home).collect()}
    assert got == pytest.approx(want)


def test_swaps_of_all_plans(spark, home, plans):
    where, edges, _ = plans
    want = set()
    for p, d in where.items():
        moves = moves_of(d, edges)
        want |= {(p, u, v) for u, a, b in moves for v, x, y in moves if u < v and (a, b) == (y, x)}
    sets = catalog.QUERIES["swap_candidates"](spark, home).collect()
    units = lambda text: [int(u) for u in text.split(",")]
    rows = [(r["plan"], min(x, y), max(x, y)) for r in sets for x in units(r["units_a"]) for y in units(r["units_b"])]
    assert set(rows) == want and len(rows) == len(want) == sum(r["swaps"] for r in sets)
    s = State(spark, home)
    assert {tuple(r) for r in gr.swap_candidates(gr.move_candidates(s.assignments(), s.edges(), s.units(), 0.0)).collect()} == want


def test_components_of_all_plans(spark, home, plans):
    where, edges, _ = plans
    want = {}
    for p, d in where.items():
        label = {u: u for u in d}
        moved = True
        while moved:
            moved = False
            for u, v in edges:
                if d[u] == d[v] and label[u] != label[v]:
                    label[u] = label[v] = min(label[u], label[v])
                    moved = True
        want |= {(p, u): (d[u], label[u]) for u in d}
    got = {(r["plan"], r["unit"]): (r["district"], r["component"]) for r in catalog.QUERIES["connected_components"](spark, home).collect()}
    assert got == want


def test_outlines_of_all_plans(spark, home, plans):
    where, _, _ = plans
    got = {(r["plan"], r["district"]): (r["reock"], r["convex_hull"]) for r in catalog.QUERIES["reock_and_hull"](spark, home).collect()}
    assert set(got) == {(p, k) for p in range(PLANS) for k in range(1, 9)}
    for p in (19, 20, 199):
        for k in range(1, 9):
            units = [u for u in where[p] if where[p][u] == k]
            points = geo.np.array([(u % 50 + x, u // 50 + y) for u in units for x in (0, 1) for y in (0, 1)], float)
            circle = max(geo.np.hypot(*(a - b)) for a in points for b in points) / 2
            assert 0 < got[p, k][0] <= len(units) / (geo.math.pi * circle**2) + 1e-9
            assert got[p, k][1] == pytest.approx(len(units) / geo.shoelace(geo.hull(points)))


def test_places_and_reports_of_all_plans(spark, home):
    places = catalog.QUERIES["locate_all"](spark, home).collect()
    assert {(r["case_id"], r["metric"]) for r in places} == {(p, m) for p in range(PLANS) for m in catalog.METRICS} and len(places) == PLANS * len(catalog.METRICS)
    draws = {(r["plan"], r["metric"]): r["value"] for r in catalog._draws(State(spark, home)).collect()}
    for r in places:
        if r["status"] == "located" and r["case_id"] % 7 == 1:
            every = [v for (_, m), v in draws.items() if m == r["metric"] and v is not None]
            v = draws[r["case_id"], r["metric"]]
            assert r["percentile"] == pytest.approx((sum(x < v for x in every) + 0.5 * sum(x == v for x in every)) / len(every))
    by = {r["status"]: r["cases"] for r in catalog.QUERIES["locate_status"](spark, home).collect()}
    assert sum(by.values()) == PLANS * len(catalog.METRICS)
    reports = {r["plan"]: json.loads(r["report"]) for r in catalog.QUERIES["plan_reports"](spark, home).collect()}
    assert set(reports) == set(range(PLANS))
    assert all(len(x["locations"]) == len(catalog.METRICS) for x in reports.values())


def test_kinds_of_disagreement(spark):
    m = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 0.1, -0.1, 0.0)], "plan long, efficiency_gap double, mean_median double, declination double")
    trusted = spark.createDataFrame([(p, ["efficiency_gap", "mean_median", "declination", "partisan_bias"]) for p in (1, 2)], "plan long, trusted array<string>")
    bare = spark.createDataFrame([(0, None), (1, None)], "unit long, parent long")
    full = spark.createDataFrame([(0, 7), (1, 7)], "unit long, parent long")
    shapes = spark.createDataFrame([(1, 0.3, 0.6, 0.5), (2, 0.3, 0.4, 0.4)], "plan long, polsby_popper double, reock double, convex_hull double")
    got = {(r["plan"], r["kind"]): r["metrics"] for r in reports.disagreements(m, trusted, shapes, adm.degeneracy(full), {"city": bare, "county": full}).collect()}
    assert got == {
        (1, "compactness_measures_disagree"): ["polsby_popper", "reock", "convex_hull"],
        (2, "partisan_metrics_disagree_in_sign"): ["efficiency_gap", "mean_median"],
        **{(p, "metrics_constant_by_construction"): ["ballot_styles"] for p in (1, 2)},
        **{(p, "subdivision_layer_is_empty_on_these_units"): ["city"] for p in (1, 2)},
    }


def test_disagreements_of_all_kinds(spark, home):
    rows = catalog.QUERIES["plan_disagreements_all"](spark, home).collect()
    shape = {r["plan"]: r["magnitude"] for r in rows if r["kind"] == "compactness_measures_disagree"}
    assert shape and min(shape.values()) > reports.COMPACTNESS_SPREAD
    assert {r["plan"] for r in rows if r["kind"] == "metrics_constant_by_construction"} == set(range(PLANS))


def test_plans_are_never_taken_for_a_small_table(spark):
    state = State(spark, "/root/testdata/sf0.001")
    rows = state.assignments()
    assert rows.count() == state.n * PLANS
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= state.n * PLANS * 8


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_meet_the_plans_once_for_both_ends(spark):
    state = State(spark, "/root/testdata/sf0.001")
    assert len(re.findall(r"Generate explode", _planned(gr.boundary_units(state.assignments(), state.edges())))) == 1


def test_reports_and_layers_move_no_rows_of_plans_by_unit(spark):
    state = State(spark, "/root/testdata/sf0.001")
    moved = r"hashpartitioning\((plan#\d+L?, unit#|unit#\d+L?, (plan|block)#)"
    assert not re.search(moved, _planned(adm.admin_report(state.assignments(), state.membership())))
    assert not re.search(moved, _planned(adm.ballot_styles([state.assignments(), state.layer2()])))


def test_layers_of_other_orders_holes_and_repeated_units(spark):
    frame = lambda rows: spark.createDataFrame(rows, "plan long, unit long, district int")
    a = [(p, u, u // 3) for p in range(5, -1, -1) for u in range(9)] + [(1, 1, 7)]
    b = [(p, u, (u + p) % 4) for p in range(6) for u in range(9) if (p, u) != (2, 3)] + [(1, 1, 3)]
    third = [(p, u, u % 2) for p in (3, 1, 2) for u in range(9)]
    for layers in ([a, b], [a, b, third]):
        found = {}
        for p in {r[0] for r in layers[-1]}:
            units = [[(u, d) for q, u, d in rows if q == p] for rows in layers]
            found[p] = len({tuple(d for _, d in x) for x in itertools.product(*units) if len({u for u, _ in x}) == 1})
        assert {r["plan"]: r["ballot_styles"] for r in adm.ballot_styles([frame(x) for x in layers]).collect()} == found


def test_held_units_move_no_rows_of_plans_by_unit(spark, monkeypatch):
    state, seen = State(spark, "/root/testdata/sf0.001"), []
    monkeypatch.setattr(par, "refuse", lambda rows, *_: seen.append(_planned(rows)))
    par.require_same_units(state.assignments(), state.votes())
    assert seen and not re.search(r"hashpartitioning\(plan#\d+L?, unit#", seen[0])
