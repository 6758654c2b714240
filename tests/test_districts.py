"""Subdivisions, graphs, geometry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from wardloom.operators import administrative as adm
from wardloom.operators import geometry as geo
from wardloom.operators import graph as gr

ASSIGN = "plan long, unit long, district int"


@pytest.fixture(scope="module")
def counties(spark):
    """Ten counties of four precincts; three plans that cut some of them, and two that cut none."""
    cuts = {0: {0: [1, 2, 3, 4]}, 1: {c: [1, 1, 2, 2] for c in range(3)}, 2: {c: [1, 1, 2, 3] for c in range(2)}, 3: {}}
    rows = [(p, c * 4 + i, (cut.get(c) or [1 + c % 4] * 4)[i]) for p, cut in cuts.items() for c in range(10) for i in range(4)]
    return spark.createDataFrame(rows, ASSIGN), spark.createDataFrame([(u, u // 4) for u in range(40)], "unit long, parent long")


def test_splits(counties):
    got = {r["plan"]: (r["county_splits"], r["split_pieces"], r["excess_pieces"]) for r in adm.split_metrics(*counties).collect()}
    assert got == {0: (1, 13, 3), 1: (3, 13, 3), 2: (2, 14, 4), 3: (0, 10, 0)}


def test_ballot_styles(counties, spark):
    a, m = counties
    one = {r["plan"]: r["ballot_styles"] for r in adm.ballot_styles([a]).collect()}
    assert one[3] == 4
    by = {r["plan"]: r["ballot_styles"] for r in adm.ballot_styles([a], m).collect()}
    assert by == {0: 13, 1: 13, 2: 14, 3: 10}
    cong = spark.createDataFrame([(0, u, d) for u, d in enumerate([1, 1, 1, 2, 2, 2])], ASSIGN)
    senate = spark.createDataFrame([(0, u, d) for u, d in enumerate([1, 2, 1, 2, 3, 3])], ASSIGN)
    assert adm.ballot_styles([cong, senate]).first()["ballot_styles"] == 4
    holes = spark.createDataFrame([(0, None), (1, 5)], "unit long, parent long")
    assert adm.ballot_styles([cong], holes).first()["ballot_styles"] is None


def grid(side):
    e = [(r * side + c, r * side + c + 1, 1.0) for r in range(side) for c in range(side - 1)] + [(r * side + c, r * side + c + side, 1.0) for r in range(side - 1) for c in range(side)]
    geom = [(r * side + c, 1.0, 4.0, [(float(c + x), float(r + y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]) for r in range(side) for c in range(side)]
    return e, geom


@pytest.fixture(scope="module")
def square(spark):
    e, geom = grid(4)
    halves = [(0, u, 1 if u % 4 < 2 else 2) for u in range(16)]
    stripe = [(1, u, 1 if u < 4 else 2) for u in range(16)]
    ell = [(2, u, 1 if u < 4 or u % 4 == 0 and u < 12 else 2) for u in range(16)]
    split = [(3, u, 1 if u in (0, 15) else 2) for u in range(16)]
    return (
        spark.createDataFrame(halves + stripe + ell + split, ASSIGN),
        spark.createDataFrame(e, "u long, v long, shared_len double"),
        spark.createDataFrame(geom, "unit long, area double, perimeter double, ring array<struct<x:double,y:double>>"),
        spark.createDataFrame([(u, 10) for u in range(16)], "unit long, pop long"),
    )


def test_cuts_and_compactness(square):
    a, e, g, _ = square
    assert e.count() == 24
    cuts = {r["plan"]: r["cut_edges"] for r in gr.cut_edges(a, e).collect()}
    assert (cuts[0], cuts[1]) == (4, 4)
    means = {r["plan"]: r["polsby_popper_mean"] for r in geo.compactness_summary(geo.shape_ratios(geo.area_perimeter(a, g, e))).collect()}
    assert means[0] == pytest.approx(0.6981, abs=1e-4)
    assert means[1] == pytest.approx((4 * math.pi * 4 / 100 + 4 * math.pi * 12 / 196) / 2)
    hulls = {(r["plan"], r["district"]): r for r in geo.outline_measures(a, g, e).collect()}
    assert hulls[0, 1]["convex_hull"] == pytest.approx(1) and hulls[2, 1]["convex_hull"] < 1
    assert hulls[0, 1]["reock"] == pytest.approx(8 / (math.pi * 5))


def test_circle_and_hull():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 40):
        p = rng.normal(size=(n, 2))
        r = geo.bounding_circle(p)
        # no circle through two or three of the points that holds all is smaller
        best = min(
            (rad for i in range(n) for j in range(i) for rad, c in [(np.hypot(*(p[i] - p[j])) / 2, (p[i] + p[j]) / 2)] if (np.hypot(*(p - c).T) <= rad + 1e-9).all()),
            default=math.inf,
        )
        assert r <= best + 1e-9
    sq = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)], float)
    assert geo.shoelace(geo.hull(sq)) == pytest.approx(1) and geo.bounding_circle(sq) == pytest.approx(math.sqrt(0.5))


def test_components_legality_and_keys(square, spark):
    a, e, _, units = square
    parts = gr.components(a, e)
    pieces = {(r["plan"], r["district"]): r["pieces"] for r in gr.contiguity(parts).collect()}
    assert pieces[3, 1] == 2 and pieces[3, 2] == 1 and pieces[0, 1] == 1
    legal = {r["plan"]: r for r in gr.legality(a, units, 2, 0.1, parts).collect()}
    assert legal[0]["balanced"] and legal[0]["contiguous"] and not legal[1]["balanced"] and not legal[3]["contiguous"] and all(r["coverage"] and r["ids"] and r["non_empty"] for r in legal.values())
    relabelled = a.where("plan = 0").selectExpr("9L as plan", "unit", "3 - district as district")
    keys = {r["plan"]: r["key"] for r in gr.canonical_key(a.unionByName(relabelled)).collect()}
    digests = {r["plan"]: r["digest"] for r in gr.plan_digest(a.unionByName(relabelled)).collect()}
    assert keys[0] == keys[9] and digests[0] != digests[9] and keys[1] != keys[0]
    assert {r["plans"] for r in gr.distinct_plans(gr.canonical_key(a.unionByName(relabelled))).collect()} == {1, 2}


def test_ids_are_just_those_of_the_districts(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 1, 0), (3, 2, 2), (4, 1, None)], "plan long, unit long, district int")
    assert {r["plan"]: r["valid"] for r in gr.valid_ids(a, 2).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert "collect_set" not in gr.valid_ids(a, 2)._jdf.queryExecution().toString()


def test_digests_hold_no_plan_whole(spark):
    rows = [(p, u, (u * k) % 3) for k, p in enumerate(("a", "b", None)) for u in range(50)]
    rows += [("a", 7, 2), ("a", 7, 0), ("b", None, 1)]
    a = spark.createDataFrame(rows, "plan string, unit long, district int").repartition(5, "district")
    text = lambda p: ";".join(":".join(str(x) for x in r[1:] if x is not None) for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1] is not None, r[1] or 0, r[2])))
    want = {p: hashlib.sha256(text(p).encode()).hexdigest()[:16] for p in ("a", "b", None)}
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    told = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        found = gr.plan_digest(a)
        assert {r["plan"]: r["digest"] for r in found.collect()} == want
        assert "collect_list" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set(batch, told)


def test_adjacency_problems(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 9), (4, 4)], "u long, v long")
    units = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "unit long")
    got = {(r["u"], r["v"], r["problem"]) for r in gr.asymmetric_arcs(arcs, units).collect()}
    assert got == {(3, 9, "dangling"), (4, 4, "loop"), (2, 3, "one-sided"), (3, 9, "one-sided")}


def test_moves_change_the_balance_as_said(square):
    a, e, _, units = square
    moves = gr.move_candidates(a.where("plan = 1"), e, units, 80.0).collect()
    for m in moves:
        before = (40 - 80) ** 2 + (120 - 80) ** 2
        after = (30 - 80) ** 2 + (130 - 80) ** 2 if m["source"] == 1 else (50 - 80) ** 2 + (110 - 80) ** 2
        assert m["delta"] == after - before
    assert {m["unit"] for m in moves} == set(range(8))
    assert gr.swap_candidates(gr.move_candidates(a.where("plan = 1"), e, units, 80.0)).count() == 16
