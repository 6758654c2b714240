from __future__ import annotations

import json

import pytest

from wardloom.operators import experiments as exp
from wardloom.operators import reports, spatial


@pytest.fixture(scope="module")
def geom(spark):
    rows = [(r * 3 + c, [(float(c + x), float(r + y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]) for r in range(3) for c in range(3)]
    return spark.createDataFrame(rows, "unit long, ring array<struct<x:double,y:double>>")


def test_neighbours(geom):
    rook = {(r["u"], r["v"]): r["shared_len"] for r in spatial.rook_edges(geom).collect()}
    assert len(rook) == 12 and set(rook.values()) == {1.0} and (0, 1) in rook and (0, 4) not in rook
    queen = {(r["u"], r["v"]) for r in spatial.queen_edges(geom).collect()}
    assert len(queen) == 20 and set(rook) < queen and (0, 4) in queen


def test_points(geom, spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.9, 1.1), (3, 7.0, 0.0)], "point long, x double, y double")
    assert {r["point"]: r["unit"] for r in spatial.locate_points(points, geom, 0.7).collect()} == {1: 0, 2: 5, 3: None}


def test_reports(spark):
    m = spark.createDataFrame([(1, 0.1, -0.1, None, 0.0), (2, 0.1, 0.2, 0.3, 0.0)], "plan long, efficiency_gap double, mean_median double, declination double, partisan_bias double")
    trusted = spark.createDataFrame([(1, ["efficiency_gap"]), (2, ["efficiency_gap", "mean_median", "declination", "partisan_bias"])], "plan long, trusted array<string>")
    shapes = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.4, 0.5)], "plan long, polsby_popper double, reock double")
    got = {(r["plan"], r["kind"]) for r in reports.disagreements(m, trusted, shapes).collect()}
    assert got == {(1, "partisan_metrics_disagree_in_sign"), (1, "partisan_metrics_not_trustworthy_here"), (1, "compactness_measures_disagree")}
    where = spark.createDataFrame([(1, "a", "located", 0.5, 1.0, 30)], "case_id long, metric string, status string, percentile double, two_sided double, n long")
    caveats = spark.createDataFrame([(1, ["x"])], "plan long, caveats array<string>")
    r = {x["plan"]: json.loads(x["report"]) for x in reports.plan_report(m, caveats, where).collect()}
    assert r[1]["locations"][0]["percentile"] == 0.5 and "declination" not in r[1]["measures"] and r[2].get("locations") is None


def test_injected_dependence_keeps_the_values(spark):
    wide = spark.createDataFrame([(c, d, float((d * 7 + c) % 20), float((d * 3) % 20)) for c in range(3) for d in range(20)], "chain long, draw long, x double, y double")
    out = exp.inject(wide, 0.0)
    for c in range(3):
        a, b = (df.where(f"chain = {c}").toPandas() for df in (wide, out))
        assert sorted(a["y"]) == sorted(b["y"]) and b["x"].rank().corr(b["y"].rank()) == pytest.approx(-1)
    floor = exp.detection_floor(wide, (0.0, 50.0)).orderBy("blend").collect()
    assert floor[0]["rho"] < -0.9 and floor[0]["fired"]
    assert -1 <= exp.null_delta(wide, 20).first()["low"] <= 1
