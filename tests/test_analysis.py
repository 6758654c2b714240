"""Pairs of criteria, exact label tests, cases and overlays, on small tables by hand or brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from wardloom.operators import analysis as ana
from wardloom.operators import experiments as exp
from wardloom.operators import rules as ru
from wardloom.operators import spatial
from wardloom.sources import tables as tb


def test_pair_effects_are_those_of_single_pairs(spark):
    rng = np.random.default_rng(3)
    values = {m: rng.integers(0, 9, 40).astype(float) for m in "abc"} | {"d": np.ones(40)}
    rows = [(p, m, None if m == "c" and p < 3 else float(v[p])) for m, v in values.items() for p in range(40)]
    draws = spark.createDataFrame(rows, "plan long, metric string, value double")
    got = {(r["a"], r["b"]): r for r in ana.pair_effects(draws, list("abcd")).collect()}
    assert set(got) == {(a, b) for a in "abc" for b in "abc" if a != b}  # d doesn't vary
    assert got["a", "c"]["n"] == 37
    wide = spark.createDataFrame([(p // 10, p, float(values["a"][p]), float(values["b"][p])) for p in range(40)], "chain long, draw long, x double, y double")
    assert got["a", "b"]["effect"] == pytest.approx(exp.conditional_effect(wide).first()["effect"])
    third = exp.achievability(wide).first()
    assert (got["a", "b"]["joint"], got["a", "b"]["expected"]) == (pytest.approx(third["joint"]), pytest.approx(third["expected"]))
    assert got["a", "b"]["rho"] == pytest.approx(got["b", "a"]["rho"])
    assert ana.pair_effects(draws.where("false"), list("abcd")).count() == 0


def test_chain_labels(spark):
    rng = np.random.default_rng(5)
    rows = [("m", c, float(rng.integers(0, 6) + (2 if c < 2 else 0))) for c in range(5) for _ in range(7)]
    got = ana.chain_label_test(spark.createDataFrame([*rows, ("m", 0, None)], "metric string, chain long, value double"), [0, 1]).first()

    def delta(pick):
        x, y = [v for _, c, v in rows if c in pick], [v for _, c, v in rows if c not in pick]
        return sum(np.sign(a - b) for a in x for b in y) / (len(x) * len(y))

    everyone = [delta(p) for p in combinations(range(5), 2)]
    assert got["delta"] == pytest.approx(delta((0, 1)))
    assert (got["labelings"], got["p"]) == (10, pytest.approx(np.mean([abs(d) >= abs(delta((0, 1))) - 1e-9 for d in everyone])))
    with pytest.raises(ValueError):
        ana.chain_label_test(spark.createDataFrame(rows, "metric string, chain long, value double"), [9])


def test_ranking_and_classes(spark):
    sweep = spark.createDataFrame([(0.0, "a", 0.1), (0.5, "a", -0.4), (0.9, "a", -0.4), (0.0, "b", -0.4), (0.0, "c", 0.2)], "level double, metric string, delta double")
    got = [tuple(r) for r in ana.rank_criteria(sweep).orderBy("place").collect()]
    assert got == [("a", -0.4, 0.5, True, 1), ("b", -0.4, 0.0, True, 2), ("c", 0.2, 0.0, False, 3)]
    values = spark.createDataFrame([(float(i),) for i in range(5)] + [(None,)], "v double")
    assert sorted((r["v"], r["bucket"]) for r in ana.quantised(values, "v", (0.25, 0.75)).where("v is not null").collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    assert ana.quantised(values, "v", (0.5,)).where("v is null").first()["bucket"] is None


def test_cases(spark):
    rows = [(1, "planted", 2, None), (2, "null", 0, False), (2, "null", 1, True), (3, "other", 0, None), (4, "planted", None, False), (None, None, 1, None), (5, "null", 0, None)]
    cases = spark.createDataFrame(rows, "case_id long, kind string, shift long, in_gate_sample boolean")
    got = {tuple(r) for r in ana.scenario_problems(cases).collect()}
    assert got == {(2, "repeated id"), (2, "null with shift"), (3, "unknown kind"), (4, "planted without shift"), (None, "no id"), (None, "unknown kind")}
    assert {(r["case_id"], r["shift"]) for r in ana.gate_sample(cases).collect()} == {(1, 2), (2, 1), (3, 0), (4, None), (5, 0), (None, 1)}
    summary = spark.createDataFrame([("a", 300, 50, 40.0), ("b", 10, 2, None)], "metric string, n long, distinct long, ess double")
    assert {r["metric"]: (r["reasons"], r["qualified"]) for r in ana.qualified(summary, 200, 10, 20.0).collect()} == {"a": ("", True), "b": ("few draws, few distinct values, small effective size", False)}
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v long")
    b = spark.createDataFrame([("y", None), ("z", 4), (None, 5)], "k string, v long")
    assert {tuple(r) for r in ana.merged(a, b, "k", "v").collect()} == {("x", 1), ("y", None), ("z", 4), (None, 5)}
    curve = spark.createDataFrame([(1, 0.5), (2, 1.0)], "magnitude long, tpr double")
    assert [r["tpr"] for r in ru.rate_at(curve, 2).collect()] == [1.0] and ru.rate_at(curve, 3).count() == 0


def test_overlay(spark):
    units = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 2.0, 0.0, 4.0, 2.0), (3, 50.0, 50.0, 51.0, 51.0)], "unit long, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(7, -1.0, -1.0, 1.0, 3.0), (8, 1.0, 0.0, 2.5, 2.0), (9, 2.5, -9.0, 9.0, 9.0)], "zone long, x0 double, y0 double, x1 double, y1 double")
    for tile in (0.5, 3.0, 100.0):
        shares = spatial.overlay_boxes(units, zones, tile)
        assert {tuple(r) for r in shares.collect()} == {(1, 7, 0.5), (1, 8, 0.5), (2, 8, 0.25), (2, 9, 0.75)}
    assert {tuple(r) for r in spatial.main_zone(units, shares, 0.5).collect()} == {(1, 7, 0.5), (2, 9, 0.75), (3, None, None)}
    assert {tuple(r) for r in spatial.main_zone(units, shares, 0.6).collect()} == {(1, None, None), (2, 9, 0.75), (3, None, None)}


def test_checkpoint(spark, tmp_path):
    draws = spark.createDataFrame([(c, d, 100 + c) for c in range(3) for d in range(4)], "chain long, draw long, seed long")
    tb.write_draws(draws, str(tmp_path / "d"))
    assert tb.read_checkpoint(spark, str(tmp_path / "d"), 1, 101).count() == 4
    assert tb.read_checkpoint(spark, str(tmp_path / "d"), 1, 7).count() == 0
