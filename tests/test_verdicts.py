"""Verdicts on pairs, the choice of layers, areas under curves and gates."""

from __future__ import annotations

import random

import pytest

from wardloom.operators import administrative as adm
from wardloom.operators import cases
from wardloom.operators import convergence as conv
from wardloom.operators import experiments as exp
from wardloom.operators import rules as ru
from wardloom.operators import verdicts


@pytest.fixture(scope="module")
def judged(spark):
    """x and its opposite, one that has nothing to do with them, a constant, and one that is 0 but for a few draws."""
    rng = random.Random(3)
    rows = []
    for chain in range(6):
        for d in range(60):
            x = rng.gauss(0, 1)
            rows.append((chain, d, x, -x + rng.gauss(0, 0.1), rng.gauss(0, 1), 4.0, float(rng.random() < 0.02)))
    rows.append((0, 99, None, 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "chain long, draw long, x double, y double, z double, flat double, rare double")
    return {(r["a"], r["b"]): r for r in verdicts.Pairs(df, ("x", "y", "z", "flat", "rare"), reps=200).evaluate().collect()}, rows[:-1]


def test_pairs_are_told_apart(judged):
    got, rows = judged
    assert len(got) == 20
    assert got["x", "y"]["verdict"] == got["y", "x"]["verdict"] == "strong" and got["x", "y"]["votes"] == 3
    assert got["x", "z"]["verdict"] == "none" and got["x", "z"]["deciding"] == 3
    assert got["x", "flat"]["verdict"] == "degenerate" and got["flat", "x"]["deciding"] == 0
    assert got["x", "rare"]["conditional"] == "degenerate" and got["x", "rare"]["achievability"] != "degenerate"
    rank = lambda v: [sum(o < u for o in v) + (sum(o == u for o in v) + 1) / 2 for u in v]
    x, y = rank([r[2] for r in rows]), rank([r[3] for r in rows])
    n, mx = len(rows), (len(rows) + 1) / 2
    rho = sum((a - mx) * (b - mx) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - mx) ** 2 for b in y)) ** 0.5
    assert got["x", "y"]["rho"] == pytest.approx(rho) and got["x", "y"]["low"] <= rho <= got["x", "y"]["high"]
    cut = sorted((r[2] for r in rows), reverse=True)[round(0.1 * n) - 1]
    from statistics import median

    ys = [r[3] for r in rows]
    sd = 1.4826 * median(abs(v - median(ys)) for v in ys)
    assert got["x", "y"]["effect"] == pytest.approx((median(r[3] for r in rows if r[2] >= cut) - median(ys)) / sd) and got["x", "y"]["p"] == pytest.approx(1 / 201)


def test_symmetry_is_checked_over_verdicts(spark, judged):
    rows = [(r["a"], r["b"], *(r[t] for t in verdicts.TESTS)) for r in judged[0].values()]
    frame = spark.createDataFrame(rows, "a string, b string, " + ", ".join(f"{t} string" for t in verdicts.TESTS))
    read = lambda df: {r["test"]: (r["checked"], r["mismatches"]) for r in exp.check_symmetry(verdicts.by_test(df), verdicts.SYMMETRIC).collect()}
    assert read(frame) == {"correlation": (10, 0), "achievability": (10, 0)}
    turned = spark.createDataFrame([(a, b, "none" if (a, b) == ("y", "x") else c, *rest) for a, b, c, *rest in rows], frame.schema)
    assert read(turned) == {"correlation": (10, 1), "achievability": (10, 0)}


def test_layers_are_chosen_not_guessed(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "plan long, unit long, district int")
    two = spark.createDataFrame([(0, 1, 1), (0, 3, 1)], "plan long, unit long, district int")
    assert adm.select_layer({"house": one}) == ("house", one) and adm.select_layer({"house": one, "senate": two}, "senate") == ("senate", two)
    with pytest.raises(ValueError, match="house, senate"):
        adm.select_layer({"senate": one, "house": two})
    with pytest.raises(KeyError, match="court"):
        adm.select_layer({"house": one}, "court")
    assert adm.same_units({"house": one, "senate": one.withColumnRenamed("x", "y")})
    with pytest.raises(ValueError, match="units 2, 3"):
        adm.same_units({"house": one, "senate": two})


def test_areas_and_gates(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["planted", "null", "other"]), rng.choice([None, 0.1, 0.5, 0.9, rng.random()])) for _ in range(200)]
    got = ru.auc(spark.createDataFrame(rows, "kind string, outlierness double")).first()
    planted, null = ([v for k, v in rows if k == kind and v is not None] for kind in ("planted", "null"))
    want = sum((a > b) + (a == b) / 2 for a in planted for b in null) / (len(planted) * len(null))
    assert (got["auc"], got["n_planted"], got["n_null"]) == (pytest.approx(want), len(planted), len(null))
    empty = ru.auc(spark.createDataFrame([], "kind string, outlierness double")).first()
    assert (empty["auc"], empty["n_planted"]) == (None, 0)
    youden = lambda j: spark.createDataFrame([(j, 0.9, 0.01)], "youden double, tpr_worst double, fpr_worst double")
    area = spark.createDataFrame([(0.8, 3, 4)], "auc double, n_planted long, n_null long")
    assert ru.auc_with_decision(area, youden(0.5)).first()["decision_auc"] == 0.75 and ru.auc_with_decision(area, youden(None)).first()["decision_auc"] is None
    shift = lambda n: spark.createDataFrame([(n,)], "shift long")
    assert [ru.gates_with_shift(youden(0.5), shift(n)).first()["shift_pass"] for n in (1, 2, None)] == [True, False, False]


def test_scenarios_of_cases(spark):
    nulls = spark.createDataFrame([("null_random_01", True, 2.0), ("null_seat_outcome_01", False, -1.0)], "case_id string, in_gate_sample boolean, seat_shift double")
    planted = spark.createDataFrame([("p1", 2)], "case_id string, shift int")
    assert {tuple(r) for r in cases.as_scenarios(nulls, planted).collect()} == {("null_random_01", "null", 0, True), ("null_seat_outcome_01", "null", 0, False), ("p1", "planted", 2, True)}


def test_rectangles_hold_both_statistics(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a", c, d, rng.gauss(0, 1)) for c in range(4) for d in range(60 + 20 * (c > 0))], "metric string, chain long, draw long, value double")
    whole = {r["length"]: r for r in conv.rectangles(df, 3, 50).collect()}
    assert set(whole) == {60, 80} and whole[80]["chains"] == 3
    short = conv.diagnostics(df.where("draw < 60")).first()
    assert (whole[60]["rhat"], whole[60]["ess"]) == (pytest.approx(short["rhat"]), pytest.approx(short["ess"]))
