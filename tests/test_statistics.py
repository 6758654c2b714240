"""Ensembles, rules, convergence, experiments."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest

from wardloom.functions import seeds
from wardloom.operators import convergence as conv
from wardloom.operators import ensemble as ens
from wardloom.operators import experiments as exp
from wardloom.operators import rules as ru


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(20)
    rows = [(p, m, float(np.round(v, 2)) if p % 17 or m != "c" else None) for m in "abc" for p, v in enumerate(rng.normal(size=200))] + [(p, "flat", 1.0) for p in range(200)]
    return spark.createDataFrame(rows, "plan long, metric string, value double").cache(), rows


def test_summary(draws):
    df, rows = draws
    for r in ens.summarize(df).collect():
        v = np.array([x[2] for x in rows if x[1] == r["metric"] and x[2] is not None])
        u, c = np.unique(v, return_counts=True)
        assert (r["n"], r["distinct"], r["n_undefined"]) == (len(v), len(u), 200 - len(v))
        assert r["mean"] == pytest.approx(v.mean()) and r["sd"] == pytest.approx(v.std(), abs=1e-12)
        assert [r[f"p{q:02d}"] for q in (5, 25, 50, 75, 95)] == pytest.approx(np.percentile(v, [5, 25, 50, 75, 95]))
        assert r["ess"] == pytest.approx(len(v) ** 2 / (c**2).sum()) and (r["mult_least"], r["mult_most"]) == (c[0], c[-1])


def test_locations(draws, spark):
    df, rows = draws
    cases = spark.createDataFrame([(1, "a", 0.1), (2, "a", 99.0), (3, "b", None), (4, "flat", 1.0), (5, "zzz", 1.0), (6, "c", 0.0)], "case_id long, metric string, value double")
    got = {r["case_id"]: r for r in ens.locate(cases, df).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["located", "located", "value_undefined", "degenerate", "missing_from_ensemble", "located"]
    v = np.array([x[2] for x in rows if x[1] == "a"])
    below, ties = (v < 0.1).sum(), (v == 0.1).sum()
    assert got[1]["percentile"] == pytest.approx((below + ties / 2) / 200)
    assert got[1]["two_sided"] == pytest.approx(min(1, 2 * min((below + ties) / 200, (200 - below) / 200)))
    assert got[1]["z"] == pytest.approx((0.1 - v.mean()) / v.std()) and got[2]["percentile"] == 1 and got[2]["outside_support"]
    few = ens.locate(cases, df.where("plan < 10")).where("case_id = 1").first()
    assert few["status"] == "insufficient_ensemble" and few["percentile"] is None
    told = spark.createDataFrame([("a", "cannot move")], "metric string, reason string")
    assert ens.locate(cases, df, told).where("case_id = 1").first()["status"] == "degenerate"


def test_bounds(draws, spark):
    df, _ = draws
    band = ens.central_band(df)
    out = ens.violations(df, band)
    assert out.where("metric = 'a'").count() <= 22 and out.where("metric = 'c' and side = 'undefined'").count() == 12
    assert ens.inside(df, band).join(out, "plan").count() == 0
    floor = {r["measure"]: (r["lo"], r["hi"]) for r in ens.floor_band(df, {"a": True, "b": False}).collect()}
    assert floor["a"][1] == math.inf and floor["b"][0] == -math.inf


def scenarios(spark):
    """Planted cases (shift, percentile) and nulls."""
    rows = []
    for i in range(20):
        shift, p = (1, 0.970) if i < 6 else (2, 0.9995) if i < 13 else (-3, 0.9999)
        rows.append((i, "planted", shift, "m", "located", p, 1000, 900, 800.0, 0.9999, 0.0001))
    rows += [(100 + i, "null", 0, "m", "located", 0.30 + 0.02 * i, 1000, 900, 800.0, 0.9999, 0.0001) for i in range(20)]
    return spark.createDataFrame(rows, "case_id long, kind string, shift long, metric string, status string, percentile double, n long, distinct long, ess double, max_interior double, min_interior double")


def test_rules(spark):
    loc = scenarios(spark)
    rule = ru.Rule(threshold=0.999)
    decided = ru.flag(loc, rule)
    c = ru.confusion(decided).first()
    assert (c["tp"], c["fn"], c["fp"], c["tn"]) == (14, 6, 0, 20)
    curve = {r["magnitude"]: r["tpr"] for r in ru.detection_curve(decided).collect()}
    assert curve == {1: 0, 2: 1, 3: 1}
    assert ru.min_detectable_shift(ru.detection_curve(decided)).first()["shift"] == 2
    a = ru.auc(decided).first()
    stat = lambda r: max(r[5], 1 - r[5])
    rows = [tuple(r) for r in loc.collect()]
    pairs = [(stat(x) > stat(y)) + 0.5 * (stat(x) == stat(y)) for x in rows if x[1] == "planted" for y in rows if y[1] == "null"]
    assert a["auc"] == pytest.approx(sum(pairs) / 400)
    g = ru.gates(ru.confusion(decided)).first()
    assert not g["tpr_pass"] and g["fpr_pass"]
    assert {r["detector"]: r["youden"] for r in ru.baselines(decided).collect()} == {"always": 0, "never": 0}


def test_a_reference_that_cannot_express_the_rule_leaves_it_open(spark):
    loc = scenarios(spark).selectExpr("* except (max_interior)", "0.9 as max_interior")
    assert ru.flag(loc, ru.Rule(threshold=0.999)).where("flagged is not null").count() == 0
    c = ru.confusion(ru.flag(loc, ru.Rule(threshold=0.999))).first()
    assert c["unresolved_planted"] == 20 and c["tpr"] is None and c["fpr_worst"] == 1
    assert ru.flag(loc, ru.Rule(threshold=0.999, tail="lower")).where("flagged is null").count() == 0
    with pytest.raises(ValueError):
        ru.Rule(threshold=1.0)
    assert ru.Rule(threshold=0.95).required_n == 10


def rhat_by_numpy(chains):
    m = np.array(chains)
    n = m.shape[1] // 2
    m = np.vstack([m[:, :n], m[:, -n:]])

    def ranks(x):
        f = x.ravel()
        r = np.array([(f < v).sum() + ((f == v).sum() + 1) / 2 for v in f])
        return np.vectorize(NormalDist().inv_cdf)((r - 0.375) / (len(f) - 0.25)).reshape(x.shape)

    def one(x):
        w = x.var(axis=1, ddof=1).mean()
        return math.sqrt(((n - 1) / n * w + x.mean(axis=1).var(ddof=1)) / w)

    return max(one(ranks(m)), one(ranks(abs(m - np.median(m)))))


def ar1(phi, chains, n, seed):
    rng = np.random.default_rng(seed)
    out = np.zeros((chains, n))
    for t in range(1, n):
        out[:, t] = phi * out[:, t - 1] + rng.normal(size=chains)
    return out


def test_convergence(spark):
    a, b = ar1(0.5, 4, 101, 1), np.round(ar1(0.0, 4, 101, 2), 1)
    b[0] += 2
    rows = [(m, c, d, float(x[c, d])) for m, x in (("a", a), ("b", b)) for c in range(4) for d in range(101)]
    rows += [("flat", c, d, 3.0) for c in range(4) for d in range(10)] + [("stuck", c, d, float(c)) for c in range(4) for d in range(10)]
    df = spark.createDataFrame(rows, "metric string, chain long, draw long, value double")
    got = {r["metric"]: r["rhat"] for r in conv.split_rhat(df).collect()}
    assert got["a"] == pytest.approx(rhat_by_numpy(a)) and got["b"] == pytest.approx(rhat_by_numpy(b)) and got["b"] > 1.2
    assert math.isnan(got["flat"]) and got["stuck"] == math.inf
    e = {r["metric"]: r["ess"] for r in conv.ess(df).collect()}
    assert math.isnan(e["flat"]) and e["stuck"] == 0 and 60 < e["a"] < 300
    cut = {(r["metric"], r["upto"]): r["rhat"] for r in conv.trace(df.where("metric = 'a'"), [50, 101]).collect()}
    assert cut["a", 101] == pytest.approx(got["a"]) and cut["a", 50] == pytest.approx(rhat_by_numpy(a[:, :50]))
    rect = conv.rectangles(df.where("metric = 'a' and (chain > 0 or draw < 60)"), 3, 50)
    assert {(r["length"], r["chains"]) for r in rect.collect()} == {(60, 4), (101, 3)}


def test_experiments(spark):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=150), 1), np.round(rng.normal(size=150), 1)
    wide = spark.createDataFrame([(i, i // 30, i % 30, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "plan long, chain long, draw long, x double, y double").cache()
    frontier = {(r["x"], r["y"]) for r in exp.pareto_frontier(wide).collect()}
    pts = set(zip(x, y, strict=True))
    assert frontier == {p for p in pts if not any(q[0] >= p[0] and q[1] >= p[1] and q != p for q in pts)}
    kept = wide.selectExpr("'m' as metric", "plan % 3 = 0 as kept", "y as value")
    a, b = y[::3], np.delete(y, np.s_[::3])
    assert exp.cliffs_delta(kept).first()["delta"] == pytest.approx(np.sign(a[:, None] - b[None]).mean())
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "id long, p double")
    assert {r["id"]: round(r["q"], 6) for r in exp.adjust_multiplicity(tests).collect()} == {0: 0.04, 1: 0.053333, 2: 0.053333, 3: 0.5}
    ci = exp.bootstrap_correlation(wide, 60).first()
    assert ci["low"] <= ci["rho"] <= ci["high"]
    assert 0 < exp.permutation_p(wide, 40).first()["p"] <= 1
    same = wide.selectExpr("plan", "explode(map('x', x, 'z', -x, 'k', 1.0D)) as (metric, value)")
    m = {(r["a"], r["b"]): r["rho"] for r in exp.spearman_matrix(same, ["x", "z", "k"]).collect()}
    assert m["x", "z"] == pytest.approx(-1) and m["k", "x"] is None
    orders = spark.createDataFrame([(i, i, (i * 7) % 5) for i in range(5)], "item int, a int, b int")
    assert -1 <= exp.kendall_tau(orders).first()["tau"] <= 1
    assert exp.kendall_tau(orders.where("item = 0")).first()["tau"] == 1.0


def test_seeds(spark):
    assert seeds.derive(1, "chain", 0) != seeds.derive(1, "chain", 1) != seeds.derive(2, "chain", 1)
    assert 0 <= seeds.derive(7, "x", 3) < 2**63
    got = {r["index"]: r["seed"] for r in seeds.seeds(spark.range(5), 1, "chain").collect()}
    assert got == dict(enumerate(seeds.stream(1, "chain", 5)))
    with pytest.raises(TypeError):
        seeds.derive(True, "x", 0)


def test_kendall_counts_every_pair(spark):
    rng = np.random.default_rng(4)
    for n, spread in ((0, 5), (1, 5), (2, 5), (300, 12), (300, 10_000)):
        a, b = rng.integers(0, spread, n), rng.integers(0, spread, n)
        s = int(sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i)))
        assert exp.concordance(a, b) == s
        rows = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "item long, a long, b long")
        assert exp.kendall_tau(rows.repartition(3)).first()["tau"] == pytest.approx(s / (n * (n - 1) / 2) if n > 1 else 1.0)


def test_orders_over_ranges(spark):
    from pyspark.sql import functions as F

    from wardloom.operators import ordering

    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 40)), float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v double").repartition(5)
    got = {r["id"]: r["n"] for r in ordering.numbered(df, "n", F.desc("k"), F.col("id")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))] and sorted(got.values()) == list(range(1, 501))
    top = {r["id"]: r["m"] for r in ordering.running(df, "m", F.col("v"), F.max, [F.col("k"), F.col("id")], inclusive=False).collect()}
    so_far = None
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert top[i] == so_far
        so_far = v if so_far is None else max(so_far, v)
    assert ordering.numbered(df.where("id < 0"), "n", F.col("k")).count() == 0


def test_effective_size_follows_the_definition(spark):
    """Correlated chains: the sums of pairs of correlations, computed lag by lag, cut at the first that is not positive."""
    rng = np.random.default_rng(9)
    chains = []
    for _ in range(4):
        x = [rng.normal()]
        for _ in range(119):
            x.append(0.6 * x[-1] + rng.normal())
        chains.append(np.array(x))
    rows = [("m", c, d, float(v)) for c, x in enumerate(chains) for d, v in enumerate(x)] + [("flat", c, d, float(c)) for c in range(4) for d in range(10)] + [("same", c, d, 2.0) for c in range(4) for d in range(10)]
    got = {r["metric"]: r["ess"] for r in conv.ess(spark.createDataFrame(rows, "metric string, chain long, draw long, value double")).collect()}
    halves = [h for x in chains for h in (x[:60], x[60:])]
    order = np.argsort(np.argsort(np.concatenate(halves))) + 1
    z = np.array([NormalDist().inv_cdf((r - 0.375) / (480 - 0.25)) for r in order]).reshape(8, 60)
    cov = [np.mean([sum((h[i] - h.mean()) * (h[i + t] - h.mean()) for i in range(60 - t)) / 60 for h in z]) for t in range(60)]
    within = cov[0] * 60 / 59
    total = 59 / 60 * within + z.mean(1).var(ddof=1)
    rho = [1.0] + [1 - (within - c) / total for c in cov[1:]]
    tau, least = -1.0, math.inf
    for k in range(30):
        pair = rho[2 * k] + rho[2 * k + 1]
        if k and pair <= 0:
            break
        least = min(least, pair)
        tau += 2 * least
    assert got["m"] == pytest.approx(480 / max(tau, 1 / math.log10(480)))
    assert got["flat"] == 0 and math.isnan(got["same"])


def test_degeneracy_of_all_measures(spark):
    from wardloom.operators import administrative as adm

    frame = lambda rows: spark.createDataFrame(rows, "unit long, parent long")
    say = lambda rows, *a: {r["metric"]: (r["constant"], r["computable"], r["value"]) for r in adm.degeneracy_report(frame(rows), *a).collect()}
    county = say([(u, u // 4) for u in range(40)], 1, 4)
    assert county["county_splits"] == (False, True, None) and county["ballot_styles"] == (True, True, 4) and county["ballot_styles_by_subdivision"] == (False, True, None) and county["n_subdivisions"] == (True, True, 10)
    single = say([(u, u) for u in range(9)], 2)
    assert single["county_splits"] == (True, True, 0) and single["split_pieces"] == (True, True, 9) and single["ballot_styles"] == (False, True, None) and single["n_layers"] == (True, True, 2)
    bare = say([(0, None), (1, None)], 1, 2)
    assert bare["split_pieces"] == (True, True, 0) and bare["ballot_styles_by_subdivision"] == (True, False, 0) and bare["n_units_in_no_subdivision"] == (True, True, 2)
    partly = say([(0, None), (1, 5), (2, 5)], 1, 2)
    assert partly["ballot_styles_by_subdivision"] == (False, False, None) and partly["excess_pieces"] == (False, True, None)
    reasons = {r["metric"]: r["reason"] for r in adm.degeneracy_report(frame([(0, None), (1, 5), (2, 5)]), 2).collect()}
    assert reasons["county_splits"] is None and reasons["ballot_styles"] is None and reasons["ballot_styles_by_subdivision"] and reasons["n_units"]
    plans = spark.createDataFrame([(1, u, 1 + u // 20) for u in range(40)], "plan long, unit long, district int")
    voters = spark.createDataFrame([(u, 50) for u in range(40)], "unit long, voters long")
    r = adm.admin_report(plans, frame([(u, u // 4) for u in range(40)]), voters).first()
    assert (r["county_splits"], r["split_pieces"], r["excess_pieces"], r["ballot_styles"], r["ballot_styles_by_subdivision"], r["ballot_styles_per_10k"], r["n_units"], r["n_districts"]) == (0, 10, 0, 2, 10, 10.0, 40, 2)
    with pytest.raises(ValueError):
        adm.admin_report(plans, frame([(u, 1) for u in range(40)]), voters.selectExpr("unit", "0L as voters"))
