from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wardloom.operators import partisan as par

# district totals (dem, rep)
PACKED = [(400, 600)] * 3 + [(900, 100)]
SYMMETRIC = [(400, 600)] * 2 + [(600, 400)] * 2
TIED = [(500, 500), (400, 600), (700, 300)]


def frames(spark, plans):
    """Each district in two units: a quarter and the rest."""
    units, votes = [], []
    for p, districts in enumerate(plans):
        for d, (dem, rep) in enumerate(districts, 1):
            for half, (a, b) in enumerate(((dem // 4, rep - rep // 3), (dem - dem // 4, rep // 3))):
                u = p * 1000 + d * 10 + half
                units.append((p, u, d))
                votes.append((u, a, b))
    return spark.createDataFrame(units, "plan long, unit long, district int"), spark.createDataFrame(votes, "unit long, dem long, rep long")


@pytest.fixture(scope="module")
def metrics(spark):
    plans = [PACKED, SYMMETRIC, TIED, [(r, d) for d, r in PACKED]]
    districts = par.district_votes(*frames(spark, plans)).cache()
    return districts, {r["plan"]: r for r in par.all_metrics(districts).collect()}


def test_packed(metrics):
    m = metrics[1][0]
    assert (m["dem_seats"], m["rep_seats"], m["tied_districts"]) == (1, 3, 0)
    assert m["dem_vote_share"] == pytest.approx(0.525)
    assert m["efficiency_gap"] == pytest.approx(1202 / 4000)
    assert m["mean_median"] == pytest.approx(0.125)
    assert m["declination"] == pytest.approx(0.6413, abs=1e-4)
    assert m["partisan_bias"] == pytest.approx(-0.25)


def test_symmetric_and_tied(metrics):
    m = metrics[1]
    assert m[1]["efficiency_gap"] == 0 and m[1]["mean_median"] == pytest.approx(0) and m[1]["declination"] == pytest.approx(0) and m[1]["partisan_bias"] == 0
    assert (m[2]["dem_seats"], m[2]["rep_seats"], m[2]["tied_districts"]) == (1, 1, 1) and m[2]["declination"] is None


def test_swapping_parties_flips_every_sign(metrics):
    a, b = metrics[1][0], metrics[1][3]
    for name in par.METRICS:
        assert a[name] == pytest.approx(-b[name])


def test_single_measures_equal_the_wide_row(metrics):
    districts, wide = metrics
    for f, name in ((par.efficiency_gap, "efficiency_gap"), (par.partisan_bias, "partisan_bias"), (par.mean_median, "mean_median"), (par.declination, "declination")):
        for r in f(districts).collect():
            assert r[name] == (None if wide[r["plan"]][name] is None else pytest.approx(wide[r["plan"]][name]))


def test_bias_is_the_same_for_both_parties_at_any_share(metrics):
    districts, _ = metrics
    for at in (0.4, 0.45, 0.6):
        a = {r["plan"]: r["partisan_bias"] for r in par.partisan_bias(districts, at).collect()}
        b = {r["plan"]: r["partisan_bias"] for r in par.partisan_bias(districts, 1 - at).collect()}
        assert a == pytest.approx(b) and a[1] == pytest.approx(0)


def test_wasted_votes_add_up(metrics):
    w = {(r["plan"], r["district"]): r for r in par.wasted_votes(metrics[0]).collect()}
    assert (w[0, 1]["wasted_dem"], w[0, 1]["wasted_rep"]) == (400, 99)
    assert (w[2, 1]["wasted_dem"], w[2, 1]["wasted_rep"]) == (500, 500)
    h = {(r["plan"], r["district"]): r for r in par.wasted_votes(metrics[0], "half").collect()}
    assert (h[0, 4]["wasted_dem"], h[0, 4]["wasted_rep"]) == (400, 100)


def test_curve_rises_and_meets_the_observed_seats(metrics):
    districts, wide = metrics
    curve = par.seats_votes_curve(districts, [0.3, 0.5, 0.525, 0.7], tie="neither").where("plan = 0").orderBy("target").collect()
    assert [r["seat_share"] for r in curve] == sorted(r["seat_share"] for r in curve)
    assert curve[2]["seat_share"] == wide[0]["dem_seats"] / 4


def test_trust_and_caveats(metrics):
    districts, _ = metrics
    m = par.all_metrics(districts)
    trusted = {r["plan"]: r["trusted"] for r in par.trusted_metrics(m).collect()}
    assert "efficiency_gap" in trusted[0] and "declination" not in trusted[0]
    notes = {r["plan"]: r["caveats"] for r in par.caveats(m).collect()}
    assert any("tied" in x for x in notes[2]) and notes[0][-1].startswith("Usable here")


def test_arguments_are_checked(metrics):
    for bad in (lambda: par.wasted_votes(metrics[0], "none"), lambda: par.partisan_bias(metrics[0], 2), lambda: par.seats_votes_curve(metrics[0], tie="x")):
        with pytest.raises(ValueError):
            bad()


def test_concentration(metrics):
    got = {r["plan"]: r["concentration"] for r in par.vote_concentration(metrics[0]).collect()}
    assert got[0] == pytest.approx((3 * 400**2 + 900**2) / 2100**2)
    assert math.isclose(par.statewide_share(metrics[0].where("plan = 0").withColumn("unit", F.lit(1))).first()["dem_share"], 0.525)
