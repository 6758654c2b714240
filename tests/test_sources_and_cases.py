"""Tables, streams, cases, and the registry of queries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wardloom.operators import cases, nulls
from wardloom.operators import partisan as par
from wardloom.plans import catalog
from wardloom.sources import census
from wardloom.sources import tables as tb
from wardloom.streaming import draws as st


def test_tables(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    units = tb.load_units(spark, write("units.csv", "GEOID,NAME,pop\n001,A,5\n002,B,7\n"))
    assert [r["unit"] for r in units.orderBy("unit").collect()] == ["001", "002"]
    with pytest.raises(tb.InvalidTable):
        tb.load_units(spark, write("votes.csv", "GEOID,NAME,pop,G20PREDBID\n001,A,5,1\n"))
    plan = tb.load_plan(spark, write("plan.csv", "GEOID,district\n001,1\n002,2\n"))
    assert {(r["unit"], r["district"]) for r in plan.collect()} == {("001", 1), ("002", 2)}
    for bad in ("GEOID\n1\n", "GEOID,district\n", "GEOID,district\n1,x\n", "GEOID,district\n1,1\n1,2\n", "GEOID,district\n ,1\n"):
        with pytest.raises(tb.InvalidTable):
            tb.load_plan(spark, write(f"bad{abs(hash(bad))}.csv", bad))
    arcs = tb.load_adjacency(spark, write("adj.json", json.dumps({"001": ["002"], "002": ["001"]})))
    assert {(r["u"], r["v"]) for r in arcs.collect()} == {("001", "002"), ("002", "001")}
    votes = tb.load_elections(spark, write("e.csv", "GEOID,G20PREDBID,G20PRERTRU,G20PRELJOR\n001,4,5,1\n002,6,2,0\n"))
    assert {tuple(r) for r in tb.two_party(votes, "G20PRE").collect()} == {("001", 4, 5), ("002", 6, 2)}
    with pytest.raises(tb.InvalidTable):
        tb.two_party(votes, "G20USS")
    with pytest.raises(tb.InvalidTable):
        tb.load_elections(spark, write("e2.csv", "GEOID,G20PREDBID\n001,-4\n"))
    parents = tb.load_membership(spark, write("m.json", json.dumps({"001": " x ", "002": None, "003": "NaN"})))
    assert {tuple(r) for r in parents.collect()} == {("001", "x"), ("002", None), ("003", None)}
    tb.require_coverage(plan, units)
    with pytest.raises(tb.InvalidTable):
        tb.require_coverage(plan.where("unit = '001'"), units)
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (4, 2.0)], "k int, v double")
    assert {r["k"] for r in tb.verify(a, b, ["k"]).collect()} == {3, 4}


def test_streams(spark, tmp_path):
    rows = [("a", c, d, float(d)) for c in range(2) for d in range(30)]
    draws = spark.createDataFrame(rows, "metric string, chain long, draw long, value double")
    tb.write_draws(draws, str(tmp_path / "draws"))
    query = st.running_moments(st.stream_draws(spark, str(tmp_path / "draws"))).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    query.processAllAvailable()
    query.stop()
    r = spark.table("moments").first()
    assert (r["n"], r["mean"], r["most"]) == (60, 14.5, 29.0)
    reference = draws.selectExpr("draw as plan", "metric", "value")
    st.write_located(st.stream_draws(spark, str(tmp_path / "draws")), reference, str(tmp_path / "located"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "located")).where("status = 'located'").count() == 60


def test_inputs_are_held_against_each_other(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    units = write("u.csv", "GEOID,NAME,pop\n001,A,5\n002,B,7\n")
    fine = write("a.json", json.dumps({"001": ["002"], "002": ["001"]}))
    votes = write("v.csv", "GEOID,G20PREDBID,G20PRERTRU\n001,4,5\n002,6,2\n")
    plan = write("p.csv", "GEOID,district\n001,1\n002,2\n")
    got = tb.load_inputs(spark, units, fine, votes, plan)
    assert {k: v.count() for k, v in got.items()} == {"units": 2, "adjacency": 2, "votes": 2, "plan": 2}
    bad = {
        "one-sided": {"adjacency": write("b1.json", json.dumps({"001": ["002"], "002": []}))},
        "loop": {"adjacency": write("b2.json", json.dumps({"001": ["001", "002"], "002": ["001"]}))},
        "unknown": {"adjacency": write("b3.json", json.dumps({"001": ["003"], "003": ["001"]}))},
        "votes": {"elections": write("b4.csv", "GEOID,G20PREDBID,G20PRERTRU\n001,4,5\n")},
        "plan": {"plan": write("b5.csv", "GEOID,district\n001,1\n003,2\n")},
        "repeated": {"elections": write("b6.csv", "GEOID,G20PREDBID,G20PRERTRU\n001,4,5\n001,4,5\n002,6,2\n")},
        "blank": {"elections": write("b7.csv", "GEOID,G20PREDBID,G20PRERTRU\n001,4,5\n ,6,2\n")},
        "contests": {"elections": write("b8.csv", "GEOID,G20PREDBID,G20PRERTRU,G20USSDGRE,G20USSRERN\n001,4,5,1,1\n002,6,2,1,1\n")},
    }
    for name, change in bad.items():
        with pytest.raises(tb.InvalidTable):
            tb.load_inputs(spark, **({"units": units, "adjacency": fine, "elections": votes, "plan": plan} | change))
            pytest.fail(name)


def test_strict_votes_refuse_other_units(spark):
    votes = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "unit string, dem long, rep long")
    fine = [(1, "a", 1), (1, "b", 2)]
    frame = lambda rows: spark.createDataFrame(rows, "plan int, unit string, district int")
    assert par.district_votes(frame(fine), votes, strict=True).count() == 2
    for bad in (fine[:1], [*fine, (1, "c", 1)], [*fine, (1, "a", 2)], [*fine, (2, "a", 1)]):
        with pytest.raises(tb.InvalidTable):
            par.district_votes(frame(bad), votes, strict=True)


def test_census_lines(spark, tmp_path):
    geo = ["|".join(["x"] * 2 + [level] + ["x"] * 4 + [rec, "x", unit] + ["x"] * 77 + [name]) for level, rec, unit, name in (("050", "7", "19001", "Adair"), ("040", "1", "19", "Iowa"), ("050", "8", "19003", "Adams"))]
    counts = ["|".join(["x"] * 4 + [rec, pop]) for rec, pop in (("7", "7496"), ("1", "99"), ("8", "3704"))]
    (tmp_path / "geo.pl").write_text("\n".join(geo), encoding="latin-1")
    (tmp_path / "one.pl").write_text("\n".join([*counts, "short|line"]), encoding="latin-1")
    got = census.census_units(census.read_lines(spark, str(tmp_path / "geo.pl")), census.read_lines(spark, str(tmp_path / "one.pl")))
    assert {tuple(r) for r in got.collect()} == {("19001", "Adair", 7496), ("19003", "Adams", 3704)}
    with pytest.raises(tb.InvalidTable):
        census.census_units(spark.createDataFrame([(geo[0],)], "text string"), spark.createDataFrame([("x|x|x|x|7|many",)], "text string"))
    lines = [(1, '"A"\t"01"\t"A"\t"01"'), (2, '\t\t"B"\t"02"'), (3, '\t\t"C"\t"03"'), (4, '"B"\t"02"\t"A"\t"01"'), (5, "no tabs"), (6, '\t\t"D"\t"04"')]
    pairs = census.adjacency_pairs(spark.createDataFrame(lines, "line long, text string").repartition(3))
    assert {tuple(r) for r in pairs.collect()} == {("01", "02"), ("01", "03"), ("02", "04")}
    ours = spark.createDataFrame([("01", "02"), ("05", "06")], "u string, v string")
    assert {tuple(r) for r in census.pair_differences(ours, pairs).collect()} == {("05", "06", "ours"), ("01", "03", "theirs"), ("02", "04", "theirs")}


def test_cases(spark):
    maps = spark.createDataFrame([(1, u, d) for u, d in enumerate([1, 1, 2])] + [(2, u, d) for u, d in enumerate([1, 2, 2])] + [(3, u, 1) for u in range(3)], "plan long, unit long, district int")
    seats = spark.createDataFrame([(1, 2, 0), (2, 2, 0), (3, 1, 1)], "plan long, dem_seats long, rep_seats long")
    assert tuple(cases.most_seats_plan(maps, seats).first()) == (2, 2)
    assert tuple(cases.most_seats_plan(maps, seats, "rep").first()) == (3, 1)
    draws = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 2.0), (2, "b", 1.0)], "plan long, metric string, value double")
    assert [r[0] for r in cases.anchor_pool(draws, ("a", "b")).collect()] == [2]
    flags = spark.createDataFrame([(1, True), (2, False), (3, None), (4, None)], "case_id long, flagged boolean")
    strata = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "case_id long, stratum string")
    got = {r["stratum"]: r for r in cases.stratum_rates(flags, strata).collect()}
    assert (got["x"]["n"], got["x"]["resolved"], got["x"]["fpr"]) == (3, 2, 0.5) and got["y"]["fpr"] is None and got["y"]["low"] is None
    say = lambda auc, j: tuple(cases.beats_baselines(spark.createDataFrame([(auc,)], "auc double"), spark.createDataFrame([(j,)], "youden double")).first())
    assert say(0.7, 0.1) == (True, True, True) and say(0.4, None) == (False, None, False) and say(0.7, None) == (True, None, None) and say(0.7, -0.1)[2] is False
    rows = spark.createDataFrame([(c, d, 0.0) for c, n in ((0, 5), (1, 3)) for d in range(n)], "chain long, draw long, value double")
    meta = spark.createDataFrame([(0, False), (1, True)], "chain long, completed boolean")
    count = lambda df: {r["chain"]: r["count"] for r in df.groupBy("chain").count().collect()}
    assert count(cases.chains_of(rows, meta)) == {1: 3} and count(cases.chains_of(rows, meta, 4)) == {0: 4} and count(cases.chains_of(rows, meta, 3)) == {0: 3, 1: 3}


def test_nulls(spark):
    scored = spark.createDataFrame([(i, [3, 5, 4, 5, 5, 3][i], i) for i in range(6)], "plan long, seats int, rank long")
    got = [r["side"] for r in nulls.interleave(scored, 4.0, 6).orderBy("place").collect()]
    assert got == ["above", "below", "above", "below", "above", "level"]
    picked = [r["plan"] for r in nulls.random_stratum(spark.range(50).selectExpr("id as plan"), 5).orderBy("place").collect()]
    assert len(set(picked)) == 5


def test_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and catalog.FLAGSHIP in queries and len(catalog.QUERIES) > 80
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["partisan_all", "plan_metrics", "locate_all", "confusion", "cut_edges", "kish_ess", "spearman_matrix"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_python_only_where_it_is_needed(spark):
    df = catalog.QUERIES["plan_metrics"](spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.count("*")).first()[0] == 200


def test_event_windows_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    got, want = entry.queries()["event_windows"](spark, "/root/testdata/sf0.001").toPandas(), con.execute(entry.oracle_sql()["event_windows"]).df()
    key = lambda df: sorted(map(tuple, df[["start", "event_type", "n", "total"]].astype({"start": "datetime64[us]"}).itertuples(index=False)))
    assert len(got) and key(got) == key(want)
