"""The store of draws, rounds over time, and the ranking of criteria against plain Python."""

from __future__ import annotations

import json
import random

import pytest

from wardloom.operators import ranking
from wardloom.sources import rounds
from wardloom.sources.store import DrawStore
from wardloom.sources.tables import InvalidTable

CONFIG = {"epsilon": 0.05, "steps": 100}


def draws_of(spark, chains, shift=0):
    return spark.createDataFrame([(c, d, float(c * 100 + d + shift)) for c in chains for d in range(20)], "chain long, draw long, value double")


def listed(spark, chains, completed=True, seed=7):
    return spark.createDataFrame([(c, seed + c, completed) for c in chains], "chain long, seed long, completed boolean")


def test_a_rerun_writes_only_what_is_missing(spark, tmp_path):
    store = DrawStore(spark, str(tmp_path / "store"))
    like = draws_of(spark, [1])
    assert store.read(CONFIG, like).count() == 0 and store.missing(CONFIG, listed(spark, [1, 2])).count() == 2
    assert store.commit(CONFIG, draws_of(spark, [1, 2]), listed(spark, [1, 2])) == 2
    assert store.commit(CONFIG, draws_of(spark, [1, 2]), listed(spark, [1, 2])) == 0
    assert [r["chain"] for r in store.missing(CONFIG, listed(spark, [1, 2, 3])).collect()] == [3]
    more = listed(spark, [1, 2]).unionByName(listed(spark, [3, 4], completed=False))
    assert store.commit(CONFIG, draws_of(spark, [1, 2, 3], shift=500), more) == 2  # chain 4 has no draws
    got = {(r["chain"], r["draw"]): r["value"] for r in store.read(CONFIG, like).collect()}
    assert got == {(c, d): float(c * 100 + d + 500 * (c == 3)) for c in (1, 2, 3) for d in range(20)}
    assert {r["chain"] for r in store.read(CONFIG, like, completed=True).collect()} == {1, 2}
    assert {r["chain"]: r["rows"] for r in store.manifest(CONFIG).collect()} == {1: 20, 2: 20, 3: 20, 4: 0}
    assert store.read({**CONFIG, "epsilon": 0.1}, like).count() == 0


def test_foreign_seeds_and_stray_draws_are_refused(spark, tmp_path):
    store = DrawStore(spark, str(tmp_path / "store"))
    store.commit(CONFIG, draws_of(spark, [1]), listed(spark, [1]))
    with pytest.raises(InvalidTable, match="1 has 8, not 9"):
        store.commit(CONFIG, draws_of(spark, [1, 2]), listed(spark, [1, 2], seed=8))
    with pytest.raises(InvalidTable, match="not listed: 5"):
        store.commit(CONFIG, draws_of(spark, [2, 5]), listed(spark, [2]))
    assert {r["chain"] for r in store.read(CONFIG, draws_of(spark, [1])).collect()} == {1}


def test_torn_writes_are_never_read(spark, tmp_path):
    path = tmp_path / "store"
    store = DrawStore(spark, str(path))
    store.commit(CONFIG, draws_of(spark, [1]), listed(spark, [1]))
    done = next((path / "draws").glob("config=*"))
    draws_of(spark, [2]).write.partitionBy("chain").parquet(str(done / "attempt=torn"))  # written, never committed
    like = draws_of(spark, [1])
    assert {r["chain"] for r in store.read(CONFIG, like).collect()} == {1}
    assert store.commit(CONFIG, draws_of(spark, [2], shift=1), listed(spark, [2])) == 1
    assert store.read(CONFIG, like).where("chain = 2").agg({"value": "min"}).first()[0] == 201.0
    draws_of(spark, [1], shift=9).drop("chain").write.mode("append").parquet(str(next(p for p in done.glob("attempt=*/chain=1"))))
    with pytest.raises(InvalidTable, match="not what was committed: 1"):
        store.read(CONFIG, like)


def test_fields_grow_from_round_to_round(spark, tmp_path):
    reports = {1: {"cases": 5}, 2: {"cases": 7, "gates": {"fpr": 0.5}, "floor": [{"measure": "pp", "lo": 0.2}]}, 10: {"cases": 9, "gates": {"fpr": 0.25, "tpr": 1.0}, "floor": [{"measure": "pp", "lo": 0.3}, {"measure": "cuts", "hi": 40.0}]}, 11: {"cases": 1, "floor": []}}
    for n, r in reports.items():
        (tmp_path / f"round-{n}").mkdir()
        (tmp_path / f"round-{n}" / "results.json").write_text(json.dumps(r, indent=1))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "results.json").write_text("{}")
    got = rounds.read_rounds(spark, f"{tmp_path}/*/results.json")
    history = rounds.round_history(got, ["cases", "gates.fpr", "gates.tpr", "gates.tpr.deep", "auc"])
    assert {tuple(r) for r in history.collect()} == {(1, 5, None, None, None, None), (2, 7, 0.5, None, None, None), (10, 9, 0.25, 1.0, None, None), (11, 1, None, None, None, None)}
    floor = rounds.latest_floor(got)
    assert {tuple(r) for r in floor.collect()} == {("pp", 0.3, float("inf")), ("cuts", float("-inf"), 40.0)}
    assert rounds.latest_floor(got.select("round", "cases")).count() == 0
    cases = spark.createDataFrame([(1, "pp", 0.31), (1, "cuts", 40.0), (2, "pp", 0.25), (2, "cuts", 41.0), (3, "pp", 0.5), (4, "other", 1.0)], "plan long, metric string, value double")
    assert {r["plan"]: (r["legal"], r["broken"]) for r in rounds.checked_again(cases, floor).collect()} == {1: (True, []), 2: (False, ["cuts", "pp"]), 3: (False, ["cuts"]), 4: (False, ["cuts", "pp"])}


def test_criteria_against_plain_python(spark):
    """Deltas of two runs of different sizes, with ties, a constant criterion, a lumpy one that no cut divides, and nulls."""
    rng = random.Random(12)
    names = ("a", "b", "lumpy", "flat")
    rows = []
    for run, n in ((0.01, 120), (0.05, 301)):
        for i in range(n):
            a = rng.randrange(12)
            rows.append((run, i % 3, i, float(a), float(-a + rng.randrange(6)), float(i == 5), 3.0 if run == 0.01 else float(i % 2)))
    rows.append((0.05, 0, 999, None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "run double, chain long, draw long, " + ", ".join(f"{c} double" for c in names))
    c = ranking.Criteria(df, names)
    got = {(r["run"], r["target"], r["level"], r["other"]): r for r in c.deltas().collect()}
    want = set()
    for run in (0.01, 0.05):
        mine = [dict(zip(names, r[3:], strict=True)) for r in rows if r[0] == run and None not in r]
        varying = [x for x in names if len({m[x] for m in mine}) > 1]
        for t in varying:
            for q in ranking.LEVELS:
                cut = sorted((m[t] for m in mine), reverse=True)[max(1, round((1 - q) * len(mine))) - 1]
                keep, drop = [m for m in mine if m[t] >= cut], [m for m in mine if m[t] < cut]
                for o in varying:
                    if o != t:
                        want.add((run, t, q, o))
                        r = got[run, t, q, o]
                        refused = q > 0 and min(len(keep), len(drop)) < 0.01 * len(mine)
                        delta = 0.0 if q == 0 else None if refused else sum((x[o] > y[o]) - (x[o] < y[o]) for x in keep for y in drop) / (len(keep) * len(drop))
                        assert (r["kept"], r["excluded"], r["refused"]) == (len(keep), len(drop), refused)
                        assert r["delta"] == (None if delta is None else pytest.approx(delta))
    assert set(got) == want
    ranks = {(r["run"], r["criterion"]): r for r in c.ranking(reps=30).collect()}
    assert ranks[0.01, "flat"]["place"] is None and ranks[0.05, "a"]["displaces"] == "b" and ranks[0.05, "a"]["binds"] and ranks[0.05, "a"]["worst"] < ranks[0.05, "a"]["floor"] <= 0
    assert ranks[0.05, "lumpy"]["levels_refused"] == 4 and not ranks[0.05, "lumpy"]["binds"]
    assert sorted(r["place"] for k, r in ranks.items() if k[0] == 0.05) == [1, 2, 3, 4]
