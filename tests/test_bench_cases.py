"""Articulation, legal moves, null cases and matched starts, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wardloom.operators import cases, forest
from wardloom.operators import graph as gr


def parts_of(units, edges):
    left, n = set(units), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            u = todo.pop()
            near = {b for a, b in edges if a == u} | {a for a, b in edges if b == u}
            todo += list(near & left)
            left -= near
    return n


def test_every_removal_is_foreseen(spark):
    rng = random.Random(4)
    edges = [(u, v) for u in range(40) for v in range(u + 1, 40) if v - u in (1, 8) or rng.random() < 0.01]
    where = {p: {u: rng.randrange(3) if p else 0 if u < 35 else 1 + (u > 36) for u in range(40)} for p in (0, 1, 2, 3, 300)}
    a = spark.createDataFrame([(p, u, d) for p, m in where.items() for u, d in m.items()], "plan long, unit long, district int")
    e = spark.createDataFrame([(u, v, 1.0) for u, v in edges], "u long, v long, shared_len double")
    f = forest.spanning_forest(a, e)
    rows = {(r["plan"], r["unit"]): r for r in f.collect()}
    assert len(rows) == 5 * 40
    left = {}
    for p, m in where.items():
        for u, d in m.items():
            own = {x for x in m if m[x] == d}
            left[p, u] = parts_of(own - {u}, edges)
            r = rows[p, u]
            assert r["splits"] == left[p, u] - parts_of(own, edges) + 1
            assert (r["parent"] is None) == (r["root"] == u) and (r["parent"] is None or (min(u, r["parent"]), max(u, r["parent"])) in edges)
    want = {(r["plan"], r["unit"]): r["component"] for r in gr.components(a, e).collect()}
    assert {(r["plan"], r["unit"]): r["component"] for r in forest.parts(f).collect()} == want
    moves = gr.move_candidates(a, e, spark.range(40).selectExpr("id AS unit", "1 AS pop"), 5.0)
    got = forest.legal_moves(moves, f).collect()
    assert len(got) == moves.count() and all(r["parts_left"] == left[r["plan"], r["unit"]] and r["legal"] == (r["parts_left"] == 1) for r in got)
    assert {(r["plan"], r["unit"]) for r in forest.articulation_units(f).collect()} == {k for k, r in rows.items() if r["splits"] > 1}
    assert forest.spanning_forest(a.limit(0), e).count() == 0


def test_a_long_chain_of_units(spark):
    n = 30_000
    a = spark.range(n).selectExpr("0L AS plan", "id AS unit", "1 AS district")
    e = spark.range(n - 1).selectExpr("id AS u", "id + 1 AS v", "1.0D AS shared_len")
    got = forest.spanning_forest(a, e).groupBy("splits").count().collect()
    assert {r["splits"]: r["count"] for r in got} == {1: 2, 2: n - 2}


def nulls_by_hand(pool, sizes, seed):
    import hashlib
    from statistics import median

    middle, left, out = median(r["seats"] for r in pool), {}, []
    for r in sorted(pool, key=lambda r: r["plan"]):
        left.setdefault(r["key"], r)
    for stratum, n in sizes.items():
        rows = list(left.values())
        if stratum == "random":
            rows.sort(key=lambda r: hashlib.sha256(f"{seed}|{r['key']}".encode()).hexdigest())
        else:
            rank = (lambda r: (-r["concentration"], r["order"])) if stratum == "concentration" else (lambda r: (-abs(r["seats"] - middle), r["order"]))
            rows.sort(key=rank)
            up, down, level = ([r for r in rows if f(r["seats"] - middle)] for f in (lambda d: d > 0, lambda d: d < 0, lambda d: d == 0))
            first, second = (up, down) if len(up) >= len(down) else (down, up)
            turns = [x for i in range(len(first)) for x in (first[i : i + 1] + second[i : i + 1])]
            rows = turns + level
        distinct = len(left)
        for i, r in enumerate([r for r in rows if r["legal"]][:n], 1):
            out.append((f"null_{stratum}_{i:02d}", r["plan"], distinct))
            del left[r["key"]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_null_cases_fill_strata_in_turn(spark, seed):
    rng = random.Random(seed)
    kinds = [{"key": f"k{i}", "seats": rng.randrange(6), "concentration": rng.choice([0.1, 0.2, 0.3]), "legal": rng.random() < 0.8, "order": [rng.randrange(3) for _ in range(4)] + [i]} for i in range(30)]
    pool = [{"plan": p, **rng.choice(kinds)} for p in range(80)]
    df = spark.createDataFrame([(r["plan"], r["key"], r["seats"], r["concentration"], r["legal"], r["order"]) for r in pool], "plan long, key string, seats long, concentration double, legal boolean, order array<int>")
    sizes = {"concentration": 5, "seat_outcome": 6, "random": 40}
    got = cases.null_cases(df, sizes, 7).collect()
    assert [(r["case_id"], r["plan"], r["distinct_pool_size"]) for r in sorted(got, key=lambda r: (list(sizes).index(r["stratum"]), r["selection_rank"]))] == nulls_by_hand(pool, sizes, 7)
    assert len({r["plan"] for r in got}) == len(got) and all(r["in_gate_sample"] == (r["stratum"] != "seat_outcome") and r["pool_size"] == 80 for r in got)
    assert cases.null_cases(df.limit(0), sizes, 7).count() == 0
    with pytest.raises(ValueError, match="strata are"):
        cases.null_cases(df, {"other": 1}, 7)


def test_starts_resemble_their_anchor(spark):
    rng = random.Random(6)
    values = {p: [rng.choice([0.0, 1.0, 2.0, 3.0, rng.random() * 4]) for _ in range(3)] + [7.0] for p in range(120)}
    for p in (3, 50):
        values[p] = list(values[9])
    names = ("a", "b", "c", "d")
    rows = [(p, m, v) for p, vs in values.items() for m, v in zip(names, vs, strict=True) if not (p == 5 and m == "b")] + [(1, "other", 4.0)]
    draws = spark.createDataFrame(rows, "plan long, metric string, value double")
    key = {p: f"k{9 if p in (3, 50) else p // 2 * 2 if p >= 100 else p}" for p in values}
    keys = spark.createDataFrame(list(key.items()), "plan long, key string")
    got: dict = {}
    for r in cases.matched_starts(draws, keys, spark.createDataFrame([(9,), (20,), (119,), (5,)], "plan long"), names, 6).collect():
        got.setdefault(r["anchor"], {})[r["place"]] = r["plan"]
    import numpy as np

    have = [p for p in values if p != 5]
    iqr = [np.subtract(*np.percentile([values[p][i] for p in have], [75, 25])) for i in range(4)]
    first = {}
    for p in have:
        first.setdefault(key[p], p)
    for anchor in (9, 20, 119):
        near = [p for k, p in first.items() if k != key[anchor] and all(abs(values[p][i] - values[anchor][i]) <= iqr[i] / 2 + 1e-12 for i in range(4))]
        assert got.pop(anchor) == dict(enumerate([anchor, *sorted(near)[:5]]))
    assert not got  # a plan without all measures is no anchor
    assert cases.matched_starts(draws.where(F.col("metric") == "d"), keys, spark.createDataFrame([(9,)], "plan long"), ("d",), 3).count() == 3
