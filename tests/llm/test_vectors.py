"""Hard negatives, vector codes and nearest neighbours against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardloom.llm import vp_search as vp
from wardloom.llm.hard_negatives import best_in_windows, bounds, curve_keys, mine_hard_negatives
from wardloom.llm.vector_codes import encode_vectors, limb_products, limbs, nearest
from wardloom.llm.vectors import products

ROW = "vec_id long, embedding array<float>, label int"


def table_of(n, dim, seed):
    """Vectors with clusters, exact copies of one of them, repeated rows, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim))
    x = middles[rng.integers(6, size=n)] * rng.choice([0.0, 0.5, 1.0], size=(n, 1)) + rng.normal(size=(n, dim)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 4] = x[0]
    rows = [(i, [float(v) for v in np.float32(x[i])], int(rng.integers(4))) for i in range(n)]
    rows += [rows[0], rows[3], rows[100 % n], (None, rows[5][1], 1), (None, rows[1][1], None), (n + 1, rows[2][1], None)]
    rows += [(100 * n, None, 1), (100 * n + 100, [0.0] * dim, 1), (50 * n, [float("nan")] * dim, 1), (7 * n, [float("inf")] + [0.0] * (dim - 1), 0), (9 * n, [None] + [0.0] * (dim - 1), 0), (11 * n, [], 2)]
    return rows


def frame(spark, rows, parts=7):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, ROW).selectExpr("*", "1 AS vec", "2 AS block", "'k' AS key", "3 AS c0", "4 AS score", "5 AS shard").repartition(parts)


def fine(rows):
    return [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]


def by_id(rid, rows):
    return (rows[rid][0] is None, rows[rid][0] or 0)


# --- hard negatives -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("bits", "dim"), [(1, 3), (2, 2), (3, 2), (2, 4), (4, 3)])
def test_curve_visits_neighbours(bits, dim):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
    keys = curve_keys(grid, bits)
    path = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
    assert len(set(keys)) == len(grid) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_hold_every_product(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-500, 500, size=(20, 5))
    q = rng.integers(-500, 500, size=(3, 5))
    low, high = bounds(q, x.min(axis=0)[None, :], x.max(axis=0)[None, :])
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all()


def negatives_by_hand(rows, scale, every, k, pct):
    keep = [r for r in fine(rows) if r[2] is not None]
    x = [[math.floor(scale * float(v)) for v in r[1]] for r in keep]
    dot = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    out = []
    for a, r in enumerate(keep):
        if r[0] is None or r[0] % every:
            continue
        best = sorted((-dot(a, b), by_id(b, keep), b) for b in range(len(keep)) if b != a)
        for s, _, p in [t for t in best if keep[t[2]][2] == r[2]][:k]:
            far = [t for t in best if keep[t[2]][2] != r[2] and pct * -s <= 100 * -t[0] <= 100 * -s][:k]
            out += [(r[0], keep[p][0], i, keep[n][0], -s, -t) for i, (t, _, n) in enumerate(far, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "dim", "scale", "pct"), [(900, 6, 256, 80), (300, 3, 40_000_000, 60), (60, 2, 3, 0)])
def test_hard_negatives(spark, monkeypatch, n, dim, scale, pct):
    import wardloom.llm.hard_negatives as h

    monkeypatch.setattr(h, "SORTED", 200)
    rows = table_of(n, dim, n)
    got = mine_hard_negatives(frame(spark, rows), scale=scale, every=20, positives=3, negatives=3, least_pct=pct)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives_by_hand(rows, scale, 20, 3, pct)
    assert sorted(map(tuple, got.collect()), key=repr) == want and want


def test_blocks_out_of_bounds_are_not_read(spark):
    """Far clusters of one label each: an anchor's windows meet few blocks, and all rows are found all the same."""
    from wardloom.llm.common import scratch_database
    from wardloom.llm.hard_negatives import Blocks
    from wardloom.llm.vectors import measure, whole_vectors

    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in 10.0 * np.eye(8)[i % 8] + rng.normal(size=8) * 0.1], i % 8 // 2) for i in range(4000)]
    kept = whole_vectors(frame(spark, rows))
    n, dim, top = measure(kept)
    home = scratch_database(spark)
    try:
        b = Blocks(kept, home, dim, top, 256, n)
        anchors = b.anchors(100, 5)
        pairs = b.chosen(anchors, True).selectExpr("length(anchors) DIV 8 AS n").agg({"n": "sum"}).first()[0]
        assert pairs < 0.5 * anchors.count() * b.blocks.count()
    finally:
        spark.sql(f"DROP DATABASE {home} CASCADE")
    got = mine_hard_negatives(frame(spark, rows[:800]))
    assert sorted(map(tuple, got.collect()), key=repr) == negatives_by_hand(rows[:800], 256, 100, 5, 80)


def test_hard_negatives_without_rows(spark):
    assert mine_hard_negatives(spark.createDataFrame([], ROW)).count() == 0
    assert mine_hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], ROW)).count() == 0
    with pytest.raises(ValueError, match="from 1 to 2"):
        mine_hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 2)], ROW))
    with pytest.raises(ArithmeticError):
        mine_hard_negatives(spark.createDataFrame([(1, [1e30], 1)], ROW))


def test_windows_keep_ties_in_order():
    scores = np.array([[5, 7, 7, 7, 1]])
    q, w, row = best_in_windows(scores, (np.array([9, 8, 2, 5, 1]), np.array([0, 0, 1, 0, 0])), np.array([[[2, 7], [9, 3]]]), 3)
    assert row.tolist() == [3, 1, 2] and w.tolist() == [0, 0, 0] and q.tolist() == [0, 0, 0]


# --- vector codes ---------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 28), st.integers(1, 24))
def test_limbs_give_exact_products(seed, size, bits):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(2**size), 2**size + 1, size=(n, 8)) for n in (5, 4))
    want = a.astype(object) @ b.astype(object).T
    assert (limb_products(a, b, bits) == want).all() and (limb_products(a, b) == want).all() and (products(a, b) == want).all()
    assert sum(x.astype(object) * 2 ** (bits * i) for i, x in enumerate(limbs(a, bits))).tolist() == a.tolist()


def test_nearest_takes_the_first_of_equal_ones():
    book = np.array([[2, 0], [0, 2], [2, 0]])
    best, apart = nearest(np.array([[1, 1], [2, 0]]), book)
    assert best.tolist() == [0, 0] and apart.tolist() == [2, 0]


def codes_by_hand(rows, scale, parts, entries, rounds):
    keep = sorted(fine(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(scale * float(v)) for v in r[1]] for r in keep]
    w = len(x[0]) // parts if x else 0
    cut = [[v[p * w : (p + 1) * w] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    best = lambda v, book: min((apart(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held: dict[int, list] = {}
            for v in cut[p]:
                held.setdefault(best(v, books[p])[1], []).append(v)
            for e, vs in held.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[best(cut[p][i], books[p]) for p in range(parts)] for i in range(len(keep))]
    errors = [sum(f[0] for f in fs) for fs in found]
    by: dict = {}
    for r, e in zip(keep, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{f[1]:02x}" for f in fs), e, by[r[2]], digest) for r, fs, e in zip(keep, found, errors, strict=True)), key=repr)


@pytest.mark.parametrize(("n", "dim", "scale"), [(400, 16, 4096), (120, 8, 100_000_000), (3, 8, 4096)])
def test_codes(spark, n, dim, scale):
    rows = table_of(n, dim, 5) if n > 3 else [(2, [0.5] * 8, None), (1, [-0.5] * 8, 3), (1, [-0.5] * 8, None)]
    got = encode_vectors(frame(spark, rows), scale=scale, rounds=4)
    assert sorted(map(tuple, got.collect()), key=repr) == codes_by_hand(rows, scale, 8, 16, 4)


def test_codes_of_odd_tables(spark):
    assert encode_vectors(spark.createDataFrame([], ROW)).count() == 0
    assert encode_vectors(spark.createDataFrame([(1, None, 1)], ROW)).count() == 0
    for bad, error in (([0.5] * 6, ValueError), ([1e30] * 8, ArithmeticError)):
        with pytest.raises(error):
            encode_vectors(spark.createDataFrame([(1, bad, 1)], ROW))


# --- nearest neighbours ---------------------------------------------------------------------------------------------

def neighbours_by_hand(rows, every, k):
    keep = [r for r in fine(rows) if any(r[1])]
    x = np.array([r[1] for r in keep])
    out = []
    for a, r in enumerate(keep):
        if r[0] is None or r[0] % every:
            continue
        score = vp.cosines(np.repeat(x[[a]], len(x), axis=0), x)
        order = sorted((b for b in range(len(keep)) if b != a), key=lambda b: (-score[b], by_id(b, keep)))[:k]  # noqa: B023
        out += [(r[0], i, keep[b][0], score[b]) for i, b in enumerate(order, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "dim", "leaf"), [(1500, 8, 16), (300, 3, 4), (40, 2, 128)])
def test_factor_one_is_exact(spark, monkeypatch, n, dim, leaf):
    monkeypatch.setattr(vp, "SHARD_BYTES", 150 * 8 * dim)
    monkeypatch.setattr(vp, "GROUP_BYTES", 9 * 8 * dim)
    rows = table_of(n, dim, n + 1)
    got = vp.nearest_neighbours(frame(spark, rows), every=20, k=4, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=repr) == neighbours_by_hand(rows, 20, 4)


def test_relaxed_search_reads_less_and_finds_most():
    """Recall against brute force by factor, on clusters of points; the registered query takes factor 1."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(60, 12)), 50, axis=0) + rng.normal(size=(3000, 12)) * 0.5
    q = x[::30] + rng.normal(size=(100, 12)) * 0.1
    order, nodes = vp.build_tree(vp.unit(x), 32)
    near = vp.unit(q) @ vp.unit(x).T
    want = np.argsort(-near, axis=1)[:, :5]
    read, recall = {}, {}
    for factor in (1.0, 2.0, 4.0):
        search = vp.Search(x[order], nodes, q, np.full(len(q), -1), 5, factor)
        i, j = search.run()
        hits = {(a, order[b]) for a, b in zip(i, j, strict=True)}
        recall[factor] = sum((a, b) in hits for a in range(len(q)) for b in want[a]) / want.size
        read[factor] = search.visited / (len(q) * len(x))
    assert recall[1.0] == 1.0 and recall[2.0] >= 0.9 and recall[4.0] >= 0.7
    assert read[4.0] < read[2.0] < read[1.0] < 1.1


def test_search_without_queries_or_candidates(spark):
    assert vp.nearest_neighbours(spark.createDataFrame([], ROW)).count() == 0
    assert vp.nearest_neighbours(spark.createDataFrame([(50, [0.0, 0.0], 1)], ROW)).count() == 0
    assert vp.nearest_neighbours(spark.createDataFrame([(50, [1.0, 0.0], 1)], ROW)).count() == 0
    assert vp.nearest_neighbours(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 1.0], 1)], ROW)).count() == 0
    tiny = [(50, [1e-38, 0.0], 1), (1, [3e38, 0.0], 1), (2, [0.0, 1e-40], 1)]
    assert [(r["vec_id"], r["score"]) for r in vp.nearest_neighbours(spark.createDataFrame(tiny, ROW)).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    with pytest.raises(ValueError, match="at least 1"):
        vp.nearest_neighbours(spark.createDataFrame([], ROW), factor=0.5)
