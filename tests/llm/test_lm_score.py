from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from wardloom.llm import lm_score as lm


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def counts(corpus):
    one, two = Counter(), Counter()
    tokens = {r[0]: [w for w in (r[1] or "").encode().lower().split()] + [None] for r in corpus}
    for i, t in tokens.items():
        if not held(i):
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    return tokens, one, two


def test_counts_base_and_scores(docs, corpus):
    tokens, one, two = counts(corpus)
    n, v = sum(one.values()), len(one)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert len(got) == len(corpus)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    better = [got[i]["score"] > got[i]["base_score"] for i, t in tokens.items() if not held(i) and len(t) > 50]
    assert sum(better) > 0.8 * len(better)


def test_base_scores_need_no_pairs(docs, odd, monkeypatch):
    rows = lambda df: sorted(map(str, df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()))
    want = [rows(lm.score_documents(d)) for d in (docs, odd)]

    def never(*a, **k):
        raise AssertionError("no mixture is learned")

    monkeypatch.setattr(lm, "learn_weights", never)
    assert [rows(lm.base_scores(d)) for d in (docs, odd)] == want


def test_score_is_the_mixture_of_the_learned_weights(docs, corpus, monkeypatch):
    seen = {}
    learn = lm.learn_weights

    def keep(cells, p0, **k):
        seen["w"] = learn(cells, p0, **k)
        seen["events"] = cells["n"].sum()
        return seen["w"]

    monkeypatch.setattr(lm, "learn_weights", keep)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    tokens, one, two = counts(corpus)
    n, v = sum(one.values()), len(one)
    assert seen["events"] == n
    for i, t in tokens.items():
        total = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            w = seen["w"][min(lm.BUCKETS - 1, math.ceil(math.log2(one[a] + 1)))]
            total += math.log10(w[0] * two[a, b] / max(1, one[a]) + w[1] * one[b] / n + w[2] / (v + 1))
        assert got[i] == pytest.approx(total)


def test_blocks_don_t_matter(docs, monkeypatch):
    a = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "RANGE_ENTRIES", 50)
    b = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect()}
    assert a == b


def test_teams_of_blocks_give_the_totals_of_all(spark, docs, corpus, monkeypatch):
    """Small teams make several levels; an end of a text is in every block."""
    wanted = {r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect()}
    sent, make = [], lm._answers

    def seen(rows, blocks, ranges, kept, level=0):
        got = make(rows, blocks, ranges, kept, level)
        sent.append((level, blocks, rows.count()))
        return got

    monkeypatch.setattr(lm, "_answers", seen)
    docs = docs.repartition(12)  # as many blocks
    monkeypatch.setattr(lm, "TEAM", 3)
    monkeypatch.setattr(lm, "RANGE_ENTRIES", 300)
    got = {r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect()}
    assert got == wanted
    assert max(level for level, _, _ in sent) >= 2
    _, blocks, rows = min(sent)
    sent.clear()
    # twice the documents: twice the rows, at every level no more than a fixed number for each block of the first
    lm.score_documents(docs.union(docs)).count()
    _, blocks2, rows2 = min(sent)
    assert blocks2 > 1.8 * blocks
    assert rows2 / blocks2 < 1.15 * rows / blocks
    assert all(r <= 2 * rows2 for _, _, r in sent)


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(2)
    p2, p1 = rng.uniform(0, 0.2, 4000), rng.uniform(0, 0.05, 4000)
    use = rng.random(4000) < 0.7 * p2 / (0.7 * p2 + 0.3 * p1)
    cells = pd.DataFrame({"cell": 3 * lm.BINS * lm.BINS, "n": 1.0, "p2": np.where(use, p2, p2 * 0.01), "p1": p1})
    w = lm.learn_weights(cells, 1e-6)
    assert w.shape == (lm.BUCKETS, 3) and np.allclose(w.sum(1), 1) and w[3, 0] > 0.3 and w[3, 2] < 0.1


def test_learned_weights_equal_a_plain_expectation_maximisation(spark, corpus):
    """Deleted interpolation written out token by token, without bins, over the same held-out parts."""
    rows = [(r[0], r[1]) for r in corpus]
    seen = {}
    learn, lm_learn = lm.learn_weights, lm.learn_weights
    try:
        lm.learn_weights = lambda cells, p0, **k: seen.setdefault("w", learn(cells, p0, **k))
        lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).count()
    finally:
        lm.learn_weights = lm_learn
    tokens, one, two = counts(corpus)
    total, p0 = sum(one.values()), 1 / (len(one) + 1)
    events = []
    for f in range(lm.FOLDS):
        part = [tokens[i] for n, (i, _) in enumerate(rows) if n % lm.FOLDS == f and not held(i)]
        own1, own2 = Counter(t for x in part for t in x), Counter(p for x in part for p in zip([None, *x[:-1]], x, strict=True))
        left = total - sum(own1.values())
        for (a, b), n in own2.items():
            c = one[a] - own1[a]
            events.append((min(lm.BUCKETS - 1, math.ceil(math.log2(c + 1))), n, (two[a, b] - n) / max(1, c), (one[b] - own1[b]) / left, p0))

    def em(rows, start, lean):
        w = list(start)
        for _ in range(60):
            got = [2.0 * x for x in lean] if lean else [0.0] * 3
            for _, n, *p in rows:
                mass = [x * y for x, y in zip(w, p, strict=True)]
                for k in range(3):
                    got[k] += n * mass[k] / sum(mass)
            w = [x / sum(got) for x in got]
        return w

    overall = em(events, [1 / 3] * 3, None)
    for b in sorted({e[0] for e in events} - {0}):
        assert seen["w"][b] == pytest.approx(em([e for e in events if e[0] == b], overall, overall), abs=0.02), b
    assert seen["w"][0][0] == 0 and seen["w"].sum(1) == pytest.approx(np.ones(lm.BUCKETS))


def test_bucket_of_unseen_contexts_has_no_bigram_weight():
    cells = pd.DataFrame({"cell": [0, 3 * lm.BINS * lm.BINS], "n": [5.0, 9.0], "p2": [0.0, 3.0], "p1": [0.5, 0.2]})
    w = lm.learn_weights(cells, 0.01)
    assert w[0, 0] == 0 and np.allclose(w.sum(1), 1) and lm.learn_weights(cells.iloc[:0], 0.1)[0].tolist() == [0, 0.5, 0.5]


def test_tables_are_dropped(spark, docs):
    lm.score_documents(docs).count()
    assert [d.name for d in spark.catalog.listDatabases()] == ["default"] and not spark.catalog.listTables()


def test_packing_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack(lm.pack(keys)) == keys).all()
    assert (lm.unpack_counts(lm.pack_counts(np.arange(5))) == np.arange(5)).all()


def test_odd_rows(odd, nothing):
    """Null, empty and repeated rows have the end token, or their words, like any other."""
    got = sorted(((r["doc_id"], r["n_tokens"], r["held_out"]) for r in lm.score_documents(odd).collect()), key=str)
    assert got == sorted([(1, 13, held(1)), (1, 13, held(1)), (None, 13, held(None)), (None, 1, held(None)), (2, 1, held(2)), (2, 8, held(2)), (3, 1, held(3))], key=str)
    assert lm.score_documents(nothing).count() == 0


def test_a_very_long_text(spark):
    """Five megabytes in one text: scored whole, as a block of its own."""
    long = " ".join(f"w{i % 997}" for i in range(1_000_000))
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame([(1, long), (2, "w1 w2"), (5, long)], "doc_id long, text string")).collect()}
    assert got[1]["n_tokens"] == 1_000_001 and got[2]["n_tokens"] == 3 and got[1]["score"] == pytest.approx(got[5]["score"])
