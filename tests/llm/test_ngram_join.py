from __future__ import annotations

import numpy as np
import pytest

from wardloom.llm import ngram_join as nj


def brute(rows, k, pct):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, r[0]), r[0])
    return {r[0]: (len(s), least[x]) for r, s, x in zip(rows, sets, label, strict=True)}


@pytest.mark.parametrize(("k", "pct"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(docs, corpus, k, pct):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.link_documents(docs, k, pct).collect()}
    assert got == brute(corpus, k, pct)


def test_small_blocks_and_no_frequency_order_give_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(nj, "BROADCAST_KEYS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.link_documents(docs, 4, 85, max_frequent=1).collect()}
    assert got == brute(corpus, 4, 85)


def jaccard_links(sets, pct):
    both = lambda a, b: len(np.intersect1d(a, b))
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * both(a, b) >= pct * (len(a) + len(b) - both(a, b))}


def parts_of(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[b] if x == label[a] else x for x in label]
    return [[i for i, y in enumerate(label) if y == z] for z in sorted(set(label), key=label.index)]


@pytest.mark.parametrize("heap_list", [0, 2, 1000])
@pytest.mark.parametrize("pct", [50, 80, 95])
def test_divide_skip_finds_every_link(monkeypatch, pct, heap_list):
    """Whether short lists are heap-merged or counted, all links are found, and the tree connects the same sets."""
    monkeypatch.setattr(nj, "HEAP_LIST", heap_list)
    rng = np.random.default_rng(pct)
    base = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(25)]
    sets = base + [np.unique(np.append(b[: max(1, len(b) - 2)], rng.integers(0, 60, 2).astype(np.uint64))) for b in base]
    want = jaccard_links(sets, pct)
    weight = rng.integers(1, 5, len(sets))
    links, tree, _ = nj.divide_skip(sets, pct, weight)
    assert links.tolist() == [sum(weight[b] if a == i else weight[a] for a, b in want if i in (a, b)) for i in range(len(sets))]
    assert {tuple(sorted(t)) for t in tree} <= want and parts_of(len(sets), tree) == parts_of(len(sets), want)
    _, tree, _ = nj.divide_skip(sets, pct, every=False)
    assert parts_of(len(sets), tree) == parts_of(len(sets), want)
    side = np.arange(len(sets)) % 2
    links, _, _ = nj.divide_skip(sets, pct, apart=lambda q, o: side[o] == side[q])
    assert links.tolist() == [sum(i in p and side[p[0]] != side[p[1]] for p in want) for i in range(len(sets))]


def test_a_large_group_of_near_copies_is_not_searched_pair_by_pair(spark, monkeypatch):
    """5,000 different near copies: those near their hub are linked as a ball, and the cells see few rows beside them."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words + [f"x{i}"])) for i in range(5000)] + [(9000 + i, " ".join(words[: 380 - 2 * i] + [f"y{i}"])) for i in range(6)]
    seen = []
    search = nj._search

    def counted(pct, every):
        run = search(pct, every)
        total = spark.sparkContext.accumulator(0)
        seen.append(total)

        def wrapped(table):
            total.add(table.num_rows)
            return run(table)

        return wrapped

    monkeypatch.setattr(nj, "_search", counted)
    got = {r["doc_id"]: r for r in nj.document_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()}
    assert all(got[i]["component_id"] == 0 for i in list(range(5000)) + [9000])
    for i in range(6):  # 398 - 2 i - 22 shingles shared with each of the 5,000
        n = 378 - 2 * i
        linked = 100 * (n - 1) >= 85 * (398 + n - (n - 1))
        assert got[9000 + i]["n_links"] == linked * 5000 + sum(100 * (min(n, 378 - 2 * j) - 1) >= 85 * (max(n, 378 - 2 * j) + 1) for j in range(6) if j != i)
    assert got[17]["n_links"] == 4999 + sum(got[9000 + i]["n_links"] >= 5000 for i in range(6))
    assert seen[0].value < 40_000  # 20 blocks of 250 would put 100,000 rows into pairs of blocks


def test_odd_rows(odd, nothing):
    got = sorted((tuple(r) for r in nj.link_documents(odd).collect()), key=str)
    assert len(got) == 7
    assert sum(r == (1, 9, 1) for r in got) == 2
    assert (None, 9, None) in got and (None, 0, None) in got and (3, 0, 3) in got and (2, 0, 2) in got and (2, 4, 2) in got
    assert nj.link_documents(nothing).count() == 0


def test_near_duplicates_keep_one_of_each_group(docs, corpus):
    kept = {r["doc_id"] for r in nj.near_duplicate_keep(docs).collect()}
    groups = brute(corpus, 5, 80)
    assert kept == {d for d, (_, c) in groups.items() if d == c}
    assert nj.near_duplicate_keep(docs).columns == docs.columns


def test_near_duplicates_of_odd_rows(odd, nothing):
    """Copies go also without doc_id; of repeated rows one stays; rows without words and other texts of an id stay."""
    out = nj.near_duplicate_keep(odd)
    assert out.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "a b c d e f g h i j k l"), (None, None), (2, None), (2, "quite another text of several words here"), (3, "")], key=str)
    assert nj.near_duplicate_keep(nothing).count() == 0


def test_near_copies_that_share_an_id_or_have_none(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(7, base), (7, base + " end"), (None, base + " fin"), (8, "other words stand here alone for once"), (None, "only without id " * 9), (None, "only without id " * 9)]
    out = nj.near_duplicate_keep(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id own", "text as `h`", "doc_id", "text", "1 gone_id"))
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == 3 and sorted(d for d, _ in kept if d) == [7, 8] and [t for d, t in kept if d is None] == ["only without id " * 9]


def sets_of(rows, k):
    out = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def linked(a, b, pct):
    return bool(a and b) and 100 * len(a & b) >= pct * len(a | b)


@pytest.mark.parametrize("members", [256, 3])
def test_every_link_is_found(docs, corpus, spark, monkeypatch, members):
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", members)
    words = [f"c{i}" for i in range(100)]  # a clique of eight near copies and a chain, whose components look the same
    clique = [(5000 + i, " ".join(words[:90] + [f"x{i}"]), "en", "s", 0) for i in range(8)]
    chain = [(6000 + i, " ".join(f"h{j}" for j in range(8 * i, 8 * i + 130)), "en", "s", 0) for i in range(6)]
    copies = [(7000 + i, clique[0][1], "en", "s", 0) for i in range(3)]
    every = corpus + clique + chain + copies
    sets = sets_of(every, 4)
    want = {d: sum(linked(a, b, 85) for e, b in sets.items() if e != d) for d, a in sets.items()}
    frame = spark.createDataFrame(every, docs.schema)
    got = nj.document_links(frame).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and len(got) == len(every)
    assert want[5000] == 10 and want[6000] == 1 and want[6001] == 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(every, 4, 85)


def test_links_of_odd_rows(odd, nothing):
    got = sorted((tuple(r) for r in nj.document_links(odd).collect()), key=str)
    assert len(got) == 7 and sum(r == (1, 9, 1, 0) for r in got) == 2
    assert (None, 9, None, None) in got and (3, 0, 3, 0) in got and (2, 4, 2, 0) in got
    assert nj.document_links(nothing).count() == 0


def test_sets_travel_in_less_than_their_hashes(spark):
    """A text of words takes less than its hashes, a text that repeats itself goes as its few hashes; both come back whole."""
    words = [f"word{i * i % 997}" for i in range(600)]
    prose, line = " ".join(words), "the same line again and again\n" * 5000
    rows = spark.createDataFrame([(1, prose), (2, line), (3, prose.upper() + " End")], "id long, text string")
    sets = {t: nj.shingle_set(t.encode(), 4) for t in (prose, line, prose.upper() + " End")}
    wanted = spark.createDataFrame([(*nj._keys(got), i) for i, got in enumerate(sets.values(), 1)], "k1 long, k2 long, rep long")
    sent = {r["k1"]: bytes(r["shingles"]) for r in nj._arrays(rows, wanted, 4).collect()}
    assert len(sent) == 3 and sum(map(len, sent.values())) < 0.6 * sum(got.nbytes for got in sets.values())
    for got in sets.values():
        assert nj.unpacked(sent[nj._keys(got)[0]]).tolist() == got.tolist()
    assert len(sent[nj._keys(sets[line])[0]]) == 4 + sets[line].nbytes
