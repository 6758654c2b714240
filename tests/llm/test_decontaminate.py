from __future__ import annotations

import random
import re

import pytest

from wardloom.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, k=5, share=0.8):
    out = set()
    for item, text in items:
        w = tokens(text)
        q = grams(w, min(k, len(w))) if w else set()
        for doc, t in docs:
            n = len(q & grams(tokens(t), min(k, len(w))))
            if q and n >= share * len(q) - 1e-9:
                out.add((doc, item, len(q), n))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 12, 30, 31, 36, 40, 70, 200])] + [(50, None), (51, ""), (52, "..."), (53, "same text as this one here"), (54, "same text as this one here")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.choice([0, 10, 100, 900]))]
        if d % 3 == 0 and items[d % 11][1]:
            q = items[d % 11][1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                q[rng.randrange(len(q))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in q]
        docs.append((d, " ".join(w)))
    docs += [(200, "Same, text as THIS one here!"), (201, None), (202, "")]
    return docs, items


@pytest.mark.parametrize("block", [20_000_000, 700])
def test_equals_brute_force(spark, tables, block):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in dc.contained_items(d, i, block_bytes=block).collect()}
    assert got == brute(docs, items)


def test_filter_keeps_clean_documents(spark, tables):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    bad = {x[0] for x in brute(docs, items)}
    assert {r["doc_id"] for r in dc.decontaminate(d, i).collect()} == {x[0] for x in docs} - bad


def test_odd_rows(spark, odd, nothing):
    i = spark.createDataFrame([(1, "a b c d e f g"), (None, "quite another text of several words")], ITEMS).selectExpr("*", "1 as doc_id", "2 as n")
    got = dc.contained_items(odd, i).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None and r["item_id"] is not None) == [(1, 1), (1, 1)]
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (None, 1), (2, None)}
    assert dc.contained_items(nothing, i).count() == 0
    assert dc.contained_items(odd, spark.createDataFrame([], ITEMS)).count() == 0
    clean = dc.decontaminate(odd.withColumn("gone_id", odd.doc_id), i)
    assert clean.columns == [*odd.columns, "gone_id"]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == [(2, None), (3, ""), (None, None)]
