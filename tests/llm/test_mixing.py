from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.llm import mixing as mx
from wardloom.llm.common import positions


def test_targets_stop_at_the_cap_and_share_the_rest():
    assert mx.targets([100, 100, 100], [3, 1, 2], 450) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mx.targets([10, 1000], [3, 1], 1000) == pytest.approx([20, 980])
    assert mx.targets([0, 10], [3, 1], 15) == pytest.approx([0, 15])
    assert mx.targets([], [], 0) == []


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 10, 257, 1000):
        out = mx.permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))
    assert list(mx.permute(np.arange(50), np.full(50, 50), np.full(50, 1, np.uint64))) != list(mx.permute(np.arange(50), np.full(50, 50), np.full(50, 2, np.uint64)))


def test_permutation_turns_back():
    for n in (1, 2, 5, 64, 300):
        j, many, key = np.arange(n), np.full(n, n), np.full(n, 7, np.uint64)
        assert (mx.permute(mx.permute(j, many, key), many, key, back=True) == j).all()


def test_slots_give_the_goal_exactly():
    for size in (1, 5, 127, 128, 129, 300, 1000):
        blocks = -(-size // 128)
        for source in range(3):
            for goal in range(0, 2 * size + 1, max(1, size // 50)):
                slots, last = mx.slots_for(goal, size, 128, source, 11)
                turn, j = np.divmod(np.arange(slots), blocks)
                number = mx.permute(j, np.full(slots, blocks), mx.pass_keys(np.full(slots, source), turn, 11))
                words = np.minimum(128, size - 128 * number)
                if slots:
                    assert last > 0
                    words[-1] = min(words[-1], last)
                assert words.sum() == goal


def test_drawn_counts_sum_to_the_slots():
    got = mx.draw_counts([50, 0, 7, 300], 9, 1)
    assert got.sum(0).tolist() == [50, 0, 7, 300] and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 1


def test_taken_words(docs, corpus):
    got = {r["doc_id"]: r for r in mx.mix_report(docs, block_words=16).collect()}
    assert len(got) == len(corpus)
    sizes, names = {}, {}
    for i, text, _, source, _ in corpus:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[i]["size"] == n and 0 <= got[i]["taken"] <= 2 * n
        sizes[source] = sizes.get(source, 0) + n
        names[i] = source
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mx.targets([sizes[s] for s in order], [mx.WEIGHTS[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values())), strict=True))
    for s in order:
        mine = [r for i, r in got.items() if names[i] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(goals[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goals[s]) <= 32
    again = {r["doc_id"]: r["taken"] for r in mx.mix_report(docs.repartition(2), block_words=16).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mixed_documents_hold_the_taken_words(docs):
    taken = {r["doc_id"]: r["taken"] for r in mx.mix_report(docs, block_words=16).collect()}
    out = mx.mix_documents(docs, block_words=16)
    assert out.columns == docs.columns
    held, original = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert r["n_chars"] == len(r["text"]) and set(w) <= set(re.findall(r"[^\x20\x09-\x0D]+", original[r["doc_id"]]))
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(w)
    assert held == {i: n for i, n in taken.items() if n}


@pytest.mark.parametrize("sizes", [[40] * 6, [1, 2, 3, 5, 8, 13], [7, 200, 55, 120, 33, 90], [30_000, 10, 150, 4_000]])
def test_small_sources_come_near_their_targets(spark, sizes):
    """Sources of any size, also below one block of 128, take their target, and their texts come back in few pieces."""
    rows = [(s * 1000 + d, " ".join(f"w{j}" for j in range(d, n, 10)), f"s{s}") for s, n in enumerate(sizes) for d in range(min(10, n))]
    got = mx.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    goals = mx.targets(sizes, [mx.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    for s, (n, goal) in enumerate(zip(sizes, goals, strict=True)):
        mine = [r for r in got if r["doc_id"] // 1000 == s]
        assert sum(r["size"] for r in mine) == n and all(r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal) <= 0.5


@pytest.mark.parametrize("size", [300, 2_000, 40_000])
def test_texts_are_not_shredded(spark, size):
    """A text is cut at ends of blocks of 128 words only, and once more where a source's last slot ends."""
    docs, left, i = [], size, 0
    while left:
        n = min(left, (44, 300, 7)[i % 3])
        docs.append((i, " ".join(f"b{i}_{j}" for j in range(n)), "small"))
        left, i = left - n, i + 1
    docs.append((i, " ".join(f"x{j}" for j in range(size)), "other"))
    out = mx.mix_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), share=1.4).collect()
    inner = 0
    for r in out:
        pieces = [[int(w.split("_")[-1].lstrip("x")) for w in line.split()] for line in r["text"].split("\n")]
        whole = len(docs[r["doc_id"]][1].split())
        assert all(p == list(range(p[0], p[-1] + 1)) for p in pieces)
        assert len(pieces) <= whole // 128 + 2
        inner += sum(p[0] > 0 for p in pieces) + sum(p[-1] < whole - 1 for p in pieces)
    assert inner <= 2 * (2 * size // 128 + 2) * 2


def test_columns_whose_names_are_ours(spark):
    rows = [(i, f"a{i} b c d e f", "s", 5, 6, 7, 8, 9) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, uses int, spans int, _id int, _h int, _key int")
    out = mx.mix_documents(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(5, 6, 7, 8, 9)}


def test_a_very_long_text(spark):
    """Five megabytes in one text are laid out and cut whole."""
    long = " ".join(f"w{i % 997}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, "x y z", "a"), (3, None, "a"), (4, "", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mx.mix_report(docs).collect()}
    assert got[1]["size"] == 1_000_000 and abs(got[1]["taken"] - 1_500_004) < 300 and got[3]["taken"] == got[4]["taken"] == 0
    assert sum(len(r["text"].split()) for r in mx.mix_documents(docs).collect()) == got[1]["taken"] + got[2]["taken"]


def test_odd_rows(odd, nothing):
    got = sorted(((r["doc_id"], r["size"], r["source_size"]) for r in mx.mix_report(odd).collect()), key=str)
    assert got == sorted([(1, 12, 24), (1, 12, 24), (None, 12, 12), (None, 0, 24), (2, 0, 7), (2, 7, 7), (3, 0, 12)], key=str)
    assert mx.mix_documents(odd).columns == odd.columns
    assert mx.mix_report(nothing).count() == 0
    assert mx.mix_documents(nothing).count() == 0


def test_rows_repeated_very_often_take_places_next_to_each_other(spark):
    """20,000 equal rows without an id among others: no gap, no overlap, and the mix takes what the target says."""
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of five words").alias("text"), F.lit("hot").alias("source"))
    other = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"), F.lit("hot").alias("source"))
    docs = same.union(other).repartition(5)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 5).otherwise(2).alias("size"), F.lit(1).alias("g"))
    got = sorted((r["start"], r["size"]) for r in positions(rows, ["g"], ["doc_id", "text"], F.col("size"), "start", per_cell=64).collect())
    assert len(got) == 23_000 and got[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    report = mx.mix_report(docs).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.max("target").alias("target")).first()
    assert report["n"] == 23_000 and report["over"] <= 0 and report["taken"] == round(report["target"])
    words = mx.mix_documents(docs).agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert words == report["taken"]
