"""Texts of five megabytes go through the operators whole."""

from __future__ import annotations

import random

import pytest

from wardloom.llm.chat_format import format_digest
from wardloom.llm.decontaminate import contained_items
from wardloom.llm.ngram_join import document_links
from wardloom.llm.sharding import assign_shards


@pytest.fixture(scope="module")
def long() -> list[str]:
    rng = random.Random(3)
    return ["v" + str(rng.randrange(60_000)) for _ in range(800_000)]


def test_links_of_long_texts(spark, long):
    near = list(long)
    near[400_000] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:400_000])), (4, "a few words of its own here")]
    got = {r["doc_id"]: r for r in document_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: (r["component_id"], r["n_links"]) for i, r in got.items()} == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    assert got[1]["n_shingles"] > 790_000


def test_shards_of_long_texts(spark, long):
    text = " ".join(long)
    got = {r["doc_id"]: r for r in assign_shards(spark.createDataFrame([(1, text), (2, "x"), (3, text)], "doc_id long, text string"), shards=3).collect()}
    assert got[1]["size"] == len(text) + 16 and got[1]["shard"] == got[3]["shard"] != got[2]["shard"]


def test_long_turns(spark, long):
    text = " ".join(long) + " </turn>"
    rows = [(7, 0, "user", text), (7, 1, "assistant", text), (7, 2, "user", "ok")]
    (got,) = format_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got["n_turns"] == 3 and got["loss_chars"] == len(text) and got["n_windows"] == 3


def test_items_inside_long_texts(spark, long):
    item = " ".join("item" + str(i) for i in range(40))
    text = " ".join([*long[:700_000], item, *long[700_000:]])
    items = spark.createDataFrame([(1, item), (2, "quite another item of some words")], "item_id long, text string")
    got = contained_items(spark.createDataFrame([(1, text), (2, " ".join(long))], "doc_id long, text string"), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)]
