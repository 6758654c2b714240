from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from wardloom.llm import sharding as sh


def best(sizes, shards):
    """The smallest largest sum of a contiguous partition, by dynamic programming."""
    n = len(sizes)
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    row = [total[i] for i in range(n + 1)]
    for _ in range(shards - 1):
        row = [0] + [min(max(row[j], total[i] - total[j]) for j in range(i + 1)) for i in range(1, n + 1)]
    return row[n]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_capacity_is_the_optimum(docs, shards, monkeypatch):
    monkeypatch.setattr(sh, "FIRST_BITS", 3)
    rows = sh.describe(docs).cache()
    groups = [r["s"] for r in rows.groupBy("h").agg(F.sum("size").alias("s")).orderBy("h").collect()]
    cuts, capacity = sh.find_cuts(rows, shards)
    assert capacity == best(groups, shards)
    loads = rows.withColumn("shard", sh.shard_number(F.col("h"), cuts)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in loads) == capacity or max(r["s"] for r in loads) <= capacity
    assert all(0 <= r["shard"] < shards for r in loads)


def test_rows(docs, corpus):
    got = {r["doc_id"]: r for r in sh.assign_shards(docs, 10).collect()}
    assert len(got) == len(corpus)
    by_text = {}
    for i, text, *_ in corpus:
        r = got[i]
        assert r["size"] == len((text or "").encode()) + 16
        assert r["text_crc32"] == zlib.crc32((text or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert by_text.setdefault(text, r["shard"]) == r["shard"]
    for s in {r["shard"] for r in got.values()}:
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_hot_text_leaves_no_shard_empty(spark):
    rng = random.Random(1)
    rows = [(i, "hot " * 30, None, None, 0) for i in range(100)] + [(100 + i, f"text {rng.random()}" * 3, None, None, 0) for i in range(400)]
    got = sh.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 8)
    loads = {r["shard"]: r["s"] for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert set(loads) == set(range(8))
    assert max(loads.values()) == max(100 * (120 + 16), max(loads.values()))


def test_odd_rows(odd, nothing):
    got = sh.assign_shards(odd, 4).collect()
    assert len(got) == 7
    assert {r["slot"] for r in got if r["shard"] == got[0]["shard"]} == set(range(sum(r["shard"] == got[0]["shard"] for r in got)))
    assert sh.assign_shards(nothing, 4).count() == 0


def test_files(docs, tmp_path, spark):
    sh.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
