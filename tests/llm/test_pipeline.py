from __future__ import annotations

import random

import pytest

import corpus_pipeline
from wardloom.llm import queries


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join("w" + str(rng.randrange(3000)) for _ in range(n))
    item = prose(35)
    rows, labels = [], []
    for i in range(240):
        text = prose(80)
        toxic = i % 6 == 5
        if toxic:
            text += " you idiot you loser scum"
        if i % 20 == 3:
            text += " " + item
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1] + " end", "en", "s1", 0) for i in range(0, 40, 10)]
    home = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    docs = spark.read.parquet(f"{home}/documents.parquet")
    expected = {
        "toxicity": {r[0] for r in rows if "idiot" not in r[1]},
        "near_copies": {r[0] for r in rows if "idiot" not in r[1] and r[0] < 1000},
        "benchmark": {r[0] for r in rows if "idiot" not in r[1] and r[0] < 1000 and item not in r[1]},
    }
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, home)
        assert (k == len(corpus_pipeline.STAGES) - 1) or out.columns == docs.columns
        path = f"{home}/out{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name in expected:
            assert {r["doc_id"] for r in docs.collect()} == expected[name], name
    assert docs.count() > 0 and {"doc_id", "shard", "slot"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, home).count() == docs.count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, uses int, spans string, _h int, `_part` int, token int, k1 int, score double"


def tables(spark, home, rows, labels, items):
    spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5, 6, 0.5) for r in rows], DOCS).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids and texts, repeated rows, ids with several texts, clashing columns, a text of megabytes: each stage keeps what it should."""
    rng = random.Random(5)
    prose = lambda n: " ".join("v" + str(rng.randrange(5000)) for _ in range(n))
    item, clean, bad = prose(30), prose(90), "you idiot you loser scum " * 4
    rows = [(i, prose(rng.randrange(30, 200)) + (" you idiot you loser scum" if i % 5 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(600)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(600)]
    other, long = prose(80), " ".join("long" + str(rng.randrange(90_000)) for _ in range(400_000))
    rows += [(None, clean, "en", "s0", 1), (None, clean, "en", "s0", 1), (None, bad + prose(60), None, None, 1), (None, prose(40) + " " + item, "en", "s1", 1), (None, None, "en", "s1", 0), (900, None, None, "s1", 0), (900, "", "en", None, 0)]
    rows += [(901, other, "en", "s1", 1), (901, other, "en", "s1", 1), (901, prose(50) + " " + item, "en", "s1", 1), (901, other + " end", "en", "s2", 1), (902, long, "en", "s3", 1)]
    home = str(tmp_path)
    tables(spark, home, rows, labels, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{home}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, home).write.parquet(f"{home}/out{k}")
        docs = spark.read.parquet(f"{home}/out{k}")
        assert docs.columns == columns
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    toxic = {r[1] for r in rows if r[1] and "idiot" in r[1]}
    assert sorted(map(str, kept["toxicity"])) == sorted(str(r[:2]) for r in rows if r[1] not in toxic)
    copies = [r for r in kept["near_copies"] if r[0] in (None, 900, 901)]
    assert sorted(map(str, copies)) == sorted(map(str, [(None, clean), (None, rows[603][1]), (None, None), (900, None), (900, ""), next(r for r in copies if r[0] == 901 and item not in r[1]), (901, rows[609][1])]))
    assert not [t for _, t in kept["benchmark"] if t and item in t] and len(kept["benchmark"]) == len(kept["near_copies"]) - 2
    assert (902, long) in kept["benchmark"] and all(t for _, t in kept["mixing"])
    out = corpus_pipeline.run(spark, home)
    assert out.count() == len(kept["mixing"]) and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark", "mixing", "sharding"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(30)), "s") for i in range(20)], "doc_id long, text string, source string").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    before = {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    keep = [(n, f) if n not in ("toxicity", "near_copies") else (n, lambda spark, docs, sf_dir: docs) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", keep)
    out = corpus_pipeline.run(spark, home)
    assert out.count() >= 20 and {r[0] for r in spark.sql("SHOW DATABASES").collect()} == before

    def broken(spark, docs, sf_dir):
        raise ValueError("stop")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*keep[:2], ("benchmark", broken), *keep[3:]])
    with pytest.raises(ValueError, match="stop"):
        corpus_pipeline.run(spark, home)
    assert {r[0] for r in spark.sql("SHOW DATABASES").collect()} == before
