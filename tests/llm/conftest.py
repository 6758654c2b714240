from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return ["w" + str(rng.randrange(vocabulary)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Small documents with exact and near copies, shared passages, junk, nulls, blanks and a hot source."""
    rng = random.Random(4)
    rows, texts = [], []
    passage = " ".join(words(rng, 30))
    for i in range(90):
        w = words(rng, rng.choice([3, 20, 60, 120, 300]))
        if i % 9 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        texts.append(" ".join(w))
    for i in range(60):
        base = texts[rng.randrange(40)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            base[rng.randrange(len(base))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(base))
    texts += [texts[3].upper(), texts[4].replace(" ", "\n"), "", None, "   ", "one", "one two", "a b c d", "Ünï çödé wörds hère", None, "repeat repeat repeat " * 40]
    for i, t in enumerate(texts):
        rows.append((i * 3 % 701, t, "en", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None, len(t or "")))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, repeated ids with other texts, extra columns with clashing names."""
    rows = [(1, "a b c d e f g h i j k l", "x", 1), (1, "a b c d e f g h i j k l", "x", 1), (None, "a b c d e f g h i j k l", None, 2), (None, None, "x", 3), (2, None, "y", 4), (2, "quite another text of several words here", "y", 5), (3, "", None, 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, component_id int").selectExpr("*", "1 as score", "'z' as token", "0 as shard", "5 as size", "2 as block", "3 as id", "4 as n")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
