"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a toxic lexicon (whole words, word beginnings, disguised spellings), second-person words near lexicon
words, capitals, punctuation and obfuscation rates. The lexicon starts from a short list and is extended by words and word
beginnings that labelled toxic documents use far more often than others; it is learned on other labelled rows than the
trees, and the calibration on yet others. Trees and calibration are Spark ML's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, settle, text_hash, trimmed, without_rows
from .textstats import byte_counts
from .training import MAX_LABELLED, finish, labelled_sample

# Insulting English words, second-person words of four languages, and letters that digits and signs stand for.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

#: Beginnings of words that may enter the lexicon, in characters.
BEGINNINGS = (4, 5)
#: A term enters if so many labelled toxic documents have it, and its rate there is so many times that elsewhere.
LEAST_DOCS, LEAST_RATIO, MAX_TERMS = 5, 8.0, 20_000
NEAR = 4
PARTITIONS = 8

WORD_HIT, BEGIN_HIT, DISGUISED_HIT, YOU, CAPITALS, OBFUSCATED, STRESSED = 1, 2, 4, 8, 16, 32, 64
N_FEATURES = 14
_EDGE = re.compile(r"^\W+|\W+$")
_TWICE = re.compile(r"(.)\1")
#: Words whose marks one task remembers before it starts afresh.
MAX_MARKED_WORDS = 500_000


def bare(word: str) -> str:
    """A word in lower case without punctuation at its ends."""
    return _EDGE.sub("", word).lower()


def terms(word: str) -> list[str]:
    """What a bare word may enter the lexicon as: itself, and its beginnings marked by a star."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


class Marks(dict):
    """The marks of a word as written (bytes), remembered."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        super().__init__()
        self.lexicon, self.you = lexicon, frozenset(SECOND_PERSON)

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= MAX_MARKED_WORDS:
            self.clear()
        written = raw.decode("utf-8", "replace")
        inner = _EDGE.sub("", written)
        word = inner.lower()
        mark = 0
        if word in self.lexicon:
            mark |= WORD_HIT
        if any(word[:k] + "*" in self.lexicon for k in BEGINNINGS if len(word) > k):
            mark |= BEGIN_HIT
        plain_letters = inner.isalpha()
        if len(inner) > 2 and not plain_letters and any(c.isalpha() for c in inner) and not inner.replace("-", "").replace("'", "").isalpha():
            mark |= OBFUSCATED
        if len(written) > 2 and not mark & WORD_HIT and (not plain_letters or written[0] != inner[0] or written[-1] != inner[-1] or _TWICE.search(word)):
            for form in (written, inner):
                plain = "".join(c for c in form.lower().translate(DISGUISES) if c.isalpha())
                squeezed = re.sub(r"(.)\1+", r"\1", plain)
                if plain != word and plain in self.lexicon or squeezed != word and squeezed in self.lexicon:
                    mark |= DISGUISED_HIT
        if word in self.you:
            mark |= YOU
        if len(word) > 1 and inner.isupper():
            mark |= CAPITALS
        if "!" in written or "?" in written:
            mark |= STRESSED
        self[raw] = mark
        return mark


def toxic_features(text: bytes | None, marks: Marks) -> list[float]:
    """``N_FEATURES`` features of a whole text; zeros without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    m = np.fromiter(map(marks.__getitem__, words), np.uint8, n)
    hit = (m & (WORD_HIT | BEGIN_HIT | DISGUISED_HIT)) > 0
    you = (m & YOU) > 0
    at = np.flatnonzero(hit)
    near = 0
    if len(at) and you.any():
        before = np.concatenate([[0], np.cumsum(you)])
        near = int((before[np.minimum(n, at + NEAR + 1)] > before[np.maximum(0, at - NEAR)]).sum())
    counts = byte_counts(text)
    chars = max(1, int(counts.sum()))
    kinds = [int(((m & k) > 0).sum()) for k in (WORD_HIT, BEGIN_HIT, DISGUISED_HIT)]
    gap = int(np.diff(at).min()) if len(at) > 1 else n
    return [
        float(np.log1p(n)),
        float(np.log1p(len(at))),
        len(at) / n,
        float(np.log1p(kinds[0])),
        kinds[0] / n,
        float(np.log1p(kinds[1])),
        kinds[1] / n,
        float(np.log1p(kinds[2])),
        near / n,
        float(((m & CAPITALS) > 0).mean()),
        float(((m & OBFUSCATED) > 0).mean()),
        float(((m & STRESSED) > 0).mean()),
        int(counts[33:48].sum() + counts[58:65].sum()) / chars,
        1.0 / max(1, gap),
    ]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct terms, with its label."""
    for b in batches:
        out, ys = [], []
        for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = {t for w in {bare(w) for w in (text or "").split()} if w for t in terms(w)}
            out += found
            ys += [y] * len(found)
        yield pa.record_batch([pa.array(out, pa.string()), pa.array(ys, pa.int32())], names=["term", "y"])


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Terms far more common in labelled toxic documents than in others, and the short list."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return frozenset(INSULTS)
    counts = sample.select("y", "text").mapInArrow(trimmed(_term_rows), "term string, y int").groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    ratio = ((F.col("c1") + 0.5) / (n1 + 1)) / ((F.col("c0") + 0.5) / (n0 + 1))
    found = counts.where((F.col("c1") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "term").limit(MAX_TERMS).select("term").collect()
    return frozenset(INSULTS) | {r["term"] for r in found}


def _feature_rows(lexicon, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(lexicon.value)
        for b in batches:
            x = [toxic_features(t, marks) for t in binary_column(b, "text")]
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 3, held: int = 1, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (chance of toxic 1), predicted (score >= threshold).

    Labels of documents whose crc32(doc_id) modulo ``mod`` is ``held`` are never used; at most ``max_labelled`` others are.
    Without labelled rows of both kinds the score is the rate of label 1 (0.5 without any). Null, empty and blank texts have
    zero features and are scored as such. Repeated rows are scored alike, and equal features give equal scores; a score
    at the threshold counts as toxic. Very long texts are read whole. Only doc_id and text are read of ``docs``. An empty
    table gives no rows. Options are those of :func:`_scored`.
    """
    return finish(_scored(docs, labels, mod, held, **options), mod, held, threshold)


def _scored(docs: DataFrame, labels: DataFrame, mod: int, held: int, max_labelled: int = MAX_LABELLED, trees: int = 20, depth: int = 3, seed: int = 3) -> DataFrame:
    """doc_id, h (the hash of the text) and score of each row."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("h", text_hash(F.col("text")))
    sample = settle(labelled_sample(docs, labels, "toxic", mod, held, max_labelled).repartition(PARTITIONS))
    rates = sample.groupBy().agg(F.avg("y").alias("rate"), F.countDistinct("y").alias("kinds")).first()
    if rates["kinds"] < 2:
        return hashed.select("doc_id", "h", F.lit(0.5 if rates["rate"] is None else float(rates["rate"])).alias("score"))
    lexicon = sc.broadcast(learn_lexicon(sample.where("part < 4")))
    table = settle(sample.where("part >= 4").mapInArrow(trimmed(_feature_rows(lexicon, ["y", "part"])), "y int, part int, x array<double>"))
    table = table.withColumn("features", array_to_vector("x"))
    if table.where("part < 8").select("y").distinct().count() < 2:
        return hashed.select("doc_id", "h", F.lit(float(rates["rate"])).alias("score"))
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=64, seed=seed, cacheNodeIds=False)
    model = gbt.fit(table.where("part < 8"))
    raw = vector_to_array(F.col("rawPrediction"))[1]
    cal = settle(model.transform(table.where("part >= 8")).select(raw.alias("raw"), F.col("y").cast("double").alias("y")))
    rows = hashed.mapInArrow(trimmed(_feature_rows(lexicon, ["doc_id", "h"])), "doc_id long, h long, x array<double>").withColumn("features", array_to_vector("x"))
    scored = model.transform(rows).select("doc_id", "h", raw.alias("raw"))
    if cal.limit(1).count():
        rise = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score").fit(cal)
        scored = rise.transform(scored)
    else:
        scored = scored.withColumn("score", 1 / (1 + F.exp(-2 * F.col("raw"))))
    return scored.select("doc_id", "h", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 3, held: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns. Each row is judged by its own text, also
    without doc_id or where several rows share one."""
    return without_rows(docs, _scored(docs, labels, mod, held, **options).where(F.col("score") >= threshold).select("doc_id", "h"))
