"""Quality and toxicity models: exact counts, held-out accuracy, calibration, odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wardloom.llm import quality_rff, quality_rules, textstats, toxicity, training

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    prose = ["the", "of", "river", "stone", "walks", "green", "under", "morning", "house", "you", "and", "light", "open", "quiet", "road"]
    for i in range(700):
        junk, toxic = rng.random() < 0.3, rng.random() < 0.25
        w = [rng.choice(prose) + str(rng.randrange(40)) for _ in range(rng.choice([60, 120, 200]))]
        if junk:
            w = [x.upper() + "!!" for x in w[:10]] * 8 if i % 2 else [x + "###" for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "you", "mudwort" + rng.choice("abcdef")]))
            w += ["loser", "mudworta"]
        rows.append((i, " ".join(w)))
        if i % 7:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(9001, None), (9002, ""), (9003, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    return docs, spark.createDataFrame(labels, LABELS).cache(), {r[0]: r[1:] for r in labels}


def accuracy(got, truth, at):
    both = [(r["predicted"], truth[r["doc_id"]][at]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in both) / len(both)


def test_quality_scores(labelled, odd, nothing, spark):
    docs, labels, truth = labelled
    got = quality_rff.score_quality(docs, labels).collect()
    assert len(got) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert accuracy(got, truth, 0) > 0.95
    rows = quality_rff.score_quality(odd, labels).collect()
    empty = {r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}
    assert len(rows) == 7 and len(empty) == 1
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 2, 2: 2, 3: 1} and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {zlib.crc32(b"") % 5 == 0}
    assert quality_rff.score_quality(nothing, labels).count() == 0
    assert {r["score"] for r in quality_rff.score_quality(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_held_out_labels_are_never_used(labelled):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality_rff.score_quality(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_rff.score_quality(docs, flipped).collect()}
    assert a == pytest.approx(b)


def test_toxicity_scores(labelled, odd, nothing, spark):
    docs, labels, truth = labelled
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert accuracy(got, truth, 1) > 0.95
    bad = {r["doc_id"] for r in got if r["predicted"]}
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()} == {r["doc_id"] for r in got} - bad
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 2, 2: 2, 3: 1} and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {zlib.crc32(b"") % 3 == 1}
    assert len({r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}) == 1
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()} <= {0.0, 0.5}


def test_disguised_words():
    marks = toxicity.Marks(frozenset(toxicity.INSULTS))
    assert marks[b"Idiot,"] & toxicity.WORD_HIT
    for w in (b"1d1ot", b"i.d.i.o.t", b"l0ser!", b"moooron", b"$tup1d"):
        assert marks[w] & toxicity.DISGUISED_HIT, w
    assert not marks[b"idea"] & (toxicity.WORD_HIT | toxicity.DISGUISED_HIT)
    x = toxicity.toxic_features(b"you are an idiot", marks)
    assert len(x) == toxicity.N_FEATURES and x[8] > 0


def exact(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if often[t] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_exact_counts(corpus):
    rng = random.Random(2)
    texts = [t for _, t, *_ in corpus] + ["".join(rng.choice("ab \n#é漢\t|\x0b\x85\xa0") for _ in range(rng.randrange(200))) for _ in range(300)] + ["x\nx\n x\n\n\nx", "a b c a b c a b"]
    for t in texts:
        assert textstats.base_counts(t.encode() if t is not None else None) == exact(t), t


def test_quality_rules(labelled, odd, nothing, spark):
    docs, labels, truth = labelled
    got = quality_rules.apply_rules(docs, labels).collect()
    assert len(got) == 703
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)
    judged = [(r["kept"], bool(truth[r["doc_id"]][0])) for r in got if r["doc_id"] in truth and not r["base_failed"]]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    rows = sorted(((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.apply_rules(odd, labels).collect()), key=str)
    assert rows == sorted([(1, 12, True, False), (1, 12, True, False), (None, 12, True, False), (None, 0, True, False), (2, 0, True, False), (2, 7, True, False), (3, 0, True, False)], key=str)
    assert quality_rules.apply_rules(nothing, labels).count() == 0
    assert quality_rules.apply_rules(docs, spark.createDataFrame([], LABELS)).where("kept = base_failed").count() == 0


def test_isotonic_is_the_least_squares_rise():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, 200) / 10
    y = (rng.random(200) < x / 3).astype(float)
    xs, ys = training.isotonic(x, y, smooth=0.0)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fit = np.interp(x, xs, ys)
    assert fit.mean() == pytest.approx(y.mean(), abs=0.02)
    assert ((fit - y) ** 2).sum() <= ((y.mean() - y) ** 2).sum()
    assert training.isotonic(np.zeros(0), np.zeros(0))[1].tolist() == [0.5]


def test_platt_slope_is_not_negative():
    assert quality_rules.platt(np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 0, 0]))[0] == 0.0
    a, b = quality_rules.platt(np.array([-2.0, -1, 1, 2] * 20), np.array([0.0, 0, 1, 1] * 20))
    assert a > 0 and abs(b) < 0.5


def test_words_disguised_at_their_end():
    marks = toxicity.Marks(frozenset({"worthless", "basura"}))
    for w in (b"worthles$", b"basur@", b"Basur@"):
        assert marks[w] & toxicity.DISGUISED_HIT, w
    for w in (b"basur,", b"worth$", b"worthless,"):
        assert not marks[w] & toxicity.DISGUISED_HIT, w


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    phi = quality_rff.Fourier(np.zeros(5), np.ones(5), 4096, 0.1, 3)
    z = phi(x)[:, :-1]
    kernel = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.09 and np.abs(z @ z.T - kernel).mean() < 0.02


def test_partition_sums_give_the_ridge_solution(labelled):
    """The weights equal a ridge solution of all training rows at once, and the scores those of a plain computation."""
    docs, labels, _ = labelled
    phi, w, xs, ys = quality_rff.fit(docs, labels)
    sample = [r for r in training.labelled_sample(docs, labels, "quality", 5, 0).collect()]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample)
    train = sorted((r for r in sample if r["part"] < 8), key=lambda r: r["doc_id"])
    x = np.array([textstats.quality_features(r["text"].encode()) for r in train])
    std = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.clip((x - x.mean(0)) / std, -6, 6)
    z = np.column_stack([np.cos(z @ phi.w + phi.b) * np.sqrt(2 / len(phi.b)), np.ones(len(x))])
    y = np.array([r["y"] for r in train], float)
    lam = 1e-3 * (z**2).sum() / z.shape[1]
    stacked = np.vstack([z, np.sqrt(lam) * np.eye(z.shape[1])])
    direct = np.linalg.lstsq(stacked, np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert z @ w == pytest.approx(z @ direct, abs=1e-6)
    got = {r["doc_id"]: r["score"] for r in quality_rff.score_quality(docs, labels).collect()}
    assert [got[r["doc_id"]] for r in train] == pytest.approx(np.interp(z @ direct, xs, ys), abs=1e-4)


def plain_toxic_features(text, lexicon):
    """The features of a text, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    strip = lambda w: re.sub(r"^\W+|\W+$", "", w)

    def kinds(w):
        inner = strip(w)
        word = inner.lower()
        whole = word in lexicon
        begins = any(len(word) > k and word[:k] + "*" in lexicon for k in (4, 5))
        forms = [re.sub(r"[^a-z]", "", f.lower().translate(toxicity.DISGUISES)) for f in (w, inner)]
        forms += [re.sub(r"(.)\1+", r"\1", f) for f in forms]
        return whole, begins, len(w) > 2 and not whole and any(f != word and f in lexicon for f in forms)

    hits = [kinds(w) for w in words]
    at = [i for i, h in enumerate(hits) if any(h)]
    you = [i for i, w in enumerate(words) if strip(w).lower() in toxicity.SECOND_PERSON]
    inside = [strip(w) for w in words]
    odd = [len(w) > 2 and any(c.isalpha() for c in w) and not w.replace("-", "").replace("'", "").isalpha() for w in inside]
    chars = len("".join(words)) + len(re.findall(r"[\x20\x09-\x0D]", text))
    punctuation = len(re.findall(r"[!-/:-@]", text))
    return {
        0: np.log1p(n), 1: np.log1p(len(at)), 2: len(at) / n,
        3: np.log1p(sum(h[0] for h in hits)), 4: sum(h[0] for h in hits) / n, 5: np.log1p(sum(h[1] for h in hits)), 6: sum(h[1] for h in hits) / n, 7: np.log1p(sum(h[2] for h in hits)),
        8: sum(any(abs(i - j) <= 4 for j in you) for i in at) / n,
        9: sum(len(w) > 1 and w.isupper() for w in inside) / n, 10: sum(odd) / n, 11: sum("!" in w or "?" in w for w in words) / n,
        12: punctuation / chars, 13: 1 / max(1, min((b - a for a, b in zip(at, at[1:], strict=False)), default=n)),
    }


def test_toxic_features_equal_a_plain_count():
    lexicon = frozenset(toxicity.INSULTS) | {"mudwo*", "scumm", "gross"}
    marks = toxicity.Marks(lexicon)
    rng = random.Random(8)
    pool = ["you", "your", "U", "idiot", "Idiot!", "1d1ot", "mudworts", "STUPID", "gr0ss", "calm", "A", "IT", "end.", "what?!", "x-ray", "it's", "b4d", "scummm", "(loser)", "tu", "...", "l0$er"]
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(1, 40)))
        got = toxicity.toxic_features(text.encode(), marks)
        want = plain_toxic_features(text, lexicon)
        for k, v in want.items():
            assert got[k] == pytest.approx(v), (k, text)


def test_the_rules_model_equals_a_plain_one(labelled, spark):
    """AdaGrad and averaging written out row by row over dictionaries give the same scores; a rerun over other partitions too."""
    docs, labels, _ = labelled
    small = labels.where("doc_id < 220")
    w, slope, intercept = quality_rules.fit(docs, small)
    rows = training.labelled_sample(docs, small, "quality", 1, -1).withColumn("h", quality_rules.F.xxhash64("text")).collect()

    def parts(text):
        out = {}
        for ids in quality_rules.features(text.encode()):
            for i, c in Counter(ids.tolist()).items():
                out[i] = c / len(ids)
        return out

    weights = {}
    last = quality_rules.FAMILIES * quality_rules.BUCKETS
    for _ in range(2):
        sums, total = Counter(), 0
        for g in range(quality_rules.GROUPS):
            mine = sorted((r for r in rows if r["part"] < 8 and r["part"] % quality_rules.GROUPS == g), key=lambda r: (r["doc_id"], r["h"]))
            own, squares = dict(weights), {}
            order = np.random.default_rng(3)
            for _ in range(3):
                for n in order.permutation(len(mine)):
                    x = parts(mine[n]["text"])
                    miss = 1 / (1 + np.exp(-(own.get(last, 0.0) + sum(own.get(i, 0.0) * v for i, v in x.items())))) - mine[n]["y"]
                    for i, v in [*x.items(), (last, None)]:
                        step = miss if v is None else miss * v + 1e-5 * own.get(i, 0.0) * v
                        squares[i] = squares.get(i, 1e-6) + step * step
                        own[i] = own.get(i, 0.0) - 2.0 * step / squares[i] ** 0.5
            total += len(mine)
            for i, v in own.items():
                sums[i] += v * len(mine)
        weights = {i: v / total for i, v in sums.items()}
    for r in rows:
        plain = weights.get(last, 0.0) + sum(weights.get(i, 0.0) * v for i, v in parts(r["text"]).items())
        assert quality_rules.logit(quality_rules.features(r["text"].encode()), w) == pytest.approx(plain, abs=1e-3)
    again = quality_rules.fit(docs.repartition(7), small)
    assert (again[0] == w).all() and again[1:] == (slope, intercept)


def test_very_long_texts(labelled, spark):
    """Five megabytes in one text go through each model whole."""
    docs, labels, _ = labelled
    long = spark.createDataFrame([(50_001, "plain words stand here " * 220_000), (50_002, "you idiot " * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.apply_rules(docs.unionByName(long), labels).where("doc_id > 50000").collect()} == {50_001: 880_000, 50_002: 1_000_000}
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs.unionByName(long), labels).where("doc_id > 50000").collect()}[50_002] == 1
    assert quality_rff.score_quality(docs.unionByName(long), labels).where("doc_id > 50000").count() == 2


def test_labelled_sample_is_bounded_by_rows(spark):
    """An id on very many rows, equal or not, gives no more rows than the bound; repeated ones are one."""
    copies = spark.range(60_000).selectExpr("7L AS doc_id", "'the same text' AS text")
    many = spark.range(3_000).selectExpr("8L AS doc_id", "concat('text ', id) AS text")
    docs = copies.unionByName(many).unionByName(spark.createDataFrame([(9, None), (9, None), (None, "x"), (10, "unlabelled")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1), (None, 1), (11, 1)], "doc_id long, quality int")
    got = training.labelled_sample(docs, labels, "quality", 1, -1).collect()
    assert len(got) == 3002 and {r["doc_id"]: r["y"] for r in got} == {7: 1, 8: 0, 9: 1}
    some = training.labelled_sample(docs, labels, "quality", 1, -1, max_rows=500).collect()
    assert len(some) == 500 and {(r["doc_id"], r["text"]) for r in some} <= {(r["doc_id"], r["text"]) for r in got}
