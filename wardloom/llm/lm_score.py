"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

``P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)``, where b is the bucket of the context's count (its
number of binary digits). The mixture weights of each bucket are learned by expectation-maximisation on held-out counts:
every part (one of ``FOLDS``) of a block of documents is held out in turn, its own counts taken off those of the corpus.

A context never seen has no bigram estimate; there the two others share the whole weight.

Work flow. Documents are gathered in blocks and written once, bucketed by block, so that later passes need no shuffle of
text. Each block sends its distinct n-grams with their counts, packed by hash range; each range sums them over a team of
blocks and answers every block with the totals in the block's own order. A pass over blocks and answers gathers the events'
histogram for the mixture weights, another scores the documents. All counts cover the whole training corpus.

A team has ``TEAM`` blocks in the mean. With more blocks than that the sums of teams are rows like those of blocks, in ranges
finer by the number of teams that meet, and are summed over teams of teams, and so on; totals come back the same way.
Ranges are made for the entries of one team (``RANGE_ENTRIES`` each), so a block sends the same number of rows however
large the corpus is, and no group of rows holds more than a team's, also where an n-gram is in every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_words, mix, scratch_database, settle, trimmed, words_of

#: Bytes of text in a block.
BLOCK_BYTES = 6_000_000
#: Parts of a block that are held out in turn.
FOLDS = 4
#: Blocks (or teams) whose rows meet in one sum, in the mean, and entries that one hash range gets of them.
TEAM, RANGE_ENTRIES = 512, 2_000_000
#: Context buckets, and steps of half an octave in which estimates are binned for the mixture weights.
BUCKETS, BINS = 40, 64
END = np.uint64(0x5DEECE66D1234567)
UNIGRAM, BIGRAM = 1, 2


def pack(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: differences, split in byte planes, compressed."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    raw = counts.astype("<i8")
    return zstandard.compress(raw.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Block:
    """The n-grams of a block: distinct words (END among them) and, if wanted, pairs, and for each token the number of its pair."""

    def __init__(self, texts: list[bytes | None], held: list[bool], pairs: bool = True) -> None:
        parts, lengths = [], []
        for t in texts:
            h = hash_words(words_of(t))
            parts += [h, np.array([END])]
            lengths.append(len(h) + 1)
        token = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.lengths = np.array(lengths, np.int64)
        self.words, self.at = np.unique(token, return_inverse=True)
        train = np.repeat(~np.array(held, bool), self.lengths)
        if not pairs:
            self.own_words = np.bincount(self.at[train], minlength=len(self.words))
            return
        before = np.concatenate([[END], token[:-1]]) if len(token) else token  # the end of one text is the context of the next one's first word
        self.fold = np.where(train, np.repeat(np.arange(len(self.lengths)) % FOLDS, self.lengths), -1)
        key = mix(mix(before) ^ token)
        self.pairs, first, self.pair_at = np.unique(key, return_index=True, return_inverse=True)
        context = np.searchsorted(self.words, before)
        self.pair_context, self.pair_word = context[first], self.at[first]
        self.own_words, self.own_pairs, _ = self.counts(train)

    def counts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Counts of words, pairs and all tokens among some tokens."""
        return np.bincount(self.at[which], minlength=len(self.words)), np.bincount(self.pair_at[which], minlength=len(self.pairs)), int(which.sum())


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_BYTES``; a block's number is its partition and its place in it."""
    part, n = TaskContext.get().partitionId(), 0
    ids, held, texts, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([part * (1 << 24) + n], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([texts], pa.list_(pa.string()))], names=["block", "bytes", "ids", "held", "texts"])

    for b in batches:
        for i, h, t in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            held.append(h)
            texts.append(t)
            size += len(t or "") + 16
            if size >= BLOCK_BYTES:
                yield out()
                n, ids, held, texts, size = n + 1, [], [], [], 0
    if ids:
        yield out()


def _block_of(row: dict, pairs: bool = True) -> Block:
    return Block([t.encode() if t is not None else None for t in row["texts"]], row["held"], pairs)


def _count_rows(ranges: int, pairs: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a block at a time
                row = b.slice(at, 1).to_pylist()[0]
                block = _block_of(row, pairs)
                rows = []
                for kind, keys, own in ((UNIGRAM, block.words, block.own_words), *([(BIGRAM, block.pairs, block.own_pairs)] if pairs else [])):
                    edges = np.append(np.searchsorted(keys, _starts(ranges)), len(keys))
                    for r, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        if z > a:
                            rows.append((kind, r, row["block"], pack(keys[a:z]), pack_counts(own[a:z])))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, COUNTS, strict=True)], schema=COUNTS)

    return run


def _starts(ranges: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """Where equal ranges of 64-bit keys begin, or some of them."""
    return np.array([(r << 64) // ranges for r in range(first, ranges if end is None else end)], np.uint64)


COUNTS = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = "kind int, range long, block long, totals binary"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one range: the distinct keys, their sums, which key each entry is, and where each row's entries begin and end."""
    keys = [unpack(k.as_py()) for k in table.column("keys")]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([unpack_counts(c.as_py()) for c in table.column("counts")]), minlength=len(every)).astype(np.int64)
    return every, total, at, np.cumsum([0] + [len(k) for k in keys])


def _answer_rows(table: pa.Table, total: np.ndarray, at: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """The columns of ``ANSWERS``: for each row the totals in the order of its own keys."""
    answers = [pack_counts(total[at[a:z]]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return [*(table.column(c) for c in ("kind", "range", "block")), pa.array(answers, pa.binary())]


def _sum_range(table: pa.Table) -> pa.Table:
    """Totals of one range over the whole corpus."""
    _, total, at, edges = _merged(table)
    n = table.num_rows
    return pa.table([*_answer_rows(table, total, at, edges), pa.array([int(total.sum())] * n, pa.int64()), pa.array([int((total > 0).sum())] * n, pa.int64())], names=["kind", "range", "block", "totals", "range_sum", "range_distinct"])


def _sum_team(ranges: int, finer: int):
    """The sums of a team over one of ``ranges``, as rows of a block that is named after the team, in ``finer`` ranges for this one."""

    def run(table: pa.Table) -> pa.Table:
        every, total, _, _ = _merged(table)
        kind, team, coarse = (table.column(c)[0].as_py() for c in ("kind", "team", "range"))
        edges = [int(e) for e in np.searchsorted(every, _starts(ranges * finer, coarse * finer, (coarse + 1) * finer))] + [len(every)]
        rows = [(kind, coarse * finer + r, team, pack(every[a:z]), pack_counts(total[a:z])) for r, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if z > a]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)

    return run


def _answer_team(table: pa.Table, upper: pa.Table) -> pa.Table:
    """The corpus totals of a team's range, which ``upper`` has in finer ranges, for each of its rows."""
    _, _, at, edges = _merged(table)
    upper = upper.sort_by("range")
    total = np.concatenate([unpack_counts(t.as_py()) for t in upper.column("totals")])
    return pa.table(_answer_rows(table, total, at, edges), names=["kind", "range", "block", "totals"])


def _answers(rows: DataFrame, blocks: int, ranges: int, kept, level: int = 0) -> tuple[DataFrame, int, int]:
    """``ANSWERS`` for the rows ``COUNTS`` of so many blocks, the sum of all unigrams' counts and the number of those counted."""
    if blocks <= TEAM:
        answers = kept(rows.groupBy("kind", "range").applyInArrow(_sum_range, f"{ANSWERS}, range_sum long, range_distinct long"), f"answers_{level}", "block")
        whole = answers.where(F.col("kind") == UNIGRAM).groupBy("range").agg(F.max("range_sum").alias("s"), F.max("range_distinct").alias("d")).agg(F.sum("s"), F.sum("d")).first()
        return answers.select("kind", "range", "block", "totals"), int(whole[0] or 0), int(whole[1] or 0)
    teams = -(-blocks // TEAM)
    finer = min(teams, TEAM)
    team = F.pmod(F.xxhash64("block", F.lit(level)), F.lit(teams)).cast("long")
    # written by team and range, so that the way up and the way down need no exchange
    rows = kept(rows.withColumn("team", team), f"counts_{level}", "kind", "range", "team")
    sums = rows.groupBy("kind", "range", "team").applyInArrow(_sum_team(ranges, finer), "kind int, range long, block long, keys binary, counts binary")
    upper, total, distinct = _answers(sums, teams, ranges * finer, kept, level + 1)
    upper = upper.withColumns({"coarse": F.floor(F.col("range") / finer), "team": F.col("block")})
    down = rows.groupBy("kind", "range", "team").cogroup(upper.groupBy("kind", "coarse", "team")).applyInArrow(_answer_team, ANSWERS)
    return kept(down, f"answers_{level}", "block"), total, distinct


class Estimates:
    """Estimates of a block's pairs by the counts of the corpus, less some that are held out."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int) -> None:
        self.words = words
        context = words[block.pair_context]
        self.bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0)).astype(np.int64))
        self.p2 = pairs / np.maximum(1, context)
        self.p1 = words[block.pair_word] / max(1, total)
        self.p0 = 1.0 / (distinct + 1)


def _totals(answers: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of a block's words and pairs."""
    mine = answers[answers["block"] == block].sort_values("range")
    got = [[unpack_counts(t) for t in mine["totals"][mine["kind"] == kind]] for kind in (UNIGRAM, BIGRAM)]
    return tuple(np.concatenate(g) if g else np.empty(0, np.int64) for g in got)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for 0, else half octaves below 1."""
    return np.where(p > 0, np.minimum(BINS - 1, 1 + np.floor(-2 * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


EVENTS = "cell long, n double, p2 double, p1 double"


def _events(total: int, distinct: int):
    def run(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        cells = []
        for row in blocks.to_dict("records"):
            block = _block_of(row)
            words, pairs = _totals(answers, row["block"])
            for f in range(FOLDS):
                own_words, own, own_total = block.counts(block.fold == f)
                e = Estimates(block, words - own_words, pairs - own, total - own_total, distinct)
                use = own > 0
                cell = ((e.bucket * BINS + _bin(e.p2)) * BINS + _bin(e.p1))[use]
                every, at = np.unique(cell, return_inverse=True)
                weigh = lambda x: np.bincount(at, weights=x, minlength=len(every))  # noqa: B023, E731
                cells.append(pd.DataFrame({"cell": every, "n": weigh(own[use].astype(float)), "p2": weigh(own[use] * e.p2[use]), "p1": weigh(own[use] * e.p1[use])}))
        return pd.concat(cells) if cells else pd.DataFrame({c: [] for c in ("cell", "n", "p2", "p1")})

    return run


def learn_weights(cells: pd.DataFrame, p0: float, rounds: int = 60, prior: float = 2.0) -> np.ndarray:
    """Mixture weights (bucket x 3: bigram, unigram, uniform) by expectation-maximisation over held-out events.

    Buckets with few events lean on the weights of all events together (``prior`` events' worth). In bucket 0, of contexts
    never seen, the bigram estimate is always 0: it gets no weight, and the others add up to 1.
    """
    out = np.tile(np.array([1 / 3] * 3), (BUCKETS, 1))
    if not len(cells):
        out[0] = 0.0, 0.5, 0.5
        return out
    n = cells["n"].to_numpy()
    p = np.column_stack([cells["p2"] / n, cells["p1"] / n, np.full(len(cells), p0)])
    bucket = (cells["cell"].to_numpy() // (BINS * BINS)).astype(int)

    def em(p: np.ndarray, n: np.ndarray, start: np.ndarray, lean: np.ndarray | None) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            got = (share * n[:, None]).sum(0) + (prior * lean if lean is not None else 0)
            w = np.maximum(got / got.sum(), 1e-9)
        return w / w.sum()

    overall = em(p, n, np.array([1 / 3] * 3), None)
    for b in range(BUCKETS):
        mine = bucket == b
        out[b] = em(p[mine], n[mine], overall, overall) if mine.any() else overall
    out[0, 0] = 0.0
    out[0] /= out[0].sum()
    return out


BASE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
SCORES = f"{BASE}, score double"


def _scores(total: int, distinct: int, weights: np.ndarray | None):
    """Rows of ``SCORES``, or without weights of ``BASE``."""

    def run(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.to_dict("records"):
            block = _block_of(row, weights is not None)
            words, pairs = _totals(answers, row["block"])
            word = np.log10((words + 1.0) / (total + distinct + 1))
            starts = np.concatenate([[0], np.cumsum(block.lengths)])[:-1]
            add = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            got = {"doc_id": pd.array(list(row["ids"]), "Int64"), "held_out": np.array(row["held"], bool), "n_tokens": block.lengths, "n_known": add((words[block.at] > 0).astype(np.int64)), "train_tokens": total, "base_score": add(word[block.at])}
            if weights is not None:
                e = Estimates(block, words, pairs, total, distinct)
                w = weights[e.bucket]
                pair = np.log10(w[:, 0] * e.p2 + w[:, 1] * e.p1 + w[:, 2] * e.p0)
                got["score"] = add(pair[block.pair_at])
            out.append(pd.DataFrame(got))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in (BASE if weights is None else SCORES).split(", ")})

    return run


def score_documents(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of bytes other than space and \\t-\\r with A-Z in lower case; one end token follows, and stands as the
    context of the first word. Training documents are those whose crc32(doc_id) modulo ``mod`` is not ``held``. base_score
    and score are log10 probabilities under the smoothed unigram model of the contract and the interpolated model. Null,
    empty and blank texts have the end token only. Repeated rows are counted and scored one by one; equal texts get equal
    scores. A very long text stands whole in the block that it falls to, which ends with it. Only doc_id and text are read. An empty table gives no rows;
    without training documents every estimate is the uniform one. The tables of blocks, counts and answers lie in a
    database of their own in the shared folder, which is dropped when the scores are written.
    """
    return _scored(docs, mod, held, model=True)


def base_scores(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """The rows of ``score_documents`` without score: blocks count their words alone, and no mixture is learned."""
    return _scored(docs, mod, held, model=False)


def _scored(docs: DataFrame, mod: int, held: int, model: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), (crc_mod("doc_id", mod) == held).alias("held"), F.col("text").cast("string").alias("text"))
    home = scratch_database(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(df: DataFrame, what: str, *by: str) -> DataFrame:
        df.write.bucketBy(parts, *by).option("compression", "zstd").saveAsTable(f"{home}.{what}")
        return spark.table(f"{home}.{what}")

    try:
        blocks = kept(rows.mapInArrow(trimmed(_gather), "block long, bytes long, ids array<long>, held array<boolean>, texts array<string>"), "texts", "block")
        size, n = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
        entries = size / 5 * min(1, TEAM / max(1, n))  # of one team, about five bytes of text for each
        ranges = max(1, round(entries / RANGE_ENTRIES))
        counts = blocks.mapInArrow(trimmed(_count_rows(ranges, model)), "kind int, range long, block long, keys binary, counts binary")
        answers, total, distinct = _answers(counts, n, ranges, kept)
        both = lambda f, schema: blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(f, schema)
        if not model:
            return settle(both(_scores(total, distinct, None), BASE))
        cells = both(_events(total, distinct), EVENTS).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
        weights = learn_weights(cells.orderBy("cell").toPandas(), 1.0 / (distinct + 1))  # at most BUCKETS x BINS x BINS cells
        return settle(both(_scores(total, distinct, weights), SCORES))
    finally:
        spark.sql(f"DROP DATABASE {home} CASCADE")
