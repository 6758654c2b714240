"""Mixing sources to target weights, in fixed-length token blocks.

Each source's documents are laid end to end and cut into blocks of ``block_words`` words (the last may be short). Output shards
draw multinomial counts of blocks from the sources until each source has its share. A source's slots are mapped through a
pseudorandom permutation of its block numbers (a new one for each pass over the source), and the blocks are joined to the
slots by number. The last slot of a source takes only as many words of its block as its target still lacks. The join key is
(source, block number), so a source that holds most rows is spread out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, mix, numbered, positions, settle, trimmed

WEIGHTS = (3.0, 1.0, 2.0)
#: Sources whose names and sums the driver holds at once.
MAX_SOURCES = 200_000
#: Words of a source within which the uses of equal rows are gathered.
STRETCH = 65_536


def targets(sizes: list[int], weights: list[float], budget: float, most: float = 2.0) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; what is above goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s], budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Block counts, shards x sources: each shard draws multinomially from what is left, so that the sums are ``slots``."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for s in range(shards):
        need = int(left.sum()) // (shards - s)
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[s] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def _half(n: np.ndarray) -> np.ndarray:
    """Bits of half a number of the permuted range, which holds 0..n-1."""
    return np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)


def permute(j: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1, elementwise: a four-round Feistel network that walks until it is below n. ``back`` gives
    the inverse: the rounds turned round, walking the other way."""
    half = _half(n)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = j.astype(np.uint64), np.ones(len(j), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        stir = lambda y, r: (mix(mix(y ^ (k + np.uint64(r))) ^ k) >> np.uint64(20)) & m  # noqa: B023, E731
        for r in range(4):
            left, right = (right ^ stir(left, 3 - r), left) if back else (right, left ^ stir(right, r))
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def pass_keys(sources: np.ndarray, turns: np.ndarray, seed: int) -> np.ndarray:
    """Key of the permutation of each pass over each source."""
    return mix(mix(np.full(len(sources), seed, np.uint64) ^ sources.astype(np.uint64)) ^ turns.astype(np.uint64))


def slots_for(goal: int, size: int, length: int, source: int, seed: int) -> tuple[int, int]:
    """Slots that a source fills, and how many words the last one takes at most, so that it takes ``goal`` words in all.

    Whole passes take all words. Of the pass that is broken off, each slot takes a full block, save the one that gets the short
    block at the end of the source.
    """
    if not size or not goal:
        return 0, 0
    blocks, (turns, rest) = -(-size // length), divmod(goal, size)
    if not rest:
        return turns * blocks, length
    tail = size - (blocks - 1) * length
    short = _at(blocks - 1, blocks, source, turns, seed)
    if rest <= short * length:
        used, taken = 0, 0
    else:
        used, taken = short + 1, short * length + tail
        if rest <= taken:
            return turns * blocks + used, rest - short * length
    more = -(-(rest - taken) // length)
    return turns * blocks + used + more, rest - taken - (more - 1) * length


def _at(block: int, blocks: int, source: int, turn: int, seed: int) -> int:
    """Which slot of a pass gets a block."""
    one = lambda x: np.array([x], np.int64)
    return int(permute(one(block), one(blocks), pass_keys(one(source), one(turn), seed), back=True)[0])


def _slot_rows(plan, length: int, seed: int):
    """Global slot number -> source, block number, output shard, pass, words at most; ``plan`` is the broadcast (offsets, blocks,
    ends, words of a source's last slot)."""
    schema = pa.schema([("source_no", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64()), ("pass", pa.int32()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, blocks, ends, last = plan.value
        for b in batches:
            at = b.column(0).to_numpy()
            src = np.searchsorted(offsets, at, "right") - 1
            slot = at - offsets[src]
            n = blocks[src]
            turn = slot // n
            number = permute(slot % n, n, pass_keys(src, turn, seed))
            most = np.where(slot == ends[-1, src] - 1, last[src], length)
            shard = np.zeros(len(at), np.int64)
            for s in np.unique(src):
                mine = src == s
                shard[mine] = np.searchsorted(ends[:, s], slot[mine], "right")
            yield pa.record_batch([pa.array(src, pa.int32()), pa.array(number), pa.array(shard, pa.int32()), pa.array(slot), pa.array(turn, pa.int32()), pa.array(most)], schema=schema)

    return run


class Mix:
    """The plan of one mix: ``rows`` (a row for each document with its place in its source) and ``pieces`` (parts of
    documents that the mix takes, one row for each slot they fall in)."""

    def __init__(self, docs: DataFrame, share: float = 1.5, most: float = 2.0, block_words: int = 128, shards: int = 64, weights: tuple[float, ...] = WEIGHTS, seed: int = 11) -> None:
        spark = docs.sparkSession
        text = F.col("text").cast("string")
        slim = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
        sums = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(sums) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [int(r["size"]) for r in sums]
        goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
        blocks = [-(-s // block_words) for s in sizes]
        filled = [slots_for(min(round(g), int(most * s)), s, block_words, i, seed) for i, (g, s) in enumerate(zip(goals, sizes, strict=True))]
        slots = [n for n, _ in filled]
        names = spark.createDataFrame([(r["source"], i, sizes[i], float(goals[i])) for i, r in enumerate(sums)], "name string, source_no int, source_size long, target double")
        rows = slim.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        self.rows = settle(positions(rows, ["source_no"], ["doc_id", "h", "size"], F.col("size"), "start"))
        ends = np.cumsum(draw_counts(slots, shards, seed), axis=0) if slots else np.zeros((shards, 0), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.array(slots, np.int64))])[:-1] if slots else np.zeros(0, np.int64)
        held = spark.sparkContext.broadcast((offsets, np.maximum(1, np.array(blocks, np.int64)), ends, np.array([n for _, n in filled], np.int64)))
        drawn = spark.range(sum(slots)).mapInArrow(trimmed(_slot_rows(held, block_words, seed)), "source_no int, block long, shard int, slot long, pass int, most long")
        length = F.lit(block_words)
        first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length)
        parts = self.rows.where("size > 0").select("doc_id", "h", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        met = parts.join(drawn, ["source_no", "block"])
        begin = F.greatest(F.col("start"), F.col("block") * length)
        end = F.least(F.col("start") + F.col("size"), F.col("block") * length + F.col("most"))
        self.pieces = met.select("source_no", "block", "doc_id", "h", "start", (begin - F.col("start")).alias("word"), (end - begin).alias("words"), "shard", "slot", "pass").where("words > 0")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size (words), source_size, target (its source's), taken.

    A null text has no words; a null source is a source of its own, named last. Rows without words take nothing. Repeated
    rows are laid out one by one; equal ones (ties) in any order, which gives the same rows. A very long text lies in as many
    blocks as it fills. An empty table gives no rows. Options are those of :class:`Mix`; the same input and seed give the
    same mix. The words taken of a source are its target, rounded.
    """
    plan = Mix(docs, **options)
    taken = plan.pieces.groupBy("source_no", "start").agg(F.sum("words").alias("words")).select(F.col("source_no").alias("s"), F.col("start").alias("at"), "words")
    out = plan.rows.join(taken, (F.col("source_no") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def _cut_texts(names: list[str], text_name: str):
    """Texts cut to their ``spans``; the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for b in batches:
            out = []
            for text, spans in zip(b.column(text_name).to_pylist(), b.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((s["word"], s["words"]) for s in spans):
                    if merged and merged[-1][1] == s[0]:
                        merged[-1][1] += s[1]
                    else:
                        merged.append([s[0], s[0] + s[1]])
                places = [m.span() for m in word.finditer(text)]
                if len(merged) == 1 and merged[0] == [0, len(places)]:
                    out.append(text)
                else:
                    out.append("\n".join(text[places[a][0] : places[z - 1][1]] for a, z in merged))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_name else b.column(n) for n in names], names=names)

    return run


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each document and pass that the mix takes words of.

    The text is what that pass takes: the whole text, or the runs of words taken, joined by line feeds. ``n_chars``, where
    present, is counted anew. Other columns are kept, whatever their names. Repeated rows count as often as they stand
    there; of rows with the same doc_id and text but other columns, one lends these to all.
    """
    plan = Mix(docs, **options)
    turn = plan.pieces.groupBy("doc_id", "h", "source_no", "start", "pass").agg(F.collect_list(F.struct("word", "words")).alias("spans"))
    # every copy of a row has its own place, next to those of the others; the text is fetched once for all copies of a stretch
    stretch = F.floor(F.col("start") / STRETCH)
    per = turn.groupBy("doc_id", "h", "source_no", stretch).agg(F.collect_list("spans").alias("uses")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "uses")
    rows, (doc, text) = numbered(docs, "doc_id", "text")
    keyed = rows.withColumns({"_doc": F.col(doc).cast("long"), "_key": F.xxhash64(F.col(text).cast("string"))})
    if plan.rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_doc", "_key"])
    met = keyed.join(per, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")))
    spread = met.select(*rows.columns, F.explode("uses").alias("spans"))
    cut = spread.mapInArrow(trimmed(_cut_texts(rows.columns, text)), rows.schema)
    if "n_chars" in docs.columns:
        _, (chars,) = numbered(docs, "n_chars")
        cut = cut.withColumn(chars, F.length(text).cast(rows.schema[chars].dataType))
    return cut.toDF(*docs.columns)
