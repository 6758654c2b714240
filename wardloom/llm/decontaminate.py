"""Benchmark decontamination: which documents contain which test items.

Method (size-partitioned MinHash containment search): items are partitioned by their number of shingles into classes with
upper bounds ``u`` = 1, 2, 4, ... For each class a document's shingles are cut into tiles of ``u``; a window is two tiles
side by side, so any run of ``u`` shingles lies in one window and an item's Jaccard similarity with that window has a
known lower bound. That bound decides how many MinHash values are compared; one equal value makes (document, item) a
candidate. Every candidate is verified on the whole document: the share of the item's distinct shingles that the document
has must reach the threshold.

Items are broadcast in blocks of at most about ``block_bytes`` of text, so a larger benchmark costs more passes, not more
memory; only a single item's text is not divided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, binary_column, hash_words, mix, text_hash, trimmed, windows, without_rows

#: Chance that an item at the threshold, in one run of words, has no MinHash value in common with its window.
MISS = 1e-5

#: A-Z to lower case, ASCII characters other than letters and digits to spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def bands(u: int, share: float) -> int:
    """MinHash values needed for items of u/2 to u shingles, of which ``share`` lie in a window of 2u."""
    s = u // 2 + 1
    j = share * s / (2 * u + (1 - share) * s)
    return max(1, math.ceil(math.log(MISS) / math.log(1 - j)))


def _seeds(n: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * MIX)) | np.uint64(1)


class ItemIndex:
    """Test items, by size class, with their MinHash values for each band."""

    def __init__(self, items: list[tuple[int, bytes | None]], k: int, share: float) -> None:
        self.k, self.share = k, share
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        classes: dict[tuple[int, int], list[int]] = {}
        for item, text in items:
            words = plain_words(text)
            if not words:
                continue
            width = min(k, len(words))
            got = np.unique(windows(hash_words(words), width))
            classes.setdefault((width, 1 << (len(got) - 1).bit_length()), []).append(len(self.ids))
            self.ids.append(item)
            self.sets.append(got)
        self.classes = []
        for (width, u), members in sorted(classes.items()):
            seeds = _seeds(bands(u, share))
            values = np.array([[(self.sets[i] * s).min() for s in seeds] for i in members], np.uint64)
            order = np.argsort(values, axis=0, kind="stable")
            self.classes.append((width, u, seeds, np.take_along_axis(values, order, 0), np.array(members)[order]))

    def candidates(self, shingles: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(document, item) pairs with an equal MinHash value, for documents laid end to end."""
        out: set[tuple[int, int]] = set()
        for w, u, seeds, values, members in self.classes:
            if w != width or not len(shingles):
                continue
            tiles = -(-lengths // u)
            doc = np.repeat(np.arange(len(lengths)), tiles)
            first = np.concatenate([[0], np.cumsum(tiles)])[:-1]
            cut = starts[doc] + (np.arange(len(doc)) - first[doc]) * u
            pair = doc[1:] == doc[:-1]
            for b, seed in enumerate(seeds):
                least = np.minimum.reduceat(shingles * seed, cut)
                least[:-1][pair] = np.minimum(least[:-1], least[1:])[pair]  # with the tile that follows
                column = values[:, b]
                low = np.searchsorted(column, least)
                hit = np.flatnonzero(column[np.minimum(low, len(column) - 1)] == least)
                for i in hit:
                    j = low[i]
                    while j < len(column) and column[j] == least[i]:
                        out.add((int(doc[i]), int(members[j, b])))
                        j += 1
        return out


#: Shingles whose MinHash values are found together.
CHUNK = 100_000


def _matches(index):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64())])

    def search(held: list[tuple], idx: ItemIndex) -> list[tuple]:
        rows = []
        for width in sorted({c[0] for c in idx.classes}):
            parts = [(doc, windows(h, width)) for doc, h in held if len(h) >= width]
            if not parts:
                continue
            lengths = np.array([len(p) for _, p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            own: dict[int, np.ndarray] = {}
            for d, i in sorted(idx.candidates(np.concatenate([p for _, p in parts]), starts, lengths, width)):
                if d not in own:
                    own[d] = np.unique(parts[d][1])
                item = idx.sets[i]
                at = np.searchsorted(own[d], item)
                at[at == len(own[d])] = 0
                shared = int((own[d][at] == item).sum())
                if shared >= idx.share * len(item) - 1e-9:
                    rows.append((*parts[d][0], idx.ids[i], len(item), shared))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        for b in batches:
            held, size, rows = [], 0, []
            for doc, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), binary_column(b, "text"), strict=True):
                words = hash_words(plain_words(text))
                held.append(((doc, h), words))
                size += len(words)
                if size >= CHUNK:
                    rows += search(held, idx)
                    held, size = [], 0
            rows += search(held, idx)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


#: Bytes of item text whose index is broadcast at once, as a rule.
BLOCK_BYTES = 8_000_000


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for each document row and item that it contains.

    Words: A-Z in lower case, runs of characters other than ASCII space, control and punctuation. Shingles: ``k`` words;
    an item with fewer words is one shingle of all of them, sought among the document's runs of that length. Null, empty
    and wordless items or texts give no rows; repeated document rows or items give a row each. Very long texts are searched
    whole. Other columns are not read. Ties don't arise: every item at or over ``share`` counts.
    """
    return _contained(docs, items, k, share, block_bytes).drop("h").withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def _contained(docs: DataFrame, items: DataFrame, k: int, share: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of :func:`contained_items`, with the hash of the document's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", text_hash(F.col("text")))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))
    found = []
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = ItemIndex([(r["item_id"], r["text"].encode() if r["text"] is not None else None) for r in mine.toLocalIterator()], k, share)
        found.append(docs.mapInArrow(trimmed(_matches(spark.sparkContext.broadcast(index))), "doc_id long, h long, item_id long, n_item_shingles long, n_shared long"))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Each row is judged by its own text, also without
    doc_id or where several rows share one."""
    return without_rows(docs, _contained(docs, items, k, share).select("doc_id", "h"))
