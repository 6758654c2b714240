"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: Words whose hashes one Python worker remembers before it starts afresh.
MAX_CACHED_WORDS = 150_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own, or on a local master without one a temporary folder.

    On a cluster a folder of one machine would be lost to the others, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return told or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs a read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_database(spark: SparkSession) -> str:
    """The name of a new database in the shared folder; its tables go, with their data, when they or it are dropped."""
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{ensure_checkpoint_dir(spark).rstrip('/')}/{name}'")
    return name


def numbered(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed c0, c1, ..., which can't clash with ours, and the new names of those wanted.

    ``toDF(*docs.columns)`` turns the names back.
    """
    at = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [at[w.lower()] for w in wanted]


#: Keys up to this number (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart: 64 bits of the text, null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text.cast("string")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not in ``gone(doc_id, h)``; h is their ``text_hash``.

    Null ids and texts are compared like others. All columns of ``docs`` are kept, whatever their names.
    """
    gone = settle(gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct())
    rows, (doc, text) = numbered(docs, "doc_id", "text")
    same = F.col(doc).cast("long").eqNullSafe(F.col("gone_id")) & text_hash(F.col(text)).eqNullSafe(F.col("gone_h"))
    small = gone.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if small else gone, same, "left_anti").toDF(*docs.columns)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


#: Copies of a row that are written out together.
COPIES = 4096


def positions(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, per_cell: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows that precede this one in its group. ``value`` is 0 or more.

    Rows equal in all columns are one row and a count until their places are known, so that a row repeated any number of
    times takes one place in a window; their places follow each other.

    Rows of a group are dealt into about ``rows / per_cell`` cells by a hash of ``order``, and cells into spans of
    ``per_cell`` cells. The totals of spans give each span its start, those of its cells give each cell its own, and a window
    inside the cell does the rest. A group that holds most of the rows is therefore spread over many tasks, and no window
    sees more than ``per_cell`` rows in the mean, save the one over spans, which has a row for about a million rows.
    The order inside a group is (hash cell, ``order``); ties take any order.
    """
    columns = df.columns
    df = settle(df.groupBy(*columns).agg(F.count("*").alias("_n")))
    cells = max(1, -(-df.count() // per_cell))
    df = df.withColumns({"_cell": F.pmod(F.xxhash64(*order), F.lit(cells)), "_value": F.col("_n") * value.cast("long")})
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda col, w: F.coalesce(F.sum(col).over(w), F.lit(0))
    totals = df.groupBy(*group, "_cell").agg(F.sum("_value").alias("_sum")).withColumn("_span", F.floor(F.col("_cell") / per_cell))
    spans = totals.groupBy(*group, "_span").agg(F.sum("_sum").alias("_all"))
    spans = spans.select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)], F.col("_span").alias("_in"), sofar("_all", before(*group).orderBy("_span")).alias("_first"))
    starts = totals.withColumn("_own", sofar("_sum", before(*group, "_span").orderBy("_cell")))
    starts = starts.join(spans, [F.col("_span") == F.col("_in"), *[F.col(g).eqNullSafe(F.col(f"_s{i}")) for i, g in enumerate(group)]])
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_cell").alias("_at"), (F.col("_first") + F.col("_own")).alias("_start"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = df.join(starts, [F.col("_cell") == F.col("_at"), *same])
    inner = before(*group, "_cell").orderBy(*order)
    found = joined.withColumn(out, F.col("_start") + sofar("_value", inner)).select(*columns, "_n", "_value", out)
    if not df.where("_n > 1").limit(1).count():
        return found.select(*columns, out)
    once = found.where("_n = 1").select(*columns, out)
    # copies are written out some at a time, by as many tasks as it takes
    lots = found.where("_n > 1").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))).repartition(*order, "_lot")
    each = lots.withColumn("_i", F.explode(F.sequence(F.col("_lot") * COPIES, F.least(F.col("_n"), (F.col("_lot") + 1) * COPIES) - 1)))
    return once.unionByName(each.select(*columns, (F.col(out) + F.col("_i") * F.floor(F.col("_value") / F.col("_n"))).cast("long").alias(out)))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text with A-Z in lower case; none for null."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words, in order; a shorter sequence counts as one window."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out ^ hashes[j : j + n - k + 1])
    return out


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct ``k``-word shingles of a text as sorted hashes."""
    got = windows(hash_words(words_of(text)), k)
    got.sort()
    return got[np.append(True, got[1:] != got[:-1])] if len(got) else got


def binary_column(batch: pa.RecordBatch, name: str, step: int = 256) -> Iterator[bytes | None]:
    """A string column as UTF-8 bytes, without decoding, some rows at a time."""
    column = batch.column(name).cast(pa.binary())
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition's batches; afterwards the worker, which goes on to other tasks, returns free memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
