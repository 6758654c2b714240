"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a given share.

Method (T-occurrence search with DivideSkip):

1. Each text becomes its sorted set of shingle hashes. Documents with equal sets form one class; only classes go on.
2. Shingles are ordered from rare to frequent. Two sets that reach the threshold share at least ``l`` shingles among the
   rarest ``n - ceil(t n) + l`` of each (``l`` is 1, plus one for each 40 shingles). These inverted lists bring partners of
   linkable size together in *cells*: all classes that share a rare shingle with the same class, its hub. A class with fewer
   than ``l`` rare shingles in common with others has no partner.
3. In a cell, every class asks an inverted index of the members: of its lists the ``T - 1`` longest are set aside (T is the
   least overlap), the short rest is heap-merged, and the members met there are probed by binary search in the long lists,
   given up as soon as the overlap is out of reach. A pair that meets in several cells belongs to the one with the least
   name, so each pair is searched once and counted once.
4. A cell that is too large for one task (a group of near copies) first measures each member against its hub. Members
   within half the distance allowed form a *ball*: by the triangle inequality all of them are linked, so their links are
   counted as the ball's size without search (for components alone, members linked with the hub need no more proof, and
   the ball has the whole distance). What lies outside is searched, in pairs of blocks, against itself and the ball.
5. Links are joined into components.

The frequency order only decides speed: the most repeated shingles are counted in each chunk of the input and summed;
the ``max_frequent`` highest counts are broadcast (24 bytes each), and all other shingles count as rare. A listed shingle
brings its hub along from that count, so its postings are spread over all tasks instead of meeting in one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import BROADCAST_KEYS, binary_column, numbered, settle, shingle_set, signed, text_hash, trimmed

#: Chunk of shingles in which repeated ones are counted, and the repeats that make one worth reporting.
COUNT_CHUNK, COUNT_LEAST = 2_000_000, 3
#: Shingles (8 bytes each) and members of one block of a cell.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1_000_000, 256
#: Lists up to this length are heap-merged; longer ones that must be merged are counted, which gives the same.
HEAP_LIST = 64
#: Long lists that are probed before members out of reach are given up.
PROBES = 32
SALTS = 64
#: Postings that go out in one batch.
POSTINGS = 200_000
#: Bytes of text for each of its shingles up to which a set may travel as its text.
TEXT_BYTES = 32


def _needed(n: np.ndarray | int, pct: int):
    """ceil(pct n / 100): the least overlap that any partner of a set of size n must have with it."""
    return (pct * n + 99) // 100


def _least(n):
    """Rare shingles that a set of size n must share with a partner, beyond the shortest prefix."""
    return 1 + n // 40


def _keys(got: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed longs."""
    d = xxhash.xxh3_128_digest(got.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _class_rows(k: int):
    """For each document kind 0: id, hash of its text, size and name of its set; kind 1: shingles repeated in a chunk, with their counts and the
    least class that has them."""
    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def repeated(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])  # the first set that has a shingle is then that of the least class
        owner = np.repeat(np.array([k1 for k1, _ in held], np.int64), [len(got) for _, got in held])
        every, first, count = np.unique(np.concatenate([got for _, got in held]) if held else np.empty(0, np.uint64), return_index=True, return_counts=True)
        often = count >= COUNT_LEAST
        zero = np.zeros(int(often.sum()), np.int64)
        yield pa.record_batch([pa.array(zero + 1, pa.int8()), pa.array(signed(every[often])), pa.array(zero), pa.array(count[often]), pa.array(owner[first[often]]), pa.array(zero)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size, seen = 0, set()
        for b in batches:
            rows = []
            for text in binary_column(b, "text"):
                got = shingle_set(text, k)
                name = _keys(got)
                rows.append((len(got), *name))
                if len(got) and name not in seen:  # copies of a text don't make its shingles frequent
                    if len(seen) < 200_000:
                        seen.add(name)
                    held.append((name[0], got))
                    size += len(got)
                if size >= COUNT_CHUNK:
                    yield from repeated(held)
                    held, size = [], 0
            n, k1, k2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array([0] * len(n), pa.int8()), b.column("id"), b.column("h"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], schema=schema)
        yield from repeated(held)

    return run


def rare_first(got: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles from rare to frequent, and their numbers in the frequent list (-1: not in it)."""
    if not len(frequent):
        return got, np.full(len(got), -1)
    at = np.searchsorted(frequent, got)
    at[at == len(frequent)] = 0
    known = frequent[at] == got
    order = np.lexsort((got, np.where(known, counts[at], 0)))
    return got[order], np.where(known, at, -1)[order]


def _posting_rows(k: int, pct: int, frequent):
    """(token, salt, k1, n, c): a rare shingle with salt 0, or the hub of ``c`` frequent ones with a salt above 0."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("k1", pa.int64()), ("n", pa.int32()), ("c", pa.int32())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts, hubs = frequent.value
        seen: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            held = 0
            for text in binary_column(b, "text"):
                got = shingle_set(text, k)
                n = len(got)
                if not n:
                    continue
                k1 = _keys(got)[0]
                if k1 in seen:  # a copy in this task has posted the same rows
                    continue
                if len(seen) < 200_000:
                    seen.add(k1)
                tokens, number = rare_first(got, often, counts)
                p = min(n, n - _needed(n, pct) + _least(n))
                rare = signed(tokens[:p])[number[:p] < 0]
                hub, c = np.unique(hubs[number[:p][number[:p] >= 0]], return_counts=True)
                q = len(rare) + len(hub)
                out.append((np.append(rare, hub), np.repeat([0, 1 + k1 % SALTS], [len(rare), len(hub)]), np.full(q, k1, np.int64), np.full(q, n), np.append(np.ones(len(rare), np.int64), c)))
                held += q
                if held >= POSTINGS:
                    yield rows_of(out)
                    out, held = [], 0
            if out:
                yield rows_of(out)

    return run


def packed(text: bytes, got: np.ndarray, k: int) -> bytes:
    """A set of ``k``-word shingles as it travels: ``k`` and its text, compressed, or 0 and its hashes where those take less.

    A text many times longer than its set, since it repeats itself, is never sent.
    """
    if len(text) <= TEXT_BYTES * len(got) and len(small := zlib.compress(text, 1)) < got.nbytes:
        return k.to_bytes(4, "little") + small
    return bytes(4) + got.tobytes()


def unpacked(sent: bytes) -> np.ndarray:
    k = int.from_bytes(sent[:4], "little")
    return shingle_set(zlib.decompress(sent[4:]), k) if k else np.frombuffer(sent[4:], np.uint64)


def _array_rows(k: int):
    schema = pa.schema([("k1", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # long sets: few rows in a batch
                part = b.slice(at, 256)
                rows = []
                for text, k1, k2 in zip(binary_column(part, "text"), part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=True):
                    got = shingle_set(text, k)
                    if _keys(got) == (k1, k2):
                        rows.append((k1, packed(text, got, k)))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class Index:
    """The inverted lists of some sets, whose members are numbered by rising size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        self.m = len(sets)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        heads, self.number = np.unique(tokens, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        #: (list, member) as one number, in order: list i is where i * m .. stand
        self.keys = np.sort(self.number * self.m + np.repeat(np.arange(self.m), self.size))
        self.searches = 0

    def met(self, q: int, need: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members between q and ``top`` in the short lists of q, how often they stand there, and the long lists."""
        lists = self.number[self.at[q] : self.at[q + 1]]
        begin, end = np.searchsorted(self.keys, lists * self.m + q) + 1, np.searchsorted(self.keys, lists * self.m + top)
        alive = end > begin
        lists, begin, length = lists[alive], begin[alive], (end - begin)[alive]
        nothing = np.empty(0, np.int64)
        if len(lists) < need:
            return nothing, nothing, nothing
        self.searches += 1
        by = np.argsort(length, kind="stable")
        short = by[: len(by) - (need - 1)]
        parts = [self.keys[begin[i] : begin[i] + length[i]] - lists[i] * self.m for i in short]
        merged = [(r, sum(1 for _ in g)) for r, g in groupby(heapq.merge(*[p.tolist() for p in parts if len(p) <= HEAP_LIST]))]
        found, have = (np.array(x, np.int64) for x in zip(*merged, strict=True)) if merged else (nothing, nothing)
        if counted := [p for p in parts if len(p) > HEAP_LIST]:
            total = np.bincount(np.concatenate(counted), minlength=self.m)
            total[found] += have
            found = np.flatnonzero(total)
            have = total[found]
        return found, have, lists[by[len(by) - (need - 1) :]]

    def probe(self, found: np.ndarray, have: np.ndarray, long: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members that still reach ``least`` when the long lists are probed, and their overlaps."""
        for a in range(0, len(long), PROBES):
            if not len(found):
                break
            wanted = long[a : a + PROBES, None] * self.m + found
            at = np.searchsorted(self.keys, wanted.ravel()).reshape(wanted.shape)
            at[at == len(self.keys)] = 0
            have = have + (self.keys[at] == wanted).sum(0)
            stay = have + (len(long) - a - len(wanted)) >= least
            found, have, least = found[stay], have[stay], least[stay]
        return found, have


def divide_skip(sets: list[np.ndarray], pct: int, weight: np.ndarray | None = None, apart=None, every: bool = True) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """(links, tree, searches) among sorted ``sets`` with 100 |a n b| >= pct |a u b|.

    ``links`` has for each set the weights of those it is linked with, ``tree`` enough links to connect what is linked.
    ``apart(q, others)`` tells which others q need not be compared with. Without ``every`` pairs already connected are
    passed over, so ``links`` counts no more than the tree.
    """
    m = len(sets)
    turns = np.argsort([len(s) for s in sets], kind="stable")
    index = Index([sets[i] for i in turns])
    weight = np.ones(m, np.int64) if weight is None else weight
    root, links, tree = np.arange(m), np.zeros(m, np.int64), []
    size = index.size
    tops = np.searchsorted(size, size * 100 // pct, "right")
    for q in range(m):
        found, have, long = index.met(q, int(_needed(size[q], pct)), int(tops[q]))
        if not every and len(found):
            new = root[found] != root[q]
            found, have = found[new], have[new]
        if apart is not None and len(found):
            new = ~apart(turns[q], turns[found])
            found, have = found[new], have[new]
        if not len(found):
            continue
        total = size[found] + size[q]
        found, have = index.probe(found, have, long, (pct * total + pct + 99) // (100 + pct))  # ceil of pct (a + b) / (100 + pct)
        linked = found[100 * have >= pct * (size[found] + size[q] - have)]
        links[turns[q]] += weight[turns[linked]].sum()
        links[turns[linked]] += weight[turns[q]]
        for r in linked:
            if root[r] != root[q]:
                tree.append((int(turns[q]), int(turns[r])))
                root[root == root[r]] = root[q]
    return links, tree, index.searches


def _search(pct: int, every: bool):
    """Links of one cell, or of a pair of its blocks: (k1, links) sums and (u, v) pairs of classes that connect."""
    schema = pa.schema([("k1", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        k1, first = np.unique(table.column("k1").to_numpy(), return_index=True)
        take = lambda c: [table.column(c)[int(i)].as_py() for i in first]
        sets = [unpacked(x) for x in take("shingles")]
        cell, two = table.column("cell")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        before = [frozenset(c for c in cells if c < cell) for cells in take("cells")]
        block, ball = np.array(take("block")), np.array([b if b is not None else 0 for b in take("ball")], np.int64)
        in_ball = np.array([b is not None for b in take("ball")])

        def apart(q: int, others: np.ndarray) -> np.ndarray:
            out = in_ball[others] & in_ball[q] & (ball[others] == ball[q])
            if two:
                out |= block[others] == block[q]
            if before[q]:
                out |= np.fromiter((not before[q].isdisjoint(before[o]) for o in others), bool, len(others))
            return out

        links, tree, _ = divide_skip(sets, pct, np.array(take("weight"), np.int64), apart, every)
        some = np.flatnonzero(links) if every else np.empty(0, np.int64)
        none = [None] * len(tree)
        return pa.table([
            pa.array([*k1[some].tolist(), *none], pa.int64()), pa.array([*links[some].tolist(), *none], pa.int64()),
            pa.array([None] * len(some) + [int(k1[a]) for a, _ in tree], pa.int64()), pa.array([None] * len(some) + [int(k1[b]) for _, b in tree], pa.int64()),
        ], schema=schema)

    return run


def _near_hub(pct: int, every: bool):
    """(k1, hub) of members within the ball around their hub: half the distance allowed where every link is
    counted, else all of it."""
    schema = pa.schema([("k1", pa.int64()), ("hub", pa.int64())])
    part = 2 if every else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, y = None, np.empty(0, np.uint64)
        for b in batches:
            near = []
            for x, middle in zip(b.column("shingles"), b.column("middle"), strict=True):
                x = unpacked(x.as_py())
                if (middle := middle.as_py()) != sent:  # rows of a hub follow each other
                    sent, y = middle, unpacked(middle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                near.append(100 * part * (union - both) <= (100 - pct) * union)
            yield pa.record_batch([b.column(f.name) for f in schema], schema=schema).filter(pa.array(near, pa.bool_()))

    return run


def _least_col(size: str) -> Column:
    return F.lit(1) + F.floor(F.col(size) / 40)


def link_documents(docs: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text", max_frequent: int = 200_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of bytes other than space and \\t-\\r, with A-Z in lower case; a text with fewer than ``k`` words has
    its whole sequence as its one shingle. Two documents link when ``100 |a n b| >= pct |a u b|``, equality included;
    component_id is the smallest doc_id reachable. Null, empty and blank texts have no shingles and link with nothing
    (component_id is their own doc_id). Repeated rows come back as often as they came. Very long texts are compared whole.
    A null doc_id takes no part in links and gets a null component_id. Columns other than the two named are not read, so
    clashing names do no harm; an empty table gives no rows.
    """
    return _join(docs, k, pct, id_col, text_col, max_frequent, every=False).select("doc_id", "n_shingles", "component_id")


def document_links(docs: DataFrame, k: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text", max_frequent: int = 200_000) -> DataFrame:
    """The rows of ``link_documents`` with n_links: how many other documents each is linked with itself.

    A document is a doc_id with its set of shingles, so repeated rows count once. Rows without shingles have no links;
    n_links is null where doc_id is. Very long texts are compared by all their shingles. Ties can't occur: every pair that links
    is counted.
    """
    return _join(docs, k, pct, id_col, text_col, max_frequent, every=True).drop("h", "group")


def _cells(docs: DataFrame, k: int, pct: int, frequent) -> DataFrame:
    """(cell, hub, band, k1, members): which classes meet where; cells of one member are left out."""
    postings = docs.mapInArrow(trimmed(_posting_rows(k, pct, frequent)), "token long, salt int, k1 long, n int, c int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = Window.partitionBy("token", "salt")
    shared = postings.repartition(parts, "token", "salt").select("*", F.min("k1").over(lists).alias("a"), F.max("k1").over(lists).alias("b")).where("a <> b or salt > 0")
    # sets of linkable size fall in the same band or in two next to each other: each goes to its own band and the next one,
    # and a list without sets of its own band has nothing that the band below doesn't have
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / pct)) + 1e-9)
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(1).alias("own")), F.struct((band + 1).alias("band"), F.lit(0).alias("own"))))
    banded = shared.select("token", "salt", "k1", "n", "c", both.alias("at")).select("token", "salt", "k1", "n", "c", "at.band", "at.own")
    group = Window.partitionBy("token", "salt", "band")
    banded = banded.select("*", F.min("k1").over(group).alias("a"), F.max("k1").over(group).alias("b"), F.max("own").over(group).alias("any"))
    met = banded.where("salt > 0 or (a <> b and any = 1)").select("k1", "band", "n", "c", F.when(F.col("salt") > 0, F.col("token")).otherwise(F.col("a")).alias("hub"))
    met = met.groupBy("k1", "band").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.collect_set("hub").alias("hubs")).where(F.col("c") >= _least_col("n"))
    met = settle(met.select(F.explode("hubs").alias("hub"), "band", "k1"))
    # the keys of the join are negated, so that it has exchanges of its own, which Spark may split for a hot cell
    sizes = met.groupBy("hub", "band").agg(F.count("*").alias("members")).where("members > 1").select((-F.col("hub")).alias("_h"), (-F.col("band")).alias("_b"), "members")
    met = met.join(sizes, (-F.col("hub") == F.col("_h")) & (-F.col("band") == F.col("_b")))
    return settle(met.select(F.xxhash64("hub", "band").alias("cell"), "hub", "band", "k1", "members"))


def _arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(k1, shingles) of the classes ``wanted(k1, k2, rep)``, read from the text of one of their documents, ``packed``."""
    wanted = wanted.select("k1", "k2", F.col("rep").alias("id"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = docs.join(wanted, "id").select("k1", "k2", "text")
    return texts.mapInArrow(trimmed(_array_rows(k)), "k1 long, shingles binary")


def _balls(docs: DataFrame, big: DataFrame, classes: DataFrame, k: int, pct: int, every: bool) -> DataFrame:
    """(k1, hub): members of large cells that lie in the ball around their hub."""
    members = big.select("hub", "k1").distinct()
    wanted = settle(members.select("k1").distinct().join(classes, "k1"))
    arrays = settle(_arrays(docs, wanted, k))
    hubs = members.select("hub").distinct().join(arrays, F.col("hub") == F.col("k1")).select("hub", F.col("shingles").alias("middle"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = members.join(arrays, "k1").withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(hubs, ["hub", "salt"])
    return settle(rows.select("k1", "hub", "shingles", "middle").mapInArrow(trimmed(_near_hub(pct, every)), "k1 long, hub long").distinct())


def _join(docs: DataFrame, k: int, pct: int, id_col: str, text_col: str, max_frequent: int, every: bool) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, h, group) of all rows: h is the hash of the text, group names the
    component by one of its classes, so that it holds texts apart that share a doc_id; without ``every`` n_links means nothing."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = docs.withColumn("h", text_hash(F.col("text")))
    seen = settle(hashed.mapInArrow(trimmed(_class_rows(k)), "kind byte, id long, h long, n long, k1 long, k2 long"))
    rows = seen.where("kind = 0").drop("kind")
    # copies meet by (class, id) first, so that a class of very many spreads out
    classes = rows.where("n > 0 and id is not null").groupBy("k1", "k2", "id").agg(F.first("n").alias("n"))
    classes = settle(classes.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    often = seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c"), F.min("k1").alias("hub")).orderBy(F.desc("c"), "id").limit(max_frequent).toPandas()
    often = often.sort_values("id", key=lambda s: s.astype("int64").to_numpy().view(np.uint64))
    frequent = spark.sparkContext.broadcast((often["id"].to_numpy(np.int64).view(np.uint64), often["c"].to_numpy(np.int64), often["hub"].to_numpy(np.int64)))

    cells = _cells(docs, k, pct, frequent)
    wanted = settle(cells.groupBy("k1").agg(F.collect_list("cell").alias("cells")).join(classes, "k1"))
    width = F.greatest(F.lit(2.0), F.least(F.lit(float(BLOCK_MEMBERS)), BLOCK_SHINGLES / F.pow(F.lit(100.0 / pct), F.col("band") + 1)))
    small, big = cells.where(F.col("members") <= width), cells.where(F.col("members") > width)
    near = _balls(docs, big, classes, k, pct, every) if big.limit(1).count() else spark.createDataFrame([], "k1 long, hub long")
    balls = settle(near.groupBy("k1").agg(F.min("hub").alias("ball")))
    big = big.join(balls, "k1", "left").withColumn("inside", F.col("ball").eqNullSafe(F.col("hub")))
    counts = big.groupBy("cell", "band").agg(F.ceil(F.count_if(~F.col("inside")) / F.first(width)).alias("rest"), F.ceil(F.count_if(F.col("inside")) / F.first(width)).alias("balls"))
    big = big.join(counts.select((-F.col("cell")).alias("_c"), "rest", "balls"), -F.col("cell") == F.col("_c"))
    spot = F.xxhash64("k1")
    big = big.withColumn("block", F.when(F.col("inside"), F.col("rest") + F.pmod(spot, F.col("balls"))).otherwise(F.pmod(spot, F.greatest(F.lit(1), F.col("rest")))))
    # a block of the ball meets only blocks of the rest
    last = F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("balls")) - 1
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda o: o <= last)
    big = big.select("cell", "k1", "block", F.explode(F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))).alias("p")).select("cell", "k1", "block", "p.i", "p.j")
    zero = F.lit(0).cast("long")
    placed = small.select("cell", "k1", zero.alias("block"), zero.alias("i"), zero.alias("j")).unionByName(big)
    placed = placed.join(wanted.select("k1", "cells", "weight"), "k1").join(balls, "k1", "left").join(_arrays(docs, wanted, k), "k1")
    found = settle(placed.groupBy("cell", "i", "j").applyInArrow(_search(pct, every), "k1 long, links long, u long, v long"))

    edges = found.where("u is not null").select("u", "v").unionByName(near.where("k1 <> hub").select(F.col("k1").alias("u"), F.col("hub").alias("v")))
    labels = settle(connected_components(edges).select(F.col("node").alias("k1"), F.col("component").alias("group")))
    least = labels.join(classes.select("k1", "rep"), "k1").groupBy(F.col("group").alias("_group")).agg(F.min("rep").alias("least"))
    labels = labels.join(least, F.col("group") == F.col("_group")).select("k1", "group", "least")
    named = classes.join(labels, "k1", "left").select("k1", "k2", "weight", F.coalesce("group", "k1").alias("group"), F.coalesce("least", "rep").alias("component_id"))
    searched = found.where("k1 is not null").groupBy("k1").agg(F.sum("links").alias("links"))
    # all members of a ball are linked with each other
    inside = balls.join(wanted.select("k1", "weight"), "k1")
    whole = inside.groupBy(F.col("ball").alias("_ball")).agg(F.sum("weight").alias("_all"))
    inside = inside.join(whole, F.col("ball") == F.col("_ball")).select("k1", (F.col("_all") - F.col("weight")).alias("mates"))
    named = settle(named.join(searched, "k1", "left").join(inside, "k1", "left").select("k1", "k2", "group", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("mates", F.lit(0))).alias("n_links")))
    out = rows.join(named, ["k1", "k2"], "left")
    there, full = F.col("id").isNotNull(), F.col("n") > 0
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(there, F.when(full, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
        F.when(there, F.when(full, F.col("n_links")).otherwise(F.lit(0))).alias("n_links"), "h", "group",
    )


#: Rows without a doc_id are given one above this.
OWN_IDS = 1 << 62


def near_duplicate_keep(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near copies is kept: that of the smallest doc_id.

    Of rows of a group that share this doc_id one stays (of the text with the least hash); other texts of the doc_id, which
    are in no group with it, are not touched. Rows without doc_id come after
    all others. Rows without shingles (null, empty, blank texts) are no copies and all stay.
    """
    rows, (doc, text) = numbered(docs, "doc_id", "text")
    h = text_hash(F.col(text))
    own = F.coalesce(F.col(doc).cast("long"), F.lit(OWN_IDS) + h.bitwiseAND(OWN_IDS - 1))
    keyed = rows.select(own.alias("own"), F.col(text).cast("string").alias("text"))
    groups = settle(_join(keyed, k, pct, "own", "text", 200_000, every=False).where("n_shingles > 0").select("doc_id", "h", "group", "component_id"))
    # groups in which the smallest doc_id has several rows: few, and mostly none
    first = groups.where("doc_id = component_id")
    several = settle(first.groupBy("group").agg(F.count("*").alias("c"), F.first("doc_id").alias("only"), F.min("h").alias("first")).where("c > 1"))
    others = first.join(several, "group").where("h <> first")
    gone = settle(groups.where("doc_id <> component_id").select("doc_id", "h").unionByName(others.select("doc_id", "h")).distinct())
    kept = rows.withColumns({"own": own, "h": h})
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    kept = kept.join(gone, (F.col("own") == F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left_anti")
    if several.limit(1).count():
        again = several.select(F.col("only").alias("twice_id"), F.col("first").alias("twice_h"))
        twice = (F.col("own") == F.col("twice_id")) & (F.col("h") == F.col("twice_h"))
        kept = kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["own", "h"]))
    return kept.select(*rows.columns).toDF(*docs.columns)
