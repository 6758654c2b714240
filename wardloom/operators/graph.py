"""Graph operators over ``edges(u, v, shared_len)`` with u < v, and ``assignments(plan, unit, district)``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .blocks import NONE, PLAN_BLOCK, Blocks, Range, block_of, districts, of, smallest, unique
from .components import connected_components, settle


def from_adjacency(adjacency: DataFrame) -> DataFrame:
    """``adjacency(unit, neighbours array)`` as ordered arcs (u, v)."""
    return adjacency.select(F.col("unit").alias("u"), F.explode("neighbours").alias("v"))


def asymmetric_arcs(arcs: DataFrame, units: DataFrame) -> DataFrame:
    """(u, v, problem): arcs whose end is no unit, loops, and arcs without their reverse."""
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    dangling = arcs.join(units.select(F.col("unit").alias("v")), "v", "left_anti").select("u", "v", F.lit("dangling").alias("problem"))
    loops = arcs.where("u = v").select("u", "v", F.lit("loop").alias("problem"))
    onesided = arcs.join(back, ["u", "v"], "left_anti").where("u <> v").select("u", "v", F.lit("one-sided").alias("problem"))
    return dangling.unionByName(loops).unionByName(onesided)


def by_unit(assignments: DataFrame) -> DataFrame:
    """(unit, block, rows): each unit's districts in a block of plans, as an array of struct (plan, district) in order of plans.

    Only arrays that come in another order are sorted, since sorting them all takes longer than collecting them.
    """
    block = F.floor(F.col("plan") / PLAN_BLOCK).alias("block")
    held = assignments.groupBy("unit", block).agg(F.collect_list(F.struct("plan", "district")).alias("rows"))
    plans = F.col("rows")["plan"]
    return held.withColumn("rows", F.when(plans == F.sort_array(plans), F.col("rows")).otherwise(F.array_sort("rows")))


def beside(a: str, b: str) -> Column:
    """Arrays ``a`` and ``b`` of :func:`by_unit` as one array of struct (a, b), for each plan that both have.

    Arrays of the same plans, each once, are read side by side; others, where plans leave units out, plan by plan.
    """
    plans = F.col(a)["plan"]
    same = (plans == F.col(b)["plan"]) & (F.size(F.array_distinct(plans)) == F.size(a))
    found = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["plan"] == x["plan"]), lambda y: F.struct(x.alias(a), y.alias(b)))))
    return F.when(same, F.arrays_zip(a, b)).otherwise(found)


def _ends(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """Each plan's edges with the districts of both ends.

    Units come with an array over plans, so an edge is joined once for a block of plans and not once for each plan.
    """
    held = by_unit(assignments)
    a = held.select(F.col("unit").alias("u"), "block", F.col("rows").alias("a"))
    b = held.select(F.col("unit").alias("_v"), F.col("block").alias("_block"), F.col("rows").alias("b"))
    met = edges.join(a, "u").join(b, (F.col("v") == F.col("_v")) & (F.col("block") == F.col("_block")))
    rest = [c for c in edges.columns if c != "u"]
    return met.select("u", *rest, F.explode(beside("a", "b")).alias("_r")).select(F.col("_r.a.plan").alias("plan"), "u", F.col("_r.a.district").alias("du"), *rest, F.col("_r.b.district").alias("dv"))


def _sides(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, unit, district, other): both ends of each edge between two districts; edges meet the plans once for both."""
    if isinstance(assignments, Blocks):
        return _cut(assignments, edges)
    end = lambda unit, own, other: F.struct(F.col(unit).alias("unit"), F.col(own).alias("district"), F.col(other).alias("other"))
    return _ends(assignments, edges).where("du <> dv").select("plan", F.inline(F.array(end("u", "du", "dv"), end("v", "dv", "du"))))


def _cut(blocks: Blocks, edges: DataFrame) -> DataFrame:
    """:func:`_sides` of packed plans: only edges between districts leave their range."""
    rows, needs = blocks.by_edge(edges.select("u", "v"), both=False)

    def run(r: Range, table: pa.Table) -> pa.Table:
        _, a, b = r.pairs(*(table.column(c).to_numpy() for c in "uv"))
        kind, i = np.nonzero(r.apart(a, b))
        kind, own, other = np.concatenate([kind, kind]), np.concatenate([a[i], b[i]]), np.concatenate([b[i], a[i]])
        i, plan = r.spread(kind)
        kind, own, other = kind[i], own[i], other[i]
        return pa.table({"plan": pa.array(plan, pa.int64()), "unit": pa.array(r.units[own], pa.int64()), "district": pa.array(r.kinds[kind, own], pa.int64()), "other": pa.array(r.kinds[kind, other], pa.int64())})

    found = blocks.typed(blocks.meet(rows, run, "plan long, unit long, district long, other long", needs))
    return found.withColumn("other", F.col("other").cast(blocks.types["district"]))


def _contacts(blocks: Blocks, edges: DataFrame) -> DataFrame:
    """:func:`contacts` of packed plans: edges are counted in their range."""
    rows, needs = blocks.by_edge(edges.select("u", "v", F.col("shared_len").cast("double").alias("shared_len")), both=False)

    def run(r: Range, table: pa.Table) -> pa.Table:
        e, a, b = r.pairs(*(table.column(c).to_numpy() for c in "uv"))
        lengths = table.column("shared_len")
        known, length = pc.is_valid(lengths).to_numpy()[e], pc.fill_null(lengths, 0.0).to_numpy()[e]
        du, dv = r.kinds[:, a], r.kinds[:, b]
        k, i = np.nonzero((du >= NONE) & (dv >= NONE))
        names = np.unique(r.kinds)
        at = (k * len(names) + np.searchsorted(names, du[k, i])) * len(names) + np.searchsorted(names, dv[k, i])
        cells, at = np.unique(at, return_inverse=True)
        n, m, s = (np.bincount(at, w, len(cells)) for w in (None, known[i].astype(float), length[i]))
        row, plan = r.spread(cells // max(1, len(names) ** 2))
        first, second = names[cells // max(1, len(names)) % max(1, len(names))][row], names[cells % max(1, len(names))][row]
        return pa.table({"plan": pa.array(plan, pa.int64()), "du": districts(first), "dv": districts(second), "n": pa.array(n[row], pa.int64()), "m": pa.array(m[row].astype(np.int64), pa.int64()), "s": pa.array(s[row], pa.float64())})

    some = blocks.meet(rows, run, "plan long, du long, dv long, n long, m long, s double", needs).groupBy("plan", "du", "dv")
    out = some.agg(F.sum("n").alias("edges"), F.when(F.sum("m") > 0, F.sum("s")).alias("shared_len"))
    return out.select(*[F.col(c).cast(blocks.types["plan" if c == "plan" else "district"]).alias(c) for c in ("plan", "du", "dv")], "edges", "shared_len")


def contacts(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, du, dv, edges, shared_len): how many edges run from district to district, and their length together.

    What cut edges and perimeters need of the edges, in a row for each pair of districts.
    """
    if isinstance(assignments, Blocks):
        return _contacts(assignments, edges)
    return _ends(assignments, edges).groupBy("plan", "du", "dv").agg(F.count("*").alias("edges"), F.sum("shared_len").alias("shared_len"))


def cut_edges(assignments: DataFrame, edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(plan, cut_edges): edges between units of different districts; ``met`` are their ``contacts``, if at hand."""
    met = contacts(assignments, edges) if met is None else met
    return met.groupBy("plan").agg(F.sum(F.when(F.col("du") != F.col("dv"), F.col("edges")).otherwise(0)).alias("cut_edges"))


def shortest_borders(edges: DataFrame, n: int = 8) -> DataFrame:
    """(u, v, shared_len): the ``n`` shortest shared borders of some length, where water or slivers may join units."""
    return edges.where("shared_len > 0").orderBy("shared_len", "u", "v").limit(n).select("u", "v", "shared_len")


def boundary_units(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, unit, district, reach): units beside another district, and how many other districts they touch."""
    return _sides(assignments, edges).groupBy("plan", "unit", "district").agg(F.countDistinct("other").alias("reach"))


def move_candidates(assignments: DataFrame, edges: DataFrame, units: DataFrame, ideal: float) -> DataFrame:
    """(plan, unit, source, target, delta): single moves over a boundary and how they change the sum of squared
    deviations of district populations from ``ideal``."""
    moves = _sides(assignments, edges).select("plan", "unit", F.col("district").alias("source"), F.col("other").alias("target")).distinct()
    if isinstance(assignments, Blocks):
        pops = assignments.sums(units, ["pop"])
    else:
        pops = assignments.join(units.select("unit", "pop"), "unit").groupBy("plan", "district").agg(F.sum("pop").alias("pop"))
    at = lambda end: pops.select(F.col("plan").alias(f"_p_{end}"), F.col("district").alias(f"_d_{end}"), F.col("pop").cast("double").alias(f"pop_{end}"))
    out = moves.join(units.select("unit", F.col("pop").cast("double").alias("pop")), "unit")
    for end in ("source", "target"):
        out = out.join(at(end), (F.col("plan") == F.col(f"_p_{end}")) & (F.col(end) == F.col(f"_d_{end}")))
    square = lambda x: (x - ideal) * (x - ideal)
    s, t, p = F.col("pop_source"), F.col("pop_target"), F.col("pop")
    return out.select("plan", "unit", "source", "target", (square(s - p) + square(t + p) - square(s) - square(t)).alias("delta"))


def swap_sets(moves: DataFrame) -> DataFrame:
    """(plan, a, b, units_a, units_b, swaps) for districts a < b: units of a that may move to b, those of b that may move to a,
    and how many swaps they make. Any of the first with any of the second is a swap, so pairs need not be written out."""
    up = F.col("source") < F.col("target")
    sets = moves.groupBy("plan", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.array_sort(F.collect_set(F.when(up, F.col("unit")))).alias("units_a"), F.array_sort(F.collect_set(F.when(~up, F.col("unit")))).alias("units_b"))
    return sets.withColumn("swaps", F.size("units_a").cast("long") * F.size("units_b")).where("swaps > 0")


def swap_candidates(moves: DataFrame) -> DataFrame:
    """(plan, unit_a, unit_b): pairs of single moves that exchange two units between two districts, written out."""
    pairs = swap_sets(moves).select("plan", F.explode("units_a").alias("x"), "units_b").select("plan", "x", F.explode("units_b").alias("y"))
    return pairs.select("plan", F.least("x", "y").alias("unit_a"), F.greatest("x", "y").alias("unit_b"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("unit")).unionByName(edges.select(F.col("v").alias("unit")))
    return ends.groupBy("unit").agg(F.count("*").alias("degree"))


def _within(r: Range, a: np.ndarray, b: np.ndarray, lone: np.ndarray | None, across: bool) -> np.ndarray:
    """Kinds by columns: the column of the smallest unit of this range that a unit is connected with in its district, without
    passing units that are ``lone``. ``across``: a unit in several districts connects them."""
    n = len(r.units)
    met = r.same(a, b) & r.own[a] & r.own[b]
    if lone is not None:
        met &= ~(lone[:, a] | lone[:, b])
    k, i = np.nonzero(met)
    x, y = k * n + a[i], k * n + b[i]
    if across and len(again := np.flatnonzero(r.units[1:] == r.units[:-1])):
        k, i = np.nonzero((r.kinds[:, again] > NONE - 1) & (r.kinds[:, again + 1] > NONE - 1) & r.own[again])
        x, y = np.concatenate([x, k * n + again[i]]), np.concatenate([y, k * n + again[i] + 1])
    return smallest(r.n * n, x, y).reshape(r.n, n) % max(1, n)


def contracted(blocks: Blocks, edges: DataFrame, boundary: bool = False, across: bool = False) -> DataFrame:
    """(plan, district, u, v): a smaller graph whose parts are those of the districts. A node is the smallest of the units that it
    stands for; each node comes with itself as well, so none is lost.

    Units of a range that are connected in their district become one node, and only edges to other ranges are left. With ``boundary``
    units beside another district stay nodes of their own: without one of them a district falls into as many parts here as
    there. With ``across`` a unit in several districts connects them, and districts are 0.
    """
    rows, needs = blocks.by_edge(edges.select("u", "v"))

    def run(r: Range, table: pa.Table) -> pa.Table:
        _, a, b = r.pairs(*(table.column(c).to_numpy() for c in "uv"))
        lone = None
        if boundary:
            lone = np.zeros(r.kinds.shape, bool)
            k, i = np.nonzero(r.apart(a, b))
            lone[k, a[i]] = lone[k, b[i]] = True
        node = _within(r, a, b, lone, across)
        same = r.same(a, b)
        # side 0: two nodes of this range; 1: the node of a unit that edges from other ranges end at; 2: a node at their other end
        k, c = np.nonzero((node == np.arange(len(r.units))) & r.own & (r.kinds > NONE - (1 if across else 0)))
        found = [(k, c, c, np.zeros(len(k), np.int64))]
        if boundary:
            k, i = np.nonzero(same & r.own[a] & r.own[b] & (lone[:, a] | lone[:, b]))
            found.append((k, node[k, a[i]], node[k, b[i]], np.zeros(len(k), np.int64)))
        k, i = np.nonzero(same & (r.own[a] != r.own[b]))
        mine = np.where(r.own[a[i]], a[i], b[i])
        found.append((k, b[i], node[k, mine], np.where(r.own[b[i]], 1, 2)))
        kind, at, to, side = (np.concatenate(x) for x in zip(*found, strict=True))
        district = np.zeros(len(kind), np.int64) if across else r.kinds[kind, to]
        kind, district, at, to, side = unique(kind, district, r.units[at], r.units[to], side)
        i, plan = r.spread(kind)
        return pa.table({"plan": pa.array(plan, pa.int64()), "district": districts(district[i]), "at": pa.array(at[i], pa.int64()), "node": pa.array(to[i], pa.int64()), "side": pa.array(side[i], pa.int32())})

    found = blocks.meet(rows, run, "plan long, district long, at long, node long, side int", needs)
    side = F.col("side")
    ends = found.groupBy("plan", "district", "at", F.when(side == 0, F.col("node")).alias("to")).agg(F.max(F.when(side == 1, F.col("node"))).alias("own"), F.collect_set(F.when(side == 2, F.col("node"))).alias("others"))
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    pairs = F.when(F.col("to").isNotNull(), F.array(pair(F.col("at"), F.col("to")))).otherwise(F.transform("others", lambda x: pair(F.col("own"), x)))
    return ends.select("plan", "district", F.inline(pairs)).distinct()


def components(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, district, unit, component): connected parts of each district, named by their smallest unit.

    Units must be whole numbers from 0 to 2^31 - 1, plans likewise: a node of the joint graph is both in one long. Units are
    joined within their range first, then the ranges, and at last units learn the name of their part.
    """
    blocks = of(assignments)
    node = lambda u: F.shiftleft("plan", 31) + F.col(u)
    joined = connected_components(contracted(blocks, edges, across=True).where("u <> v").select(node("u").alias("u"), node("v").alias("v")))
    names = joined.where("node <> component").select(F.shiftright("node", 31).alias("plan"), (F.col("node") % (1 << 31)).alias("u"), (F.col("component") % (1 << 31)).alias("v"))
    names = blocks.placed(names, "u").withColumnRenamed("_at0", "part").withColumn("block", block_of("plan"))
    rows, needs = blocks.by_edge(edges.select("u", "v"))
    both = rows.select("block", "part", F.lit(None).cast("long").alias("plan"), "u", "v").unionByName(names.select("block", "part", "plan", "u", "v"))

    def run(r: Range, table: pa.Table) -> pa.Table:
        named = table.filter(pc.is_valid(table.column("plan")))
        u, v = (table.filter(pc.is_null(table.column("plan"))).column(c).to_numpy() for c in "uv")
        _, a, b = r.pairs(u, v)
        part = r.units[_within(r, a, b, None, True)][:, r.own][r.turn]
        plan, old, new = (named.column(c).to_numpy() for c in ("plan", "u", "v"))
        order = np.lexsort((old, plan))
        plan, old, new = plan[order], old[order], new[order]
        for p, (low, high) in enumerate(zip(*(np.searchsorted(plan, r.plans, s) for s in ("left", "right")), strict=True)):
            if low < high:
                at = np.minimum(np.searchsorted(old[low:high], part[p]), high - low - 1)
                part[p] = np.where(old[low:high][at] == part[p], new[low:high][at], part[p])
        held = r.kinds[:, r.own][r.turn]
        p, c = np.nonzero(held > NONE - 1)
        return pa.table({"plan": pa.array(r.plans[p], pa.int64()), "district": districts(held[p, c]), "unit": pa.array(r.units[r.own][c], pa.int64()), "component": pa.array(part[p, c], pa.int64())})

    found = blocks.typed(blocks.meet(both, run, "plan long, district long, unit long, component long"))
    nowhere = blocks.source.where("plan IS NULL OR unit IS NULL").select("plan", "district", "unit", F.col("unit").cast("long").alias("component"))
    return found.unionByName(nowhere)


def contiguity(parts: DataFrame) -> DataFrame:
    """(plan, district, pieces) from ``components``."""
    return parts.groupBy("plan", "district").agg(F.countDistinct("component").alias("pieces"))


def valid_ids(assignments: DataFrame, k: int) -> DataFrame:
    """(plan, valid): whether a plan's districts are just the numbers 1 to ``k``."""
    n, first, last = F.count("district"), F.min("district"), F.max("district")
    return assignments.select("plan", "district").distinct().groupBy("plan").agg(((n == k) & (first == 1) & (last == k)).alias("valid"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one plan that follow each other as one row (plan, at, text); ``at`` rises within a task and from task to task."""
    at = TaskContext.get().partitionId() << 32
    for b in batches:
        if b.num_rows:
            runs = pc.run_end_encode(b.column("plan"))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *runs.run_ends.to_pylist()], pa.int32()), b.column("text")), ";")
            yield pa.record_batch([runs.values, pa.array(range(at, at + len(text)), pa.int64()), text], names=["plan", "at", "text"])
            at += len(text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(plan, digest) of runs in order; a plan's text is hashed as it comes and never held whole."""
    plan = sha = None
    for b in batches:
        for i in range(b.num_rows):
            here = b.column("plan").slice(i, 1)
            if sha is None or not here.equals(plan):
                if sha is not None:
                    yield pa.record_batch([plan, pa.array([sha.hexdigest()[:16]])], names=["plan", "digest"])
                plan, sha = here, hashlib.sha256()
            else:
                sha.update(b";")
            sha.update(b.column("text")[i].as_buffer())
    if sha is not None:
        yield pa.record_batch([plan, pa.array([sha.hexdigest()[:16]])], names=["plan", "digest"])


def plan_digest(assignments: DataFrame, dealt: bool = False) -> DataFrame:
    """(plan, digest): 16 hex digits of sha256 over ``unit:district`` in unit order, joined by semicolons.

    Units are dealt to tasks by range, and each task sends the text of its range for each plan; the plan's ranges are hashed
    one after the other. ``dealt``: the rows already lie so, ranges in the order of tasks.
    """
    kind = assignments.schema["plan"].dataType.simpleString()
    rows = assignments if dealt else assignments.repartitionByRange("unit")
    text = F.concat_ws(":", F.col("unit").cast("string"), F.col("district").cast("string")).alias("text")
    runs = rows.sortWithinPartitions("plan", "unit", "district").select("plan", text).mapInArrow(_runs, f"plan {kind}, at long, text string")
    return runs.repartition("plan").sortWithinPartitions("plan", "at").mapInArrow(_digests, f"plan {kind}, digest string")


#: Districts of all plans whose names are sent to every task; more meet the plans in a shuffle.
NAMED = 1_000_000


def canonical_key(assignments: DataFrame, dealt: bool = False) -> DataFrame:
    """(plan, key): as the digest, with each district named by its smallest unit, so labels don't matter."""
    if isinstance(assignments, Blocks):
        return _key(assignments)
    names = settle(assignments.groupBy(F.col("plan").alias("_plan"), F.col("district").alias("_district")).agg(F.min("unit").alias("_name")))
    few = names.count() <= NAMED
    same = F.col("plan").eqNullSafe(F.col("_plan")) & F.col("district").eqNullSafe(F.col("_district"))
    named = assignments.join(F.broadcast(names) if few else names, same).select("plan", "unit", F.col("_name").alias("district"))
    return plan_digest(named, dealt and few).withColumnRenamed("digest", "key")


def _key(blocks: Blocks) -> DataFrame:
    """:func:`canonical_key` of packed plans: the text of a range is written where it lies."""

    def least(r: Range) -> pa.Table:
        kind, district, unit = [], [], []
        for k in range(r.n):
            names, at = np.unique(r.kinds[k], return_index=True)
            kind.append(np.full(len(names), k))
            district.append(names)
            unit.append(r.units[at])
        kind, district, unit = (np.concatenate(x) for x in (kind, district, unit))
        here = district >= NONE
        i, plan = r.spread(kind[here])
        return pa.table({"plan": pa.array(plan, pa.int64()), "district": pa.array(district[here][i], pa.int64()), "name": pa.array(unit[here][i], pa.int64())})

    names = blocks.alone(least, "plan long, district long, name long").groupBy("plan", "district").agg(F.min("name").alias("name"))
    names = blocks.in_blocks(names.withColumn("block", block_of("plan")), "block")

    def write(r: Range, table: pa.Table) -> pa.Table:
        plan, district, name = (table.column(c).to_numpy() for c in ("plan", "district", "name"))
        order = np.lexsort((district, plan))
        plan, district, name = plan[order], district[order], name[order]
        unit, again, texts = pa.array(r.units).cast(pa.string()), bool((r.units[1:] == r.units[:-1]).any()), []
        for p, (low, high) in enumerate(zip(*(np.searchsorted(plan, r.plans, s) for s in ("left", "right")), strict=True)):
            held = r.kinds[r.turn[p]]
            here = np.flatnonzero(held >= NONE)
            at = np.searchsorted(district[low:high], held[here])
            if again:
                order = np.lexsort((name[low:high][at], r.units[here]))
                here, at = here[order], at[order]
            rows = pc.binary_join_element_wise(unit.take(pa.array(here)), pa.array(name[low:high]).cast(pa.string()).take(pa.array(at)), ":")
            texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), ";")[0].as_py() if len(rows) else None)
        part = table.column("part")[0].as_py() if table.num_rows else 0
        out = pa.table({"plan": pa.array(r.plans, pa.int64()), "at": pa.array([part] * len(r.plans), pa.int64()), "text": pa.array(texts, pa.string())})
        return out.filter(pc.is_valid(out.column("text")))

    runs = blocks.meet(names, write, "plan long, at long, text string")
    return blocks.typed(runs.repartition("plan").sortWithinPartitions("plan", "at").mapInArrow(_digests, "plan long, digest string")).withColumnRenamed("digest", "key")


def distinct_plans(keys: DataFrame) -> DataFrame:
    """(key, first_plan, plans): each different plan once."""
    return keys.groupBy("key").agg(F.min("plan").alias("first_plan"), F.count("*").alias("plans"))


def population_spread(assignments: DataFrame, units: DataFrame) -> DataFrame:
    """(plan, spread, least, most): populations of a plan's districts."""
    pops = assignments.join(units.select("unit", "pop"), "unit").groupBy("plan", "district").agg(F.sum("pop").alias("pop"))
    return pops.groupBy("plan").agg((F.max("pop") - F.min("pop")).alias("spread"), F.min("pop").alias("least"), F.max("pop").alias("most"))


def legality(assignments: DataFrame, units: DataFrame, k: int, epsilon: float, parts: DataFrame | None = None) -> DataFrame:
    """A row a plan: coverage, ids, non_empty, balanced (each district within epsilon of the ideal population), worst
    deviation, and contiguous where ``components`` are given."""
    n = units.agg(F.count("*").alias("_units"), F.sum("pop").alias("_total"))
    if isinstance(assignments, Blocks):
        pops = assignments.sums(units, ["pop"])
    else:
        pops = assignments.join(units.select("unit", "pop"), "unit").groupBy("plan", "district").agg(F.sum("pop").alias("pop"), F.countDistinct("unit").alias("units"))
    pops = pops.crossJoin(F.broadcast(n))
    ideal = F.col("_total") / F.lit(float(k))
    out = pops.groupBy("plan").agg(
        (F.sum("units") == F.first("_units")).alias("coverage"),
        ((F.min("district") >= 1) & (F.max("district") <= k)).alias("ids"),
        (F.count("*") == k).alias("non_empty"),
        F.max(ratio(F.abs(F.col("pop") - ideal), ideal)).alias("worst_deviation"),
        (F.max(F.abs(F.col("pop") - ideal)) <= F.first(epsilon * ideal) + 1e-9).alias("balanced"),
    )
    if parts is None:
        return out
    whole = contiguity(parts).groupBy("plan").agg((F.max("pieces") == 1).alias("contiguous"))
    return out.join(whole, "plan", "left")
