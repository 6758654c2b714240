"""Spanning forests of districts with low points: which units hold a district together.

The forest of every district of every plan is a table; what it says of a unit answers for every move of that unit, so candidate
moves are marked by one join instead of a search for components each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, of
from .components import settle
from .graph import _ends, contracted

#: Units and inner edges of one district that a task takes at once (some 100 bytes each); more are refused.
MOST_ROWS = 8_000_000

FOREST = "plan long, district int, unit long, parent long, root long, place int, low int, splits int"


def _walk(n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], ...]:
    """(parent, root, place, low, splits) of each of ``n`` nodes; neighbours of i are ends[starts[i]:starts[i + 1]].

    A walk in depth first numbers the nodes; low is the smallest number that a node's branch reaches over one edge out of the
    tree. ``splits`` is how many parts a node's component falls into without it.
    """
    first, beside = starts.tolist(), ends.tolist()
    parent, root, place, low, splits = [-1] * n, [-1] * n, [-1] * n, [0] * n, [0] * n
    at, turn = list(first[:-1]), 0
    for seed in range(n):
        if place[seed] >= 0:
            continue
        place[seed] = low[seed] = turn
        root[seed], turn, path = seed, turn + 1, [seed]
        while path:
            u = path[-1]
            if at[u] < first[u + 1]:
                v = beside[at[u]]
                at[u] += 1
                if place[v] < 0:
                    parent[v], root[v], place[v], low[v] = u, seed, turn, turn
                    turn += 1
                    splits[v] = 1  # what lies above it
                    path.append(v)
                elif v != parent[u]:
                    low[u] = min(low[u], place[v])
                continue
            path.pop()
            if path:
                p = path[-1]
                low[p] = min(low[p], low[u])
                splits[p] += low[u] >= place[p]
    return parent, root, place, low, splits


def _forest(table: pa.Table) -> pa.Table:
    u, v = (table.column(c).to_numpy() for c in "uv")
    units, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    real = a != b
    a, b = np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]])
    once = np.unique(a * len(units) + b)
    a, b = once // len(units), once % len(units)
    parent, root, place, low, splits = _walk(len(units), np.searchsorted(a, np.arange(len(units) + 1)), b)
    n = len(units)
    above = np.array(parent)
    return pa.table({
        "plan": pa.array(np.repeat(table.column("plan")[0].as_py(), n), pa.int64()), "district": pa.array(np.repeat(table.column("district")[0].as_py(), n), pa.int32()), "unit": pa.array(units, pa.int64()), "parent": pa.array(units[above], pa.int64(), mask=above < 0),
        "root": pa.array(units[np.array(root)], pa.int64()), "place": pa.array(place, pa.int32()), "low": pa.array(low, pa.int32()), "splits": pa.array(splits, pa.int32()),
    })


#: What a node of a forest stands for.
NODES = ("units", "boundary", "parts")


def spanning_forest(assignments: DataFrame | Blocks, edges: DataFrame, nodes: str = "units") -> DataFrame:
    """(plan, district, unit, parent, root, place, low, splits): a spanning forest of the units of each district.

    ``root`` is the smallest unit of a connected part, so it names the part; ``parent`` is null there. ``place`` and ``low`` are
    the numbers of the walk. ``splits`` is the number of parts that a unit's part falls into without it: 0 if it stands alone, 1
    if nothing breaks, more at articulation points. A district is walked in one task; one of more than ``MOST_ROWS`` units and
    inner edges is refused.

    With ``nodes`` "boundary" units beside no other district are joined with those that they touch, and with "parts" all units
    are (``graph.contracted``); ``unit`` is then the smallest of a node. Roots are the same, and with "boundary" so are the ``splits``
    of units beside another district, while a task walks as many nodes as a border is long.
    """
    if nodes not in NODES:
        raise ValueError(f"nodes are {', '.join(NODES)}")
    if nodes != "units":
        blocks = of(assignments)
        rows = settle(contracted(blocks, edges, boundary=nodes == "boundary"))
        large = rows.groupBy("plan", "district").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).limit(1).collect()
        if large:
            raise ValueError(f"district {large[0]['district']} of plan {large[0]['plan']} has {large[0]['n']} nodes and edges; at most {MOST_ROWS} are walked in one task")
        return rows.select("plan", F.col("district").cast("int").alias("district"), "u", "v").groupBy("plan", "district").applyInArrow(_forest, FOREST)
    if isinstance(assignments, Blocks):
        assignments = assignments.source
    inner = _ends(assignments, edges).where("du = dv").select("plan", F.col("du").alias("district"), "u", "v")
    own = assignments.select("plan", "district", F.col("unit").alias("u"), F.col("unit").alias("v"))
    rows = inner.unionByName(own).select(F.col("plan").cast("long").alias("plan"), F.col("district").cast("int").alias("district"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    # four edges a unit or so: the number of units tells which districts may be too large
    large = assignments.groupBy("plan", "district").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS // 4).limit(1).collect()
    if large:
        raise ValueError(f"district {large[0]['district']} of plan {large[0]['plan']} has {large[0]['n']} units; at most {MOST_ROWS // 4} are walked in one task")
    return rows.groupBy("plan", "district").applyInArrow(_forest, FOREST)


def parts(forest: DataFrame) -> DataFrame:
    """(plan, district, unit, component), as ``graph.components`` gives them."""
    return forest.select("plan", "district", "unit", F.col("root").alias("component"))


def legal_moves(moves: DataFrame, forest: DataFrame) -> DataFrame:
    """``moves(plan, unit, source, target, ...)`` with parts_left, the number of connected parts of the source without the unit, and
    legal, whether that is one. A unit that is its whole district leaves none, which is not legal."""
    pieces = forest.groupBy("plan", "district").agg(F.count_if(F.col("parent").isNull()).alias("pieces"))
    held = forest.join(pieces, ["plan", "district"]).select(F.col("plan").alias("_plan"), F.col("unit").alias("_unit"), (F.col("pieces") - 1 + F.col("splits")).cast("int").alias("parts_left"))
    out = moves.join(held, (F.col("plan") == F.col("_plan")) & (F.col("unit") == F.col("_unit"))).drop("_plan", "_unit")
    return out.withColumn("legal", F.col("parts_left") == 1)


def articulation_units(forest: DataFrame) -> DataFrame:
    """(plan, district, unit, splits): units without which their part of the district falls apart."""
    return forest.where("splits > 1").select("plan", "district", "unit", "splits")
