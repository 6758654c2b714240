"""Ranking of criteria by what adopting each costs the others, beside what chance would give.

``rows(run, chain, draw, *criteria)`` hold how good each draw is by each criterion, larger being better; a run is one ensemble,
such as that of one tolerance. Criteria, levels and replicates of all runs are worked on together: ranks don't depend on who
is kept, so every Cliff's delta is a sum of ranks over kept rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .components import settle
from .ordering import numbered

#: How much of an ensemble is dropped, from nothing on.
LEVELS = (0.0, 0.25, 0.5, 0.75, 0.9)
#: A delta at or below the negative of this displaces another criterion; the level read as realistic; the smallest share of an
#: ensemble that may be kept or dropped.
BINDS_AT, REALISTIC, LEAST_SIDE = 0.147, 0.5, 0.01
#: Runs whose sizes the driver holds at once.
MOST_RUNS = 10_000


def delta_of(ranks: Column, kept: Column, n: Column) -> Column:
    """Cliff's delta of kept rows against the rest from the sum of the ranks of those kept; null where a side is empty."""
    return ratio(2 * ranks - kept * (kept + 1), kept * (n - kept)) - 1


class Criteria:
    """Ranks and cuts of all criteria of all runs."""

    def __init__(self, rows: DataFrame, criteria: tuple[str, ...], levels: tuple[float, ...] = LEVELS) -> None:
        self.criteria, self.levels = criteria, levels
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in criteria])
        base = settle(rows.where(known).select("run", "chain", "draw", *[F.col(c).cast("double").alias(c) for c in criteria]))
        sizes = base.groupBy("run").agg(F.count("*").alias("n")).orderBy("run").limit(MOST_RUNS + 1).collect()
        if len(sizes) > MOST_RUNS:
            raise ValueError(f"more than {MOST_RUNS} runs")
        spark, named, start = base.sparkSession, sorted(criteria), 0
        blocks, cuts = [], []
        for r in sizes:
            for c in named:
                blocks.append((r["run"], c, start, r["n"]))
                cuts += [(start + max(1, round((1 - q) * r["n"])), r["run"], c, i) for i, q in enumerate(levels)]
                start += r["n"]
        kind = base.schema["run"].dataType.simpleString()
        block = spark.createDataFrame(blocks, f"_run {kind}, _criterion string, _start long, _n long")
        cut = spark.createDataFrame(cuts, f"_at long, _run {kind}, _criterion string, level int")
        long = base.unpivot(["run", "chain", "draw"], list(criteria), "criterion", "good")
        placed = settle(numbered(long, "_place", F.col("run"), F.col("criterion"), F.desc("good")))
        at = placed.join(F.broadcast(cut), F.col("_place") == F.col("_at")).groupBy("run", "criterion").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "good"))), lambda x: x["good"]).alias("cuts"))
        tied = placed.groupBy("run", "criterion", "good").agg(F.avg("_place").alias("_mean")).join(F.broadcast(block), (F.col("run") == F.col("_run")) & (F.col("criterion") == F.col("_criterion")))
        ranks = tied.select("run", "criterion", "good", (F.col("_n") + 1 - (F.col("_mean") - F.col("_start"))).alias("rank"))
        self.varies = settle(tied.groupBy("run", "criterion").agg((F.count("*") > 1).alias("varies")))
        pick = lambda c, v: F.max(F.when(F.col("criterion") == c, F.col(v)))
        wide = placed.join(ranks, ["run", "criterion", "good"]).groupBy("run", "chain", "draw").agg(*[pick(c, "rank").alias(f"rank_{c}") for c in criteria], *[pick(c, "good").alias(c) for c in criteria])
        cuts_of = at.groupBy("run").agg(*[pick(c, "cuts").alias(f"cuts_{c}") for c in criteria])
        kept = [F.transform(f"cuts_{c}", lambda x: F.col(c) >= x).alias(f"kept_{c}") for c in criteria]  # noqa: B023
        self.wide = settle(wide.join(F.broadcast(cuts_of), "run").select("run", "chain", "draw", *[f"rank_{c}" for c in criteria], *kept))

    def deltas(self) -> DataFrame:
        """(run, target, level, other, kept, excluded, refused, delta): what keeping the best by the target costs another criterion.

        At level 0 nothing is dropped and every delta is 0. A level that keeps or drops less than ``LEAST_SIDE`` of the draws is
        refused, its delta null; ties at the cut are kept. Criteria that are constant in a run take no part in it.
        """
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.lit(q).alias("level"), F.get(f"kept_{c}", F.lit(i)).alias("kept")) for c in self.criteria for i, q in enumerate(self.levels)])).alias("t")
        rows = self.wide.select("run", *[f"rank_{c}" for c in self.criteria], each)
        sums = rows.groupBy("run", F.col("t.target").alias("target"), F.col("t.level").alias("level")).agg(F.count_if("t.kept").alias("kept"), F.count("*").alias("n"), *[F.sum(F.when(F.col("t.kept"), F.col(f"rank_{c}"))).alias(c) for c in self.criteria])
        long = sums.unpivot(["run", "target", "level", "kept", "n"], list(self.criteria), "other", "ranks").where("target <> other")
        for name in ("target", "other"):
            long = long.join(F.broadcast(self.varies.where("varies").select("run", F.col("criterion").alias(name))), ["run", name])
        refused = (F.col("level") > 0) & (F.least(F.col("kept"), F.col("n") - F.col("kept")) < LEAST_SIDE * F.col("n"))
        delta = F.when(F.col("level") == 0, 0.0).when(~refused, delta_of(F.col("ranks"), F.col("kept"), F.col("n")))
        return long.select("run", "target", "level", "other", "kept", (F.col("n") - F.col("kept")).alias("excluded"), refused.alias("refused"), delta.alias("delta"))

    def floors(self, deltas: DataFrame, reps: int, seed: int) -> DataFrame:
        """(run, target, replicates, floor): the fifth percentile of the worst delta when criteria are paired anew.

        Each chain's draws are turned round by an offset that the seed, the replicate, the run and the chain decide, so it keeps
        its own order and values and only the pairing goes. All targets of all runs share the replicates; the cut is that of the
        strictest level that isn't refused.
        """
        strict = deltas.where(~F.col("refused")).groupBy("run", "target").agg(F.max("level").alias("level"))
        index = F.array_position(F.array(*[F.lit(q) for q in self.levels]), F.col("level")) - 1
        strict = strict.groupBy("run").agg(*[F.max(F.when(F.col("target") == c, index)).cast("int").alias(f"level_{c}") for c in self.criteria])
        placed = numbered(self.wide.select("run", "chain", "draw", *[f"rank_{c}" for c in self.criteria], *[f"kept_{c}" for c in self.criteria]), "_place", F.col("run"), F.col("chain"), F.col("draw"))
        placed = settle(placed)
        chains = placed.groupBy("run", "chain").agg(F.min("_place").alias("_first"), F.count("*").alias("_len"))
        held = placed.join(chains, ["run", "chain"]).withColumn("_i", F.col("_place") - F.col("_first"))
        flags = held.join(F.broadcast(strict), "run").select("run", "chain", "_i", *[F.get(f"kept_{c}", F.col(f"level_{c}")).alias(f"in_{c}") for c in self.criteria])
        key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("run").cast("string"), F.col("chain").cast("string")), 256)
        turns = chains.select("run", "chain", "_len", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("run", "chain", "_len", "rep", F.pmod(F.conv(F.left(key, F.lit(8)), 16, 10).cast("long"), F.col("_len")).alias("_turn"))
        turned = flags.join(turns, ["run", "chain"]).withColumn("_j", (F.col("_i") + F.col("_turn")) % F.col("_len"))
        ranks = held.select("run", "chain", F.col("_i").alias("_j"), *[f"rank_{c}" for c in self.criteria])
        met = turned.join(ranks, ["run", "chain", "_j"])
        pairs = [(t, o) for t in self.criteria for o in self.criteria if t != o]
        sums = met.groupBy("run", "rep").agg(F.count("*").alias("n"), *[F.count_if(f"in_{t}").alias(f"n_{t}") for t in self.criteria], *[F.sum(F.when(F.col(f"in_{t}"), F.col(f"rank_{o}"))).alias(f"s_{t}_{o}") for t, o in pairs])
        worst = lambda t: F.least(F.lit(0.0), *[F.coalesce(delta_of(F.col(f"s_{t}_{o}"), F.col(f"n_{t}"), F.col("n")), F.lit(0.0)) for o in self.criteria if o != t])
        usable = lambda t: (F.col(f"n_{t}") > 0) & (F.col(f"n_{t}") < F.col("n"))
        each = sums.select("run", *[F.when(usable(t), worst(t)).alias(t) for t in self.criteria]).unpivot("run", list(self.criteria), "target", "worst").where("worst IS NOT NULL")
        ordered = each.groupBy("run", "target").agg(F.array_sort(F.collect_list("worst")).alias("w"))
        return ordered.select("run", "target", F.size("w").alias("replicates"), F.get("w", F.greatest(F.lit(0), F.floor(0.05 * F.size("w")).cast("int") - 1)).alias("floor"))

    def ranking(self, reps: int = 200, seed: int = 11) -> DataFrame:
        """(run, place, criterion, worst, level, displaces, floor, clears, binds, binds_at_realistic, levels_refused).

        Criteria by their worst delta, lowest first, ties in the order given. ``displaces`` names the criterion that suffers it
        at the first level that gives it, null where no delta is below 0. A criterion binds if its worst delta is at most
        -``BINDS_AT`` and lies below the chance floor. Constant criteria have neither place nor numbers.
        """
        deltas = settle(self.deltas())
        order = F.array_position(F.array(*[F.lit(c) for c in self.criteria]), F.col("other"))
        level = deltas.groupBy("run", "target", "level").agg(F.first("refused").alias("refused"), F.min(F.struct("delta", order.alias("i"), "other")).alias("m"))
        level = level.select("run", "target", "level", "refused", F.when(~F.col("refused"), F.col("m.delta")).alias("worst"), F.when(F.col("level") > 0, F.col("m.other")).alias("other"))
        per = level.groupBy("run", "target").agg(F.min(F.when(F.col("worst").isNotNull(), F.struct("worst", "level", "other"))).alias("m"), F.max(F.when(F.col("level") == REALISTIC, F.col("worst"))).alias("real"), F.count_if("refused").cast("int").alias("levels_refused"))
        floors = self.floors(deltas, reps, seed).select(F.col("run").alias("_run"), F.col("target").alias("_target"), "floor")
        met = per.join(floors, (F.col("run") == F.col("_run")) & (F.col("target") == F.col("_target")), "left")
        clears = F.coalesce(F.col("m.worst") < F.col("floor"), F.lit(False))
        found = met.select(F.col("run").alias("_run"), F.col("target").alias("_target"), F.col("m.worst").alias("worst"), F.col("m.level").alias("level"), F.col("m.other").alias("displaces"), "floor", clears.alias("clears"), ((F.col("m.worst") <= -BINDS_AT) & clears).alias("binds"), F.coalesce(F.col("real") <= -BINDS_AT, F.lit(False)).alias("binds_at_realistic"), "levels_refused")
        given = F.array_position(F.array(*[F.lit(c) for c in self.criteria]), F.col("_target"))
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("_run").orderBy("worst", given)))  # a row a criterion
        every = self.varies.select("run", "criterion")
        return every.join(found, (F.col("run") == F.col("_run")) & (F.col("criterion") == F.col("_target")), "left").select("run", "place", "criterion", "worst", "level", "displaces", "floor", "clears", "binds", "binds_at_realistic", "levels_refused")
