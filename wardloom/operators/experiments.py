"""Statistics between measures of an ensemble: rank correlation, tradeoffs, sensitivity and multiplicity.

``draws(plan, metric, value)`` is long; ``wide(plan, chain, draw, x, y)`` holds a pair of measures, larger is better.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, correlation, ratio
from .ordering import numbered, ranged, running


def spearman_matrix(draws: DataFrame, metrics: list[str], direction: dict[str, int] | None = None) -> DataFrame:
    """(a, b, n, dropped, rho) for each pair a < b: draws with both values, ranked after the others are dropped. Null rho where
    a side is constant. Values are first multiplied by their direction (1 or -1)."""
    sign = direction or {}
    signed = F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(float(sign.get(m, 1))))])
    rows = draws.where(F.col("metric").isin(*metrics)).withColumn("value", F.col("value") * signed[F.col("metric")])
    a = rows.select("plan", F.col("metric").alias("a"), F.col("value").alias("x"))
    b = rows.select("plan", F.col("metric").alias("b"), F.col("value").alias("y"))
    both = a.join(b, "plan").where("a < b")
    size = both.groupBy("a", "b").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("dropped"))
    ranked = both.where("x is not null and y is not null").select("a", "b", average_rank(F.col("x"), "a", "b").alias("x"), average_rank(F.col("y"), "a", "b").alias("y"))
    fit = ranked.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("rho"))
    return fit.join(size, ["a", "b"]).select("a", "b", "n", "dropped", "rho")


def disagreements(matrix: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs below the threshold or undefined, undefined and weakest first."""
    return matrix.where((F.col("rho") < threshold) | F.col("rho").isNull()).orderBy(F.col("rho").asc_nulls_first(), "a", "b")


def pareto_frontier(pairs: DataFrame) -> DataFrame:
    """(x, y): points that no other point beats in both coordinates; larger is better. Points of equal x are reduced first."""
    best = pairs.where("x is not null and y is not null").groupBy("x").agg(F.max("y").alias("y"))
    return running(best, "top", F.col("y"), F.max, [F.desc("x")], inclusive=False).where("top is null or y > top").select("x", "y")


def cliffs_delta(rows: DataFrame) -> DataFrame:
    """(metric, delta) of ``rows(metric, kept, value)``: 2U/(n1 n2) - 1 for kept against the rest; 0 where a side is empty."""
    ranked = rows.where("value is not null").withColumn("rank", average_rank(F.col("value"), "metric"))
    n1, n2 = F.count_if(F.col("kept")), F.count_if(~F.col("kept"))
    u = F.sum(F.when(F.col("kept"), F.col("rank")).otherwise(0.0)) - n1 * (n1 + 1) / 2
    return ranked.groupBy("metric").agg(F.when((n1 > 0) & (n2 > 0), 2 * u / (n1 * n2) - 1).otherwise(0.0).alias("delta"))


def sensitivity_sweep(wide: DataFrame, target: str, others: list[str], levels: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(level, metric, kept, delta, shift): the best plans by ``target`` are kept, more strictly from level to level; Cliff's
    delta and the shift of the median of the other measures, kept against all. Ties at the cut are kept."""
    n = wide.where(F.col(target).isNotNull()).count()
    rows = numbered(wide.where(F.col(target).isNotNull()), "place", F.desc(target), F.col("plan"))
    cuts = rows.select(target, "place", F.explode(F.array(*[F.struct(F.lit(q).alias("level"), F.lit(max(1, n - int(q * n))).alias("keep")) for q in levels])).alias("c"))
    cuts = cuts.where("place = c.keep").select(F.col("c.level").alias("level"), F.col(target).alias("cut"))
    long = wide.where(F.col(target).isNotNull()).select("plan", F.col(target).alias("_t"), *others).unpivot(["plan", "_t"], others, "metric", "value")
    at = long.join(F.broadcast(cuts), F.lit(True)).withColumn("kept", F.col("_t") >= F.col("cut"))
    keyed = at.withColumn("metric", F.concat_ws("@", "metric", F.col("level").cast("string")))
    shift = keyed.groupBy("metric").agg(F.count_if(F.col("kept")).alias("kept"), (F.median(F.when(F.col("kept"), F.col("value"))) - F.median("value")).alias("shift"))
    out = cliffs_delta(keyed).join(shift, "metric")
    return out.select(F.substring_index("metric", "@", -1).cast("double").alias("level"), F.substring_index("metric", "@", 1).alias("metric"), "kept", "delta", "shift")


def concordance(a: np.ndarray, b: np.ndarray) -> int:
    """Concordant less discordant pairs. Pairs are met at the highest binary digit in which the ranks of ``a`` differ: there
    one side is sorted by ``b`` and the other looks its places up."""
    ra, rb = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    width, total = int(rb.max(initial=0)) + 1, 0
    for bit in range(int(ra.max(initial=0)).bit_length()):
        group, upper = ra >> (bit + 1), (ra >> bit) & 1 == 1
        low = np.sort(group[~upper] * width + rb[~upper])
        start, at = group[upper] * width, group[upper] * width + rb[upper]
        place = lambda x, side="left": np.searchsorted(low, x, side)  # noqa: B023, E731
        total += int((place(at) - place(start)).sum() - (place(start + width) - place(at, "right")).sum())
    return total


def kendall_tau(orders: DataFrame) -> DataFrame:
    """(tau) of ``orders(item, a, b)``: concordant less discordant pairs over all pairs; 1 with fewer than two items.

    Items are dealt into ranges of a and of b. Pairs in different ranges of both follow from the counts of the cells (range
    of a, range of b); pairs that share a range of a, or of b, are counted inside that range, less those that share both.
    """
    spark = orders.sparkSession
    dealt = ranged(orders.select("a", "b"), F.col("a")).withColumnRenamed("_part", "pa")
    dealt = ranged(dealt, F.col("b")).withColumnRenamed("_part", "pb")

    def local(name: str, *keys: str) -> DataFrame:
        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"kind": [name], "s": [concordance(pdf["a"].to_numpy(), pdf["b"].to_numpy())]})

        return dealt.groupBy(*keys).applyInPandas(count, "kind string, s long")

    shared = local("one", "pa").unionByName(local("one", "pb")).unionByName(local("both", "pa", "pb"))
    inside = shared.agg(F.coalesce(F.sum(F.when(F.col("kind") == "one", F.col("s")).otherwise(-F.col("s"))), F.lit(0)).alias("s")).first()["s"]
    cells = {(r["pa"], r["pb"]): r["n"] for r in dealt.groupBy("pa", "pb").agg(F.count("*").alias("n")).collect()}  # ranges squared at most
    grid = np.zeros((1 + max((k[0] for k in cells), default=0), 1 + max((k[1] for k in cells), default=0)), np.int64)
    for k, c in cells.items():
        grid[k] = c
    below = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
    below[1:, 1:] = grid.cumsum(0).cumsum(1)
    before = below[:-1, -1:] - below[:-1, 1:]  # items of earlier ranges of a in later ranges of b
    across = int((grid * (below[:-1, :-1] - before)).sum())
    n = int(grid.sum())
    return spark.createDataFrame([((inside + across) / (n * (n - 1) / 2) if n > 1 else 1.0,)], "tau double")


def adjust_multiplicity(tests: DataFrame) -> DataFrame:
    """Adds q, Benjamini and Hochberg's adjusted ``p``."""
    n = tests.count()
    ranked = numbered(tests, "_rank", F.col("p"))
    return running(ranked, "q", F.col("p") * n / F.col("_rank"), F.min, [F.desc("_rank")]).withColumn("q", F.least(F.lit(1.0), "q")).drop("_rank")


def robust_sd(values: DataFrame, column: str) -> DataFrame:
    """(sd): 1.4826 times the median absolute deviation, or the population deviation where that is 0."""
    middle = values.agg(F.median(column).alias("_mid"))
    out = values.crossJoin(F.broadcast(middle)).agg(F.median(F.abs(F.col(column) - F.col("_mid"))).alias("mad"), F.stddev_pop(column).alias("sd"))
    return out.select(F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd")).alias("sd"))


def conditional_effect(wide: DataFrame) -> DataFrame:
    """(effect, kept): median y in the top decile of x (ties at the cut stay) less the median of y, over y's robust deviation."""
    n = wide.count()
    top = max(1, round(0.1 * n))
    cut = numbered(wide.select(F.col("x").alias("cut")), "_i", F.desc("cut")).where(F.col("_i") == top).select("cut")
    scale = robust_sd(wide, "y")
    rows = wide.crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(scale))
    kept = F.col("x") >= F.col("cut")
    return rows.agg(F.when(F.first("sd") > 0, (F.median(F.when(kept, F.col("y"))) - F.median("y")) / F.first("sd")).alias("effect"), F.count_if(kept).alias("kept"))


def attainable_effect(wide: DataFrame) -> DataFrame:
    """(effect): the lowest conditional effect that any order of x could give: the median of the lowest tenth of y less the
    median of y, over y's robust deviation. A test whose bar lies below it can't fire."""
    top = max(1, round(0.1 * wide.count()))
    low = numbered(wide.select("y"), "_i", F.col("y"))
    scale = robust_sd(wide, "y")
    out = low.agg(F.median(F.when(F.col("_i") <= top, F.col("y"))).alias("worst"), F.median("y").alias("middle")).join(F.broadcast(scale), F.lit(True))
    return out.select(F.when(F.col("sd") > 0, (F.col("worst") - F.col("middle")) / F.col("sd")).alias("effect"))


def check_symmetry(pairs: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """(test, checked, mismatches) of ``pairs(a, b, test, verdict)``: how often a test that should not care for the order of a
    pair decides otherwise when it is turned round. Pairs that stand in one order only are not checked."""
    mine = pairs.where(F.col("test").isin(*symmetric))
    other = mine.select(F.col("a").alias("_b"), F.col("b").alias("_a"), F.col("test").alias("_t"), F.col("verdict").alias("_v"))
    both = mine.where("a < b").join(other, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("test") == F.col("_t")))
    return both.groupBy("test").agg(F.count("*").alias("checked"), F.count_if(~F.col("verdict").eqNullSafe(F.col("_v"))).alias("mismatches"))


def achievability(wide: DataFrame) -> DataFrame:
    """(joint, expected, ratio): how often both are in their top third, and what independence would give."""
    cuts = wide.agg(F.percentile("x", F.lit(2 / 3)).alias("cx"), F.percentile("y", F.lit(2 / 3)).alias("cy"))
    rows = wide.crossJoin(F.broadcast(cuts))
    a, b = (F.col("x") >= F.col("cx")).cast("double"), (F.col("y") >= F.col("cy")).cast("double")
    out = rows.agg(F.avg(a * b).alias("joint"), (F.avg(a) * F.avg(b)).alias("expected"))
    return out.withColumn("ratio", ratio(F.col("joint"), F.col("expected")))


def bootstrap_correlation(wide: DataFrame, reps: int = 1000, seed: int = 7) -> DataFrame:
    """(rho, low, high): Spearman's rho with a 95 % interval from whole chains drawn with replacement.

    ``wide(chain, draw, x, y)``: each replicate's picks are rows (rep, chain, times); the ranks of a replicate are its own.
    """
    spark = wide.sparkSession
    chains = [r[0] for r in wide.select("chain").distinct().orderBy("chain").collect()]
    rng = np.random.default_rng(seed)
    picks = [(rep, int(c), int(t)) for rep in range(reps) for c, t in zip(*np.unique(rng.choice(chains, len(chains)), return_counts=True), strict=True)]
    table = spark.createDataFrame(picks, "rep int, chain long, times int")
    rows = wide.join(F.broadcast(table), "chain").select("rep", "x", "y", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    ranked = rows.select("rep", average_rank(F.col("x"), "rep").alias("x"), average_rank(F.col("y"), "rep").alias("y"))
    rhos = ranked.groupBy("rep").agg(correlation("x", "y").alias("rho")).where("rho is not null")
    at = F.array_sort(F.collect_list("rho"))
    n = F.size(at)
    own = wide.select(average_rank(F.col("x")).alias("x"), average_rank(F.col("y")).alias("y")).agg(correlation("x", "y").alias("rho"))
    return own.crossJoin(rhos.agg(F.get(at, F.floor(0.025 * n).cast("int")).alias("low"), F.get(at, F.least(F.floor(0.975 * n).cast("int"), n - 1)).alias("high")))


def permutation_p(wide: DataFrame, reps: int = 1000, seed: int = 7) -> DataFrame:
    """(effect, p): the conditional effect against those of x turned round within each chain, p = (worse + 1) / (reps + 1).

    Replicates are groups of rows (rep); a chain's turn is a re-indexing of its draws.
    """
    spark = wide.sparkSession
    lengths = {r["chain"]: r["n"] for r in wide.groupBy("chain").agg(F.count("*").alias("n")).collect()}
    rng = np.random.default_rng(seed)
    turns = [(rep, int(c), int(rng.integers(1, n)) if rep and n > 1 else 0, int(n)) for rep in range(reps + 1) for c, n in sorted(lengths.items())]
    table = spark.createDataFrame(turns, "rep int, chain long, turn long, n long")
    place = F.row_number().over(Window.partitionBy("chain").orderBy("draw")) - 1
    base = wide.withColumn("i", place)
    turned = base.join(F.broadcast(table), "chain").select("rep", "chain", F.pmod(F.col("i") + F.col("turn"), F.col("n")).alias("i"), "x")
    rows = turned.join(base.select("chain", "i", "y"), ["chain", "i"]).select("rep", "x", "y")

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        top = max(1, round(0.1 * len(x)))
        cut = np.sort(x)[::-1][top - 1]
        mad = np.median(np.abs(y - np.median(y)))
        scale = 1.4826 * mad if mad > 0 else y.std()
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "effect": [(np.median(y[x >= cut]) - np.median(y)) / scale if scale > 0 else None]}).astype({"effect": "Float64"})

    effects = rows.groupBy("rep").applyInPandas(effect, "rep int, effect double")
    own = F.max(F.when(F.col("rep") == 0, F.col("effect")))
    out = effects.agg(own.alias("effect"), F.collect_list(F.when(F.col("rep") > 0, F.col("effect"))).alias("all"))
    worse = F.size(F.filter("all", lambda e: e <= F.col("effect")))
    return out.select("effect", ((worse + 1) / (F.size("all") + 1)).alias("p"))


def verdict(votes: DataFrame, tests: int = 3) -> DataFrame:
    """Adds verdict to ``votes(fired, decided)``: degenerate, none, weak or strong (all tests decide and fire)."""
    return votes.withColumn("verdict", F.when(F.col("decided") == 0, "degenerate").when(F.col("fired") == 0, "none").when((F.col("fired") == tests) & (F.col("decided") == tests), "strong").otherwise("weak"))


def relationships(pairs: DataFrame) -> DataFrame:
    """Ordered pairs' verdicts (a, b, verdict) by unordered pair."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("verdict")).alias("verdicts"))


def compare_contests(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b, verdict, other, agree): verdicts of two contests side by side; a missing one disagrees."""
    o = other.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("verdict").alias("other"))
    return primary.join(o, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select("a", "b", "verdict", "other", F.col("verdict").eqNullSafe(F.col("other")).alias("agree"))


def inject(wide: DataFrame, blend: float, seed: int = 7) -> DataFrame:
    """``wide(chain, draw, x, y)`` with y paired anew against x within each chain: best to lowest at blend 0, at random for
    large blends. Each chain keeps its own values of y."""
    size = F.count(F.lit(1)).over(Window.partitionBy("chain"))
    rank = F.row_number().over(Window.partitionBy("chain").orderBy("x", "draw")) - 1
    noise = F.pmod(F.xxhash64("chain", "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keyed = wide.withColumn("_key", rank + blend * size * noise)
    slot = F.row_number().over(Window.partitionBy("chain").orderBy("_key", "draw"))
    best = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("y"), "draw"))
    x = keyed.select("chain", "draw", "x", slot.alias("_slot"))
    y = wide.select(F.col("chain").alias("_c"), "y", best.alias("_best"))
    return x.join(y, (F.col("chain") == F.col("_c")) & (F.col("_slot") == F.col("_best"))).select("chain", "draw", "x", "y")


#: How much noise the injected dependence is mixed with, from none to where no test should see it.
BLENDS = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def detection_floor(wide: DataFrame, blends: tuple[float, ...] = BLENDS, effect: float = -0.2) -> DataFrame:
    """(blend, rho, effect, fired): dependence of known strength put into the real draws, and whether the conditional effect
    sees it. All blends are one keyed job."""
    spark = wide.sparkSession
    keys = F.broadcast(spark.createDataFrame([(float(b),) for b in blends], "blend double"))
    size = F.count(F.lit(1)).over(Window.partitionBy("chain"))
    rank = F.row_number().over(Window.partitionBy("chain").orderBy("x", "draw")) - 1
    noise = F.pmod(F.xxhash64("chain", "draw", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    keyed = wide.select("chain", "draw", "x", rank.alias("_rank"), size.alias("_size"), noise.alias("_noise")).join(keys, F.lit(True))
    slot = F.row_number().over(Window.partitionBy("blend", "chain").orderBy(F.col("_rank") + F.col("blend") * F.col("_size") * F.col("_noise"), "draw"))
    best = wide.select(F.col("chain").alias("_c"), "y", F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("y"), "draw")).alias("_best"))
    pairs = keyed.withColumn("_slot", slot).join(best, (F.col("chain") == F.col("_c")) & (F.col("_slot") == F.col("_best"))).select("blend", "x", "y")
    rho = pairs.select("blend", average_rank(F.col("x"), "blend").alias("x"), average_rank(F.col("y"), "blend").alias("y")).groupBy("blend").agg(correlation("x", "y").alias("rho"))
    top = max(1, round(0.1 * wide.count()))
    cut = numbered(wide.select(F.col("x").alias("cut")), "_i", F.desc("cut")).where(F.col("_i") == top).select("cut")  # x keeps its values in every blend
    scale = robust_sd(wide, "y")  # and so does y
    rows = pairs.join(F.broadcast(cut), F.lit(True)).join(F.broadcast(scale), F.lit(True))
    effects = rows.groupBy("blend").agg(F.when(F.first("sd") > 0, (F.median(F.when(F.col("x") >= F.col("cut"), F.col("y"))) - F.median("y")) / F.first("sd")).alias("effect"))
    return rho.join(effects, "blend").select("blend", "rho", "effect", (F.col("effect") <= effect).alias("fired"))


def null_delta(wide: DataFrame, reps: int = 60, seed: int = 11) -> DataFrame:
    """(low): the fifth percentile of Cliff's delta of y between the better half by x and the rest, x turned round within
    each chain ``reps`` times."""
    spark = wide.sparkSession
    lengths = {r["chain"]: r["n"] for r in wide.groupBy("chain").agg(F.count("*").alias("n")).collect()}
    rng = np.random.default_rng(seed)
    turns = spark.createDataFrame([(f"r{rep:04d}", int(c), int(rng.integers(1, max(2, n))), int(n)) for rep in range(reps) for c, n in sorted(lengths.items())], "metric string, chain long, turn long, n long")
    place = F.row_number().over(Window.partitionBy("chain").orderBy("draw")) - 1
    base = wide.withColumn("i", place)
    turned = base.join(F.broadcast(turns), "chain").select("metric", "chain", F.pmod(F.col("i") + F.col("turn"), F.col("n")).alias("i"), "x")
    middle = wide.agg(F.median("x").alias("_mid"))
    rows = turned.join(base.select("chain", "i", "y"), ["chain", "i"]).crossJoin(F.broadcast(middle)).select("metric", (F.col("x") >= F.col("_mid")).alias("kept"), F.col("y").alias("value"))
    return cliffs_delta(rows).agg(F.percentile("delta", F.lit(0.05)).alias("low"))
