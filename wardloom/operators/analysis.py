"""Pairs of criteria, their ranking, and exact tests by chain; cases that break their rules; summaries fit for use."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import average_rank, correlation, ratio


def pair_effects(draws: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, n, rho, effect, joint, expected) for each ordered pair of measures that vary, over the plans that have both.

    rho is Spearman's. effect: the median of b among the tenth of plans with the largest a (ties at the cut stay) less the
    median of b, over b's robust deviation; null where b has none. joint: how often both are in their top third; expected: what
    independence would give.
    """
    rows = draws.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull())
    vary = rows.groupBy(F.col("metric").alias("_m")).agg(F.min("value").alias("_low"), F.max("value").alias("_high")).where("_low < _high").select("_m")
    rows = rows.join(F.broadcast(vary), F.col("metric") == F.col("_m")).select("plan", "metric", "value")
    other = rows.select("plan", F.col("metric").alias("b"), F.col("value").alias("y"))
    both = rows.select("plan", F.col("metric").alias("a"), F.col("value").alias("x")).join(other, "plan").where("a <> b")
    pair = Window.partitionBy("a", "b")
    n, place = F.count(F.lit(1)).over(pair), F.row_number().over(pair.orderBy(F.desc("x")))
    cut = F.when(place == F.greatest(F.lit(1), F.round(n / 10.0).cast("int")), F.col("x"))
    marked = both.select("a", "b", "x", "y", average_rank(F.col("x"), "a", "b").alias("rx"), average_rank(F.col("y"), "a", "b").alias("ry"), cut.alias("_cut"))
    stats = marked.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho"), F.max("_cut").alias("cut"), F.median("y").alias("mid"), F.stddev_pop("y").alias("sd"), F.percentile("x", F.lit(2 / 3)).alias("cx"), F.percentile("y", F.lit(2 / 3)).alias("cy"))
    held = marked.select("a", "b", "x", "y").join(F.broadcast(stats), ["a", "b"])  # one row a pair
    top_a, top_b = (F.col("x") >= F.col("cx")).cast("double"), (F.col("y") >= F.col("cy")).cast("double")
    found = held.groupBy("a", "b", "n", "rho", "mid", "sd").agg(F.median(F.abs(F.col("y") - F.col("mid"))).alias("mad"), F.median(F.when(F.col("x") >= F.col("cut"), F.col("y"))).alias("top"), F.avg(top_a * top_b).alias("joint"), (F.avg(top_a) * F.avg(top_b)).alias("expected"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd"))
    return found.select("a", "b", "n", "rho", F.when(scale > 0, (F.col("top") - F.col("mid")) / scale).alias("effect"), "joint", "expected")


def chain_label_test(rows: DataFrame, treated: list[int], most: int = 20_000) -> DataFrame:
    """(metric, delta, labelings, p) of ``rows(metric, chain, value)``: Cliff's delta of the treated chains against the rest, and
    the share of all ways to label as many chains in which it is at least as far from 0.

    Ranks don't depend on labels, so each labeling adds up one rank sum a chain. More than ``most`` labelings are refused.
    """
    spark = rows.sparkSession
    chains = [r[0] for r in rows.select("chain").distinct().orderBy("chain").limit(most).collect()]
    if not set(treated) <= set(chains) or comb(len(chains), len(treated)) > most:
        raise ValueError(f"treated chains must be among the chains, with at most {most} labelings")
    named = [(i, c, set(pick) == set(treated)) for i, pick in enumerate(combinations(chains, len(treated))) for c in pick]
    labels = spark.createDataFrame(named, "labeling long, chain long, own boolean")
    ranked = rows.where("value is not null").withColumn("_rank", average_rank(F.col("value"), "metric"))
    sums = ranked.groupBy("metric", "chain").agg(F.sum("_rank").alias("_sum"), F.count("*").alias("_n"))
    totals = sums.groupBy("metric").agg(F.sum("_n").alias("_all"))
    picked = sums.join(F.broadcast(labels), "chain").groupBy("metric", "labeling", "own").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")).join(F.broadcast(totals), "metric")
    delta = F.coalesce(2 * ratio(F.col("_sum") - F.col("_n") * (F.col("_n") + 1) / 2, F.col("_n") * (F.col("_all") - F.col("_n"))) - 1, F.lit(0.0))
    deltas = picked.select("metric", "own", delta.alias("d"), F.max(F.when(F.col("own"), F.abs(delta))).over(Window.partitionBy("metric")).alias("_mine"))
    return deltas.groupBy("metric").agg(F.max(F.when(F.col("own"), F.col("d"))).alias("delta"), F.count("*").alias("labelings"), F.avg((F.abs("d") >= F.col("_mine") - 1e-9).cast("double")).alias("p"))


def rank_criteria(sweep: DataFrame, floor: float = 0.0) -> DataFrame:
    """(metric, worst, level, binds, place) of ``sweep(level, metric, delta)``: the lowest delta of each measure, the smallest
    level that gives it, whether it lies below ``floor``, and its place from the lowest on; ties go by name."""
    worst = sweep.groupBy("metric").agg(F.min(F.struct("delta", "level")).alias("_w")).select("metric", F.col("_w.delta").alias("worst"), F.col("_w.level").alias("level"))
    return worst.withColumns({"binds": F.col("worst") < floor, "place": F.row_number().over(Window.orderBy("worst", "metric"))})  # a row a measure


def quantised(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """``values`` with bucket, 0 to the number of shares: how many of the exact quantiles at ``shares`` the value exceeds; null
    where the value is."""
    cuts = values.agg(F.percentile(column, F.array(*[F.lit(float(q)) for q in shares])).alias("_cuts"))
    bucket = F.when(F.col(column).isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(column))))
    return values.join(F.broadcast(cuts), F.lit(True)).withColumn("bucket", bucket).drop("_cuts")


def scenario_problems(cases: DataFrame) -> DataFrame:
    """(case_id, problem) for each rule that ``cases(case_id, kind, shift)`` breaks: repeated id, no id, unknown kind, a planted
    case without a shift, a null case with one. A case may have several."""
    said = F.array(
        F.when(F.col("n") > 1, "repeated id"), F.when(F.col("case_id").isNull(), "no id"), F.when(F.col("odd"), "unknown kind"), F.when(F.col("still"), "planted without shift"), F.when(F.col("moved"), "null with shift")
    )
    some = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    kind, shift = F.col("kind"), F.coalesce("shift", F.lit(0))
    per = cases.groupBy("case_id").agg(F.count("*").alias("n"), some(~F.coalesce(kind.isin("planted", "null"), F.lit(False))).alias("odd"), some((kind == "planted") & (shift == 0)).alias("still"), some((kind == "null") & (shift != 0)).alias("moved"))
    return per.select("case_id", F.explode(F.array_compact(said)).alias("problem"))


def gate_sample(cases: DataFrame) -> DataFrame:
    """Planted cases, and those null cases whose ``in_gate_sample`` isn't false; unknown counts as in."""
    return cases.where((F.col("kind") != "null") | F.coalesce("in_gate_sample", F.lit(True)))


def qualified(summary: DataFrame, least_n: int, least_distinct: int, least_ess: float) -> DataFrame:
    """(metric, reasons, qualified) of ``summary(metric, n, distinct, ess)``: why an ensemble says too little about a measure."""
    said = F.array(F.when(F.col("n") < least_n, "few draws"), F.when(F.col("distinct") < least_distinct, "few distinct values"), F.when(F.coalesce("ess", F.lit(0.0)) < least_ess, "small effective size"))
    return summary.select("metric", F.array_join(F.array_compact(said), ", ").alias("reasons")).withColumn("qualified", F.col("reasons") == "")


def merged(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the rows of both; where both have a key the second's value holds, null or not."""
    b = second.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_there"))
    both = first.select(key, value).join(b, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    return both.select(F.when(F.col("_there"), F.col("_k")).otherwise(F.col(key)).alias(key), F.when(F.col("_there"), F.col("_v")).otherwise(F.col(value)).alias(value))
