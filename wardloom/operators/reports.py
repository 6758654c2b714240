"""Reports on single plans and ensembles as rows and JSON. Numbers stand beside their caveats; there is no verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPACTNESS_SPREAD = 0.15
COMPARABLE = ("polsby_popper", "reock", "convex_hull")
SIGNED = ("efficiency_gap", "mean_median", "declination")


def disagreements(metrics: DataFrame, trusted: DataFrame, shapes: DataFrame | None = None, degenerate: DataFrame | None = None, layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """(plan, kind, magnitude, metrics): where a plan's measures contradict each other, largest first.

    Kinds: compactness_measures_disagree (means of ``shapes`` span more than 0.15), partisan_metrics_disagree_in_sign,
    partisan_metrics_not_trustworthy_here; with ``degenerate(metric, reason)`` metrics_constant_by_construction for each plan, and
    with ``layers`` (membership(unit, parent) by name) subdivision_layer_is_empty_on_these_units for each layer without parents.
    """
    signed = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in SIGNED])
    some = F.filter(signed, lambda s: s["v"].isNotNull() & (s["v"] != 0))
    apart = (F.size(F.filter(some, lambda s: s["v"] > 0)) > 0) & (F.size(F.filter(some, lambda s: s["v"] < 0)) > 0)
    names = lambda a: F.transform(a, lambda s: s["m"])
    signs = metrics.where(apart).select("plan", F.lit("partisan_metrics_disagree_in_sign").alias("kind"), F.lit(0.0).alias("magnitude"), names(some).alias("metrics"))
    every = F.array(*[F.lit(m) for m in (*SIGNED, "partisan_bias")])
    doubt = trusted.select("plan", F.array_except(every, "trusted").alias("metrics")).where(F.size("metrics") > 0)
    out = signs.unionByName(doubt.select("plan", F.lit("partisan_metrics_not_trustworthy_here").alias("kind"), F.lit(0.0).alias("magnitude"), "metrics"))
    if shapes is not None:
        have = [c for c in COMPARABLE if c in shapes.columns]
        span = F.greatest(*have) - F.least(*have)
        out = out.unionByName(shapes.where(span > COMPACTNESS_SPREAD).select("plan", F.lit("compactness_measures_disagree").alias("kind"), span.alias("magnitude"), F.array(*[F.lit(c) for c in have]).alias("metrics")))
    if degenerate is not None:
        constant = degenerate.agg(F.array_sort(F.collect_set("metric")).alias("metrics")).where(F.size("metrics") > 0)
        out = out.unionByName(metrics.select("plan").crossJoin(F.broadcast(constant)).select("plan", F.lit("metrics_constant_by_construction").alias("kind"), F.lit(0.0).alias("magnitude"), "metrics"))
    for name, membership in (layers or {}).items():
        empty = membership.agg(F.count("parent").alias("_known")).where("_known = 0")
        out = out.unionByName(metrics.select("plan").crossJoin(F.broadcast(empty)).select("plan", F.lit("subdivision_layer_is_empty_on_these_units").alias("kind"), F.lit(0.0).alias("magnitude"), F.array(F.lit(name)).alias("metrics")))
    return out


def plan_report(metrics: DataFrame, caveats: DataFrame, locations: DataFrame) -> DataFrame:
    """(plan, report): one JSON object a plan with measures, caveats and, by metric, where the plan stands or why not."""
    where = locations.groupBy(F.col("case_id").alias("plan")).agg(F.array_sort(F.collect_list(F.struct("metric", "status", "percentile", "two_sided", "n"))).alias("locations"))
    measures = F.struct(*[c for c in metrics.columns if c != "plan"])
    rows = metrics.select("plan", measures.alias("measures")).join(caveats, "plan", "left").join(where, "plan", "left")
    return rows.select("plan", F.to_json(F.struct("measures", "caveats", "locations")).alias("report"))


def histogram(draws: DataFrame, bins: int = 10) -> DataFrame:
    """(metric, bin, n): equal-width bins between a metric's extremes; the last takes its upper end."""
    ends = draws.groupBy(F.col("metric").alias("_m")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = draws.where("value is not null").join(F.broadcast(ends), F.col("metric") == F.col("_m"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return rows.groupBy("metric", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def attempts(cases: DataFrame) -> DataFrame:
    """(party, magnitude, attempted, reached, level) of ``cases(party, magnitude, reached)`` with subtotals: level 0 single
    cells, 1 a party's total, 3 the total."""
    return cases.rollup("party", "magnitude").agg(F.count("*").alias("attempted"), F.count_if(F.col("reached")).alias("reached"), F.grouping_id().alias("level"))
