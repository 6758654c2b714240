"""Distributions of measures over an ensemble, and where single plans stand in them.

``draws(plan, metric, value)`` is long; value null where undefined. Nothing here is a verdict or a combined score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, ratio

MIN_ENSEMBLE = 20
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
STATUSES = ("located", "value_undefined", "degenerate", "missing_from_ensemble", "insufficient_ensemble")


def long_draws(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """(plan, metric, value) from one column for each metric; NaN and infinities become null."""
    rows = wide.select("plan", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["plan"], metrics, "metric", "value")
    return rows.withColumn("value", finite(F.col("value")))


def summarize(draws: DataFrame) -> DataFrame:
    """A row a metric: n, n_undefined, distinct, mean, population sd, least, most, quantiles, Kish's effective size, how
    often the extremes occur, and the interior percentiles that the sample can express."""
    counts = draws.groupBy("metric", "value").agg(F.count("*").alias("m"))
    some, m, v = F.col("value").isNotNull(), F.col("m"), F.col("value")
    q = F.percentile(v, F.array(*[F.lit(x) for x in QUANTILES.values()]), F.when(some, m).otherwise(0))
    out = counts.groupBy("metric").agg(
        F.coalesce(F.sum(F.when(some, m)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~some, m)), F.lit(0)).alias("n_undefined"),
        F.count_if(some).alias("distinct"),
        ratio(F.sum(v * m), F.sum(F.when(some, m))).alias("mean"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        q.alias("_q"),
        ratio(F.pow(F.sum(F.when(some, m)).cast("double"), 2), F.sum(F.when(some, m * m))).alias("ess"),
        F.min_by(m, v).alias("mult_least"),
        F.max_by(m, v).alias("mult_most"),
    )
    spread = draws.where("value is not null").groupBy(F.col("metric").alias("_m")).agg(F.stddev_pop("value").alias("sd"))
    out = out.join(spread, F.col("metric") == F.col("_m"), "left").drop("_m")
    names = {name: F.get("_q", F.lit(i)) for i, name in enumerate(QUANTILES)}
    return out.withColumns(names).withColumns({"max_interior": 1 - ratio(0.5 * F.col("mult_most"), F.col("n")), "min_interior": ratio(0.5 * F.col("mult_least"), F.col("n"))}).drop("_q")


def kish_ess(items: DataFrame, key: str) -> DataFrame:
    """n^2 / sum of squared multiplicities of ``key``."""
    m = items.groupBy(key).agg(F.count("*").alias("m"))
    return m.agg(ratio(F.pow(F.sum("m").cast("double"), 2), F.sum(F.col("m") * F.col("m"))).alias("ess"))


def locate(cases: DataFrame, draws: DataFrame, degenerate: DataFrame | None = None, min_n: int = MIN_ENSEMBLE) -> DataFrame:
    """Where each case's value stands in its metric's distribution.

    ``cases(case_id, metric, value)``; ``degenerate(metric, reason)`` names metrics that no plan can move. Statuses in
    order: value_undefined, degenerate (declared), missing_from_ensemble, degenerate (constant), insufficient_ensemble,
    located. Only located cases get percentile (half of ties below), p_below, p_at_or_below, two_sided and z.
    """
    summary = summarize(draws).withColumnRenamed("metric", "_metric")
    # counts below and at each case value: one union and one running sum by metric and value
    values = draws.where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("m"))
    asked = cases.where("value is not null").select("metric", "value").distinct().withColumn("m", F.lit(0).cast("long"))
    points = values.unionByName(asked).groupBy("metric", "value").agg(F.sum("m").alias("ties"))
    before = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("below", F.coalesce(F.sum("ties").over(before), F.lit(0))).select(F.col("metric").alias("_pm"), F.col("value").alias("_pv"), "ties", "below")
    out = cases.join(F.broadcast(summary), F.col("metric") == F.col("_metric"), "left").join(points, (F.col("metric") == F.col("_pm")) & (F.col("value") == F.col("_pv")), "left")
    why = F.lit(None).cast("string")
    if degenerate is not None:
        out = out.join(F.broadcast(degenerate.select(F.col("metric").alias("_dm"), "reason")), F.col("metric") == F.col("_dm"), "left")
        why = F.col("reason")
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("value").isNull(), "value_undefined")
        .when(why.isNotNull(), "degenerate")
        .when(n == 0, "missing_from_ensemble")
        .when(F.col("least") == F.col("most"), "degenerate")
        .when(n < min_n, "insufficient_ensemble")
        .otherwise("located")
    )
    out = out.withColumn("status", status)
    at = lambda x: F.when(F.col("status") == "located", x)
    low, high = ratio(F.col("below") + F.col("ties"), n), ratio(n - F.col("below"), n)
    return out.select(
        *cases.columns,
        "status",
        n.alias("n"),
        "distinct",
        "ess",
        "max_interior",
        "min_interior",
        at(ratio(F.col("below") + 0.5 * F.col("ties"), n)).alias("percentile"),
        at(ratio(F.col("below"), n)).alias("p_below"),
        at(low).alias("p_at_or_below"),
        at(F.least(F.lit(1.0), 2.0 * F.least(low, high))).alias("two_sided"),
        at(F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))).alias("z"),
        at((F.col("value") < F.col("least")) | (F.col("value") > F.col("most"))).alias("outside_support"),
    )


def by_status(locations: DataFrame) -> DataFrame:
    """(status, cases): all statuses, also those without cases."""
    domain = locations.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = locations.groupBy("status").agg(F.count("*").alias("cases"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("cases", F.lit(0)).alias("cases"))


def central_band(draws: DataFrame, coverage: float = 0.9) -> DataFrame:
    """(measure, lo, hi): the central share of each metric."""
    tail = (1 - coverage) / 2
    return draws.groupBy(F.col("metric").alias("measure")).agg(F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1 - tail)).alias("hi"))


def matched_band(anchor: DataFrame, draws: DataFrame, width: float = 0.5) -> DataFrame:
    """(measure, lo, hi): an anchor's value, give or take ``width`` interquartile ranges of the ensemble."""
    iqr = draws.groupBy(F.col("metric").alias("measure")).agg((F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"))
    here = anchor.select(F.col("metric").alias("_m"), F.col("value").alias("at"))
    return iqr.join(here, F.col("measure") == F.col("_m")).select("measure", (F.col("at") - width * F.col("iqr")).alias("lo"), (F.col("at") + width * F.col("iqr")).alias("hi"))


def floor_band(draws: DataFrame, larger_is_better: dict[str, bool]) -> DataFrame:
    """(measure, lo, hi): one side only, the worst value seen."""
    better = F.create_map(*[x for m, b in larger_is_better.items() for x in (F.lit(m), F.lit(b))])
    ends = draws.groupBy(F.col("metric").alias("measure")).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    good = better[F.col("measure")]
    return ends.where(good.isNotNull()).select("measure", F.when(good, F.col("least")).otherwise(float("-inf")).alias("lo"), F.when(good, float("inf")).otherwise(F.col("most")).alias("hi"))


def violations(values: DataFrame, bounds: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(plan, metric, value, side): values outside their bounds; null values violate."""
    b = F.broadcast(bounds.select(F.col("measure").alias("metric"), "lo", "hi"))
    out = values.join(b, "metric")
    side = F.when(F.col("value").isNull(), "undefined").when(F.col("value") < F.col("lo") - tolerance, "low").when(F.col("value") > F.col("hi") + tolerance, "high")
    return out.withColumn("side", side).where("side is not null").select("plan", "metric", "value", "side")


def inside(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Plans without a violation."""
    return values.select("plan").distinct().join(violations(values, bounds).select("plan").distinct(), "plan", "left_anti")


def indistinguishable(plan_values: DataFrame, values: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(plan): plans whose every metric equals the reviewed plan's within ``tolerance``; nulls equal nulls."""
    mine = F.broadcast(plan_values.select("metric", F.col("value").alias("_own")))
    same = F.coalesce(F.abs(F.col("value") - F.col("_own")) <= tolerance, F.col("value").isNull() & F.col("_own").isNull())
    return values.join(mine, "metric").groupBy("plan").agg(F.min(same).alias("same")).where("same").select("plan")
