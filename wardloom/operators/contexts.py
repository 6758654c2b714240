"""What a reader must know beside a plan's numbers: which measures mean little here, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .administrative import degeneracy_report
from .partisan import METRICS, trusted_metrics


def election_context(metrics: DataFrame) -> DataFrame:
    """(plan, metric, usable, reason) of the partisan measures, from ``partisan.all_metrics``."""
    rows = trusted_metrics(metrics).select("plan", "trusted", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    usable = F.array_contains("trusted", F.col("metric"))
    return rows.select("plan", "metric", usable.alias("usable"), F.when(~usable, F.lit("not to be trusted on these votes")).alias("reason"))


def administrative_context(membership: DataFrame, layers: int = 1, districts: int | None = None) -> DataFrame:
    """(metric, usable, reason) of the administrative measures over these units, alike for all plans."""
    return degeneracy_report(membership, layers, districts).select("metric", (~F.col("constant") & F.col("computable")).alias("usable"), "reason")


def context_for(metrics: DataFrame, membership: DataFrame, layers: int = 1, districts: int | None = None) -> DataFrame:
    """(plan, metric, usable, reason): both contexts for every plan. A metric that both speak of is unusable if either says so, with
    both reasons."""
    admin = metrics.select("plan").distinct().join(F.broadcast(administrative_context(membership, layers, districts)), F.lit(True))
    both = election_context(metrics).unionByName(admin)
    reasons = F.array_join(F.array_sort(F.collect_set("reason")), "; ")
    return both.groupBy("plan", "metric").agg(F.bool_and("usable").alias("usable"), F.nullif(reasons, F.lit("")).alias("reason"))


def usable_locations(locations: DataFrame, context: DataFrame) -> DataFrame:
    """``locations(case_id, metric, ...)`` with trusted and reason from ``context``; metrics that it doesn't speak of are trusted."""
    c = context.select(F.col("plan").alias("_plan"), F.col("metric").alias("_metric"), "usable", "reason")
    met = locations.join(c, (F.col("case_id") == F.col("_plan")) & (F.col("metric") == F.col("_metric")), "left")
    return met.withColumn("trusted", F.coalesce("usable", F.lit(True))).drop("_plan", "_metric", "usable")


def analysis_context(units: DataFrame, edges: DataFrame, contests: dict[str, DataFrame], prefix: int = 5) -> dict[str, DataFrame]:
    """The frames of one state that an analysis reads: units, edges, populations, votes of each contest, and the county of each unit,
    the first ``prefix`` characters of its id. Contests must have the same units as the state; units that they lack or add are
    named in the error."""
    out = {"units": units, "edges": edges, "populations": units.select("unit", "pop"), "counties": units.select("unit", F.substring(F.col("unit").cast("string"), 1, prefix).alias("parent"))}
    for name, votes in contests.items():
        mine, theirs = units.select("unit"), votes.select("unit")
        apart = mine.join(theirs, "unit", "left_anti").unionByName(theirs.join(mine, "unit", "left_anti")).orderBy("unit").limit(8).collect()
        if apart:
            raise ValueError(f"contest {name} and the state differ at units {', '.join(str(r['unit']) for r in apart)}")
        out[f"votes_{name}"] = votes
    return out
