"""Reports of earlier rounds: read over time while their fields grow, and bounds taken from the last one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ensemble import violations


def read_rounds(spark: SparkSession, pattern: str, number: str = r"round-(\d+)") -> DataFrame:
    """One row for each report under ``pattern`` (JSON, an object a file), with ``round``, its number in the path. Fields are
    those of all reports together; a report that lacks one has null there."""
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    at = F.regexp_extract(F.col("_metadata.file_path"), number, 1)
    return rows.select(F.when(at != "", at.cast("long")).alias("round"), "*").where("round IS NOT NULL")


def round_history(rounds: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(round, *fields) in the order given; a field may be inside others (``gates.fpr``), and is named by its last part. A field that
    no report has is null throughout."""

    def pick(path: str):
        kind = rounds.schema
        for part in path.split("."):
            names = {f.name: f.dataType for f in getattr(kind, "fields", [])}
            if part not in names:
                return F.lit(None).cast("double").alias(path.split(".")[-1])
            kind = names[part]
        return F.col(path).alias(path.split(".")[-1])

    return rounds.select("round", *[pick(f) for f in fields])


def latest_floor(rounds: DataFrame, field: str = "floor") -> DataFrame:
    """(measure, lo, hi): the bounds in the last report that has any; a missing end is open."""
    if field not in rounds.columns:
        return rounds.sparkSession.createDataFrame([], "measure string, lo double, hi double")
    last = rounds.where(F.size(field) > 0).groupBy().agg(F.max_by(F.col(field), F.col("round")).alias("bounds"))
    rows = last.select(F.explode("bounds").alias("b"))
    names = {f.name for f in rows.schema["b"].dataType.fields}
    end = lambda n, open_: F.coalesce(F.col(f"b.{n}").cast("double") if n in names else F.lit(None), F.lit(open_)).alias(n)
    return rows.select(F.col("b.measure").alias("measure"), end("lo", float("-inf")), end("hi", float("inf")))


def checked_again(cases: DataFrame, bounds: DataFrame) -> DataFrame:
    """(plan, legal, broken) of ``cases(plan, metric, value)``: whether each case keeps within bounds that were found after it was
    made, and which measures do not. A bounded measure that a case lacks is broken."""
    wanted = cases.select("plan").distinct().join(F.broadcast(bounds.select(F.col("measure").alias("metric"))), F.lit(True))
    values = wanted.join(cases, ["plan", "metric"], "left").select("plan", "metric", "value")
    broken = violations(values, bounds).groupBy("plan").agg(F.array_sort(F.collect_set("metric")).alias("broken"))
    out = cases.select("plan").distinct().join(broken, "plan", "left")
    return out.select("plan", F.col("broken").isNull().alias("legal"), F.coalesce("broken", F.array().cast("array<string>")).alias("broken"))
