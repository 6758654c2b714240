"""Null cases: strata of neutral plans, ranked and interleaved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def hash_order(key: str, salt: str):
    """A reproducible random order: sha256 of the key and a salt."""
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt)), 256)


def random_stratum(plans: DataFrame, n: int, salt: str = "random") -> DataFrame:
    """(plan, place): the first ``n`` plans in hash order."""
    return plans.select("plan", hash_order("plan", salt).alias("_h")).orderBy("_h").limit(n).select("plan", F.row_number().over(Window.orderBy("_h")).alias("place"))


def top_concentration(concentration: DataFrame, n: int) -> DataFrame:
    """(plan, concentration, place): plans with the most concentrated votes, ties by plan."""
    top = concentration.orderBy(F.desc("concentration"), "plan").limit(n)
    return top.select("plan", "concentration", F.row_number().over(Window.orderBy(F.desc("concentration"), "plan")).alias("place"))


def interleave(scored: DataFrame, middle: float, n: int) -> DataFrame:
    """(plan, side, place) of ``scored(plan, seats, rank)``: plans above and below the middle in turn, the longer side
    first, level ones last."""
    side = F.when(F.col("seats") > middle, "above").when(F.col("seats") < middle, "below").otherwise("level")
    rows = scored.withColumn("side", side)
    sizes = rows.groupBy("side").agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy("side").orderBy("rank", "plan"))
    turned = rows.join(F.broadcast(sizes), "side").withColumn("_turn", turn).withColumn("_last", (F.col("side") == "level").cast("int"))
    placed = numbered(turned.select("plan", "side", "_last", "_turn", "_size"), "place", F.col("_last"), F.col("_turn"), F.desc("_size"), F.col("side"))
    return placed.where(F.col("place") <= n).select("plan", "side", F.col("place").cast("int").alias("place"))


def except_blocked(plans: DataFrame, blocked: DataFrame) -> DataFrame:
    """First plan of each canonical key, without blocked keys."""
    first = plans.join(blocked.select("key"), "key", "left_anti").groupBy("key").agg(F.min("plan").alias("plan"))
    return first.select("plan", "key")
