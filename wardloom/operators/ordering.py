"""Orders over whole tables without one task for all rows.

Rows are dealt into ranges of the order, so a window works inside a range; what a row needs from other ranges is one row for
each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import settle


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with _part, the number of their range of ``order``; equal keys share a range. Settled, so that ranges stay."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in ``order``; ties take any order, unless a last key settles them."""
    dealt = ranged(rows, *order)
    sizes = dealt.groupBy(F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), F.col("_part") == F.col("_at")).withColumn(name, (inner + F.col("_start")).cast("long")).drop("_part", "_at", "_start")


def running(rows: DataFrame, name: str, value: Column, fold, order: list[Column], inclusive: bool = True) -> DataFrame:
    """``rows`` with ``name``: ``fold`` (``F.max``, ``F.min`` or the like) of ``value`` over the rows up to each in ``order``.

    Without ``inclusive`` over those before it. Equal keys of ``order`` are taken one by one, in any order.
    """
    dealt = ranged(rows.withColumn("_value", value), *order)
    ends = dealt.groupBy(F.col("_part").alias("_at")).agg(fold("_value").alias("_all"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ends.select("_at", fold("_all").over(before).alias("_carried"))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = dealt.join(F.broadcast(starts), F.col("_part") == F.col("_at")).withColumn("_own", fold("_value").over(inner))
    both = F.array(F.col("_carried"), F.col("_own"))
    folded = F.array_max(both) if fold is F.max else F.array_min(both) if fold is F.min else F.coalesce("_own", "_carried")
    return joined.withColumn(name, folded).drop("_part", "_at", "_carried", "_own", "_value")


def last_known(value: str | Column) -> Column:
    """The last value that is not null, as a ``fold`` for :func:`running`."""
    return F.last(value, ignorenulls=True)
