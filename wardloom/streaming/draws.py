"""Structured Streaming over draws and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_draws(spark: SparkSession, path: str, schema: str = "metric string, chain long, draw long, value double") -> DataFrame:
    """Draws as they are written to a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def running_moments(draws: DataFrame) -> DataFrame:
    """(metric, n, mean, sd, least, most) of all draws so far; for complete output."""
    return draws.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of ``events(ts, event_type, value)`` in windows that close ``late`` after their end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_located(draws: DataFrame, reference: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of draws beside its place in a fixed reference ensemble, appended to Parquet."""
    from ..operators.ensemble import locate

    def batch(df: DataFrame, number: int) -> None:
        cases = df.select(F.concat_ws("-", F.col("chain").cast("string"), F.col("draw").cast("string")).alias("case_id"), "metric", "value")
        locate(cases, reference).write.parquet(f"{path}/batch={number}", mode="overwrite")

    return draws.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
