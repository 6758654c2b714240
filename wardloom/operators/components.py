"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Where none is set, a local master gets a temporary folder; on a cluster, whose machines would not share it, that is an error.
    """
    sc, told = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not told and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return told or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Written to the session's shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared one, which goes with all that lies in it."""
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{checkpoint_folder(spark).rstrip('/')}/{name}'")
    try:
        spark.sql(f"CREATE TABLE {name}.files (value string) USING text")
        yield spark.sql(f"DESCRIBE DATABASE {name}").where("info_name = 'Location'").first()["info_value"] + "/files/kept"
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _star(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the smallest v of each u beside them.

    The join key is -u: the join then has an exchange of its own on both sides, whose large partitions Spark may
    split when one node has very many arcs.
    """
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    left, right = arcs.withColumn("_k", -F.col("u")), least.select((-F.col("u")).alias("_k"), "m")
    return left.join(right, "_k").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)`` (longs); component is the smallest node reached.

    Large-star and small-star steps alternate until the edges are stars around the smallest nodes. Nodes without
    edges are not returned. Loops, repeated edges and either direction are fine; null ends are ignored; no edges
    give no rows.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _star(large.distinct())
        now = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
