"""A store of sampled draws that a run can be resumed from.

Draws of a chain are written once for each configuration, into a folder that only this attempt uses; what counts is the row of
the manifest that is added when they are whole. So a torn write is never read, a rerun writes what is missing and nothing
else, and chains of another seed are refused instead of mixed in. Everything goes through Spark's readers and writers, so the
store may lie wherever Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.components import settle
from .tables import InvalidTable

MANIFEST = "config string, chain long, seed long, completed boolean, attempt string, rows long, content string"


def config_digest(config: Mapping) -> str:
    """Sixteen hex digits that name a configuration: sha256 of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def content_of(columns: list[str]) -> Column:
    """A digest of a set of rows that doesn't depend on their order: their number and the sum of their hashes."""
    each = F.xxhash64(*[F.col(c) for c in sorted(columns)]).cast("decimal(38,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(each).cast("string"))


class DrawStore:
    """Draws by (configuration, chain) under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, config: Mapping) -> DataFrame:
        """(chain, seed, completed, attempt, rows, content) of the configuration; of several commits of a chain the first attempt in
        order of names counts, so that all readers take the same one."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing was committed yet
            rows = self.spark.createDataFrame([], MANIFEST)
        mine = rows.where(F.col("config") == config_digest(config))
        first = mine.groupBy("chain").agg(F.min(F.struct("attempt", "seed", "completed", "rows", "content")).alias("m"))
        return first.select("chain", "m.seed", "m.completed", "m.attempt", "m.rows", "m.content")

    def missing(self, config: Mapping, chains: DataFrame) -> DataFrame:
        """``chains(chain, seed)`` that are not committed. A chain that stands there with another seed is refused."""
        there = self.manifest(config).select(F.col("chain").alias("_chain"), F.col("seed").alias("_seed"))
        met = chains.join(there, F.col("chain") == F.col("_chain"), "left")
        foreign = met.where("_seed IS NOT NULL AND NOT seed <=> _seed").orderBy("chain").limit(8).collect()
        if foreign:
            raise InvalidTable("chains of another seed: " + ", ".join(f"{r['chain']} has {r['_seed']}, not {r['seed']}" for r in foreign))
        return met.where("_chain IS NULL").select(*chains.columns)

    def commit(self, config: Mapping, draws: DataFrame, chains: DataFrame) -> int:
        """Write ``draws(chain, ...)`` of ``chains(chain, seed, completed)`` that the store lacks; how many chains that were.

        Draws of chains that aren't listed are refused. A chain without draws is committed with none. The draws are read back
        before they count, so the manifest tells what really lies there.
        """
        todo = self.missing(config, chains.select("chain", "seed", "completed"))
        stray = draws.join(chains, "chain", "left_anti").select("chain").distinct().orderBy("chain").limit(8).collect()
        if stray:
            raise InvalidTable("draws of chains that are not listed: " + ", ".join(str(r["chain"]) for r in stray))
        todo = settle(todo)
        if not todo.limit(1).count():
            return 0
        attempt = uuid.uuid4().hex
        home = f"{self.path}/draws/config={config_digest(config)}/attempt={attempt}"
        draws.join(todo.select("chain"), "chain", "left_semi").write.partitionBy("chain").parquet(home)
        back = self._read(home, draws)
        found = back.groupBy("chain").agg(F.count("*").alias("rows"), content_of(draws.columns).alias("content"))
        rows = todo.join(found, "chain", "left").select(F.lit(config_digest(config)).alias("config"), "chain", "seed", "completed", F.lit(attempt).alias("attempt"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("content", F.lit("0:")).alias("content"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self.manifest(config).where(F.col("attempt") == attempt).count()

    def _read(self, home: str, like: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        try:
            return self.spark.read.schema(fields).parquet(home).select(*like.columns)
        except AnalysisException:  # all chains of the attempt were empty
            return self.spark.createDataFrame([], like.schema)

    def read(self, config: Mapping, schema: DataFrame, completed: bool | None = None) -> DataFrame:
        """The committed draws of a configuration, with the columns of ``schema``; of finished chains only, or of others only, where
        ``completed`` says so. Draws that no longer are what was committed are refused."""
        manifest = self.manifest(config)
        if completed is not None:
            manifest = manifest.where(F.col("completed") == completed)
        held = manifest.where("rows > 0")
        attempts = [r["attempt"] for r in held.select("attempt").distinct().orderBy("attempt").collect()]  # one for each commit
        parts = []
        for a in attempts:
            mine = held.where(F.col("attempt") == a).select("chain")
            parts.append(self._read(f"{self.path}/draws/config={config_digest(config)}/attempt={a}", schema).join(F.broadcast(mine), "chain", "left_semi").select(*schema.columns))
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema.schema)
        found = out.groupBy("chain").agg(content_of(schema.columns).alias("_content"))
        torn = held.join(found, "chain", "left").where("NOT content <=> _content").select("chain").orderBy("chain").limit(8).collect()
        if torn:
            raise InvalidTable("chains that are not what was committed: " + ", ".join(str(r["chain"]) for r in torn))
        return out
