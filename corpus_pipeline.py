"""The corpus pipeline: documents without toxic ones, near copies and benchmark passages, mixed by source and sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardloom.llm.common import scratch_database, settle
from wardloom.llm.decontaminate import decontaminate
from wardloom.llm.mixing import mix_documents
from wardloom.llm.ngram_join import near_duplicate_keep
from wardloom.llm.sharding import assign_shards
from wardloom.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (operator 10) doesn't reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 1), the one with the smallest id."""
    return near_duplicate_keep(docs, k=5, pct=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 7)."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, share=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights (operator 9)."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes (operator 3)."""
    return assign_shards(docs, shards=40)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages hold trained models and random draws, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; a stage's rows go when those
    of the next are written. The result lies in the checkpoint folder, and nothing else is left behind, also if a stage fails.

    Rows with a null text, or an empty one, pass the first three stages and are nothing to mix. Rows without doc_id are judged
    by their text. Of rows that repeat each other, or tie otherwise, one stays. An empty table gives no rows. Very long texts are
    read whole by every stage. Columns of any name are kept up to the mix.
    """
    home = scratch_database(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.format("parquet").saveAsTable(f"{home}.{name}")
            docs = spark.table(f"{home}.{name}")
            if k:
                spark.sql(f"DROP TABLE {home}.{STAGES[k - 1][0]}")
        return settle(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        spark.sql(f"DROP DATABASE {home} CASCADE")
