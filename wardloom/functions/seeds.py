"""Seeds derived from one master seed: the same on every machine and Python version."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name of the seed stream, which can be given anew to meet another program's seeds, and the width of a seed.
DOMAIN = b"wardloom/seeds/v1"
BITS = 63


def derive(master: int, purpose: str, index: int, domain: bytes = DOMAIN) -> int:
    """The 63-bit seed of (master, purpose, index): BLAKE2b-64 of the four fields, each after its length in 8 bytes."""
    for value, kind in ((master, int), (purpose, str), (index, int)):
        if isinstance(value, bool) or not isinstance(value, kind):
            raise TypeError(f"{value!r} is no {kind.__name__}")
    h = hashlib.blake2b(digest_size=8)
    for field in (domain, b"%d" % master, purpose.encode(), b"%d" % index):
        h.update(len(field).to_bytes(8, "big") + field)
    return int.from_bytes(h.digest(), "big") >> (64 - BITS)


def stream(master: int, purpose: str, count: int) -> list[int]:
    return [derive(master, purpose, i) for i in range(count)]


def seed_column(master: int, purpose: str, index: Column) -> Column:
    """``derive`` over a column of indices, in Arrow batches."""

    def run(i: pd.Series) -> pd.Series:
        return i.map(lambda x: derive(master, purpose, int(x)))

    return F.pandas_udf(run, "long")(index)


def seeds(spark_range: DataFrame, master: int, purpose: str) -> DataFrame:
    """(index, seed) for ``spark.range(n)``."""
    return spark_range.select(F.col("id").alias("index"), seed_column(master, purpose, F.col("id")).alias("seed"))
