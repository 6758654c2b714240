"""Where queries are registered, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from .mapping import PRELUDE, State

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to nine digits, as in the SQL."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Register a function of a State under its name, with the SQL that follows the prelude."""

    def add(f: Callable[[State], DataFrame]) -> Callable[[State], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(State(spark, sf_dir)))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql is not None:
            ORACLE_SQL[f.__name__] = PRELUDE + sql if not sql.lstrip().startswith("!") else sql.lstrip()[1:]
        return f

    return add
