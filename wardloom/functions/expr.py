"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def rounded(x: Column, digits: int = 9) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(x, digits) + F.lit(0.0)


def average_rank(value: Column, *partition: str) -> Column:
    """Rank from 1, ties sharing the mean of their ranks."""
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return rank.cast("double") + (ties - 1) / F.lit(2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """95 % Wilson interval as a struct(low, high); null when n is 0."""
    n, p = n.cast("double"), ratio(k, n)
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


def close(a: Column, b: Column) -> Column:
    """Equal within a relative 1e-9 or an absolute 1e-12."""
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))


def subdivision_id(x: Column) -> Column:
    """A trimmed parent id; null for blank and for the usual spellings of nothing."""
    text = F.trim(x.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "<na>"), text)
