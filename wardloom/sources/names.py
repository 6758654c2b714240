"""Tables that know places by name only, joined to units with their sums held against each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import settle
from .tables import InvalidTable

#: What a place's name may end in beside the name itself.
ENDINGS = ("COUNTY",)


def name_key(name: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    """A name in capitals, without one of ``endings`` after a space, reduced to the letters A to Z; null for null."""
    upper = F.upper(F.trim(name))
    if endings:
        upper = F.regexp_replace(upper, rf"\s+({'|'.join(endings)})$", "")
    return F.regexp_replace(upper, "[^A-Z]", "")


def name_collisions(names: DataFrame, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(key, spellings, examples) of ``names(name)``: keys that several different names come down to, and the first few of them."""
    keyed = names.select("name", name_key(F.col("name"), endings).alias("key")).where("key IS NOT NULL").distinct()
    rank = keyed.groupBy("key").agg(F.count("*").alias("spellings"), F.min("name").alias("first"), F.max("name").alias("last"))
    return rank.where("spellings > 1").select("key", "spellings", F.array("first", "last").alias("examples"))


def summed_by_name(units: DataFrame, records: DataFrame, columns: list[str], totals: Mapping[str, int] | None = None, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(unit, *columns): sums of ``records(name, *columns)`` on ``units(unit, name)`` of the same name, however it is spelled.

    Refused, with examples: units whose names come down to one key, units without records, records whose name is no unit's
    (their numbers would be lost), and sums that differ from ``totals``, where these are given. Null numbers count as 0, null
    names are no unit's. Sums and checks come from one pass over the records.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    by = records.groupBy(name_key(F.col("name"), endings).alias("_key")).agg(F.count("*").alias("_n"), F.min("name").alias("_name"), *[zero(c) for c in columns])
    places = units.select("unit", F.col("name").alias("unit_name"), name_key(F.col("name"), endings).alias("key"))
    met = settle(places.join(by, F.col("key") == F.col("_key"), "full_outer"))
    said = []
    some = lambda rows, c: ", ".join(str(r[0]) for r in rows.select(c).orderBy(c).limit(8).collect())
    for rows, column, what in (
        (places.groupBy("key").agg(F.count("*").alias("n"), F.concat_ws(" / ", F.min("unit_name"), F.max("unit_name")).alias("names")).where("n > 1"), "names", "units of one name"),
        (met.where("unit IS NOT NULL AND _n IS NULL"), "unit_name", "units without records"),
        (met.where("unit IS NULL"), "_name", "records of no unit"),
    ):
        if named := some(rows, column):
            said.append(f"{what}: {named}")
    if said:
        raise InvalidTable("; ".join(said))
    if totals:
        sums = met.agg(*[zero(c) for c in totals]).first().asDict()
        wrong = {c: sums[c] for c, n in totals.items() if sums[c] != n}
        if wrong:
            raise InvalidTable(f"sums {wrong} differ from the certified {dict(totals)}")
    return met.select("unit", *columns)
