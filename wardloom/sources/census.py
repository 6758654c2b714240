"""Census files read as lines of text: positional records, and lists whose header stands on the first line only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import last_known, running
from .tables import refuse

# Places (from 0) of fields in the pipe-separated geography and count files of Public Law 94-171, and the summary
# level of counties.
GEO_LEVEL, GEO_RECORD, GEO_ID, GEO_NAME = 2, 7, 9, 87
COUNT_RECORD, COUNT_POP = 4, 5
COUNTY_LEVEL = "050"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a text file in Latin-1, in the order of the file."""
    return spark.read.option("encoding", "ISO-8859-1").text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def census_units(geography: DataFrame, counts: DataFrame, level: str = COUNTY_LEVEL) -> DataFrame:
    """(unit, name, pop) of the units of one summary level: geography ``lines(text)`` joined with count lines by record number.

    Lines with too few fields and records that one side lacks are left out; a population that is no whole number is refused.
    """
    g, c = F.split("text", r"\|"), F.split("text", r"\|")
    places = geography.where(F.size(g) > GEO_NAME).select(F.get(g, F.lit(GEO_LEVEL)).alias("level"), F.get(g, F.lit(GEO_RECORD)).alias("record"), F.get(g, F.lit(GEO_ID)).alias("unit"), F.get(g, F.lit(GEO_NAME)).alias("name")).where(F.col("level") == level)
    people = counts.where(F.size(c) > COUNT_POP).select(F.get(c, F.lit(COUNT_RECORD)).alias("_record"), F.get(c, F.lit(COUNT_POP)).alias("_pop"))
    both = places.join(people, F.col("record") == F.col("_record"))
    out = both.select("unit", "name", F.col("_pop").try_cast("bigint").alias("pop"), "_pop")
    refuse(out.where("pop is null or pop < 0"), "unit", "populations that are no whole number, at units")
    return out.drop("_pop")


def adjacency_pairs(lines: DataFrame) -> DataFrame:
    """(u, v) with u < v of tab-separated ``lines(line, text)``: name and id of a unit, then name and id of a neighbour; a blank
    first field means the unit of the last line that had one. Loops are left out."""
    field = lambda i: F.trim(F.translate(F.get(F.split("text", "\t"), F.lit(i)), '"', " "))
    parsed = lines.where(F.size(F.split("text", "\t")) >= 4).select("line", F.when(field(0) != "", field(1)).alias("own"), field(3).alias("other"))
    carried = running(parsed, "unit", F.col("own"), last_known, [F.col("line")])
    return carried.where("unit is not null and unit <> other and other <> ''").select(F.least("unit", "other").alias("u"), F.greatest("unit", "other").alias("v")).distinct()


def pair_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(u, v, only): pairs that one of two lists of (u, v) lacks; ``only`` says which has it."""
    a, b = ours.select("u", "v").distinct(), theirs.select("u", "v").distinct()
    return a.join(b, ["u", "v"], "left_anti").withColumn("only", F.lit("ours")).unionByName(b.join(a, ["u", "v"], "left_anti").withColumn("only", F.lit("theirs")))
