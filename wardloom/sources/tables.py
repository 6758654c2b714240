"""Readers, writers and checks of districting tables.

Checks raise with a sample of what is wrong; nothing is repaired.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import subdivision_id
from ..operators.graph import plan_digest

UNITS = "GEOID string, NAME string, pop bigint"
PLAN = "GEOID string, district string"
#: Columns that the neutral side may see: no votes.
NEUTRAL = frozenset({"GEOID", "NAME", "pop", "geometry"})
# Party letters of vote columns, and the form of such a column (contest, party, surname).
PARTIES = {"D": "Democratic", "R": "Republican", "L": "Libertarian", "G": "Green", "I": "Independent"}
VOTE_COLUMN = r"^(G\d{2}[A-Z]{3})([A-Z])([A-Z]{3})$"


class InvalidTable(ValueError):
    """A table breaks its rules."""


def refuse(bad: DataFrame, column: str, what: str) -> None:
    """Raise if ``bad`` has rows, naming up to eight values."""
    some = [str(r[0]) for r in bad.select(column).orderBy(column).limit(9).collect()]
    if some:
        raise InvalidTable(f"{what}: {', '.join(some[:8])}{' and more' if len(some) > 8 else ''}")


def guard(columns: list[str]) -> None:
    """Refuse any column that the neutral side may not see."""
    more = sorted(set(columns) - NEUTRAL)
    if more:
        raise InvalidTable(f"columns not allowed on the neutral side: {', '.join(more)}")


def load_units(spark: SparkSession, path: str) -> DataFrame:
    """(unit, name, pop) from CSV; ids stay text."""
    guard(spark.read.csv(path, header=True).columns)
    df = spark.read.csv(path, header=True, schema=UNITS, mode="FAILFAST").select(F.col("GEOID").alias("unit"), F.col("NAME").alias("name"), "pop")
    refuse(df.where("pop is null or pop < 0"), "unit", "units without a valid population")
    refuse(df.groupBy("unit").count().where("count > 1"), "unit", "repeated units")
    return df


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """(unit, district) from CSV; refuses missing columns, blank or repeated units, and districts that are no whole number."""
    raw = spark.read.csv(path, header=True)
    if not {"GEOID", "district"} <= set(raw.columns):
        raise InvalidTable("a plan needs the columns GEOID and district")
    df = raw.select(F.trim("GEOID").alias("unit"), F.col("district").alias("_d"), F.expr("try_cast(trim(district) as int)").alias("district"))
    if df.limit(1).count() == 0:
        raise InvalidTable("the plan is empty")
    refuse(df.where("unit is null or unit = ''").withColumn("_at", F.lit("blank")), "_at", "rows without a unit")
    refuse(df.where("district is null"), "unit", "districts that are no whole number, at units")
    refuse(df.groupBy("unit").count().where("count > 1"), "unit", "repeated units")
    return df.select("unit", "district")


def load_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Arcs (u, v) from one JSON object of unit to neighbours (see ``load_inputs`` for checks)."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("u", "vs"))
    return lists.select("u", F.explode("vs").alias("v"))


def load_elections(spark: SparkSession, path: str) -> DataFrame:
    """Long votes (unit, contest, party, column, votes) from a wide CSV.

    Refuses ragged rows, missing or negative counts, and blank or repeated units.
    """
    raw = spark.read.csv(path, header=True)
    if "GEOID" not in raw.columns:
        raise InvalidTable("votes need the column GEOID")
    refuse(raw.where("GEOID is null or trim(GEOID) = ''").withColumn("_at", F.lit("blank")), "_at", "rows of votes without a unit")
    refuse(raw.groupBy("GEOID").count().where("count > 1"), "GEOID", "units with several rows of votes")
    columns = [c for c in raw.columns if re.match(VOTE_COLUMN, c)]
    if not columns:
        raise InvalidTable("no vote columns")
    long = raw.select(F.col("GEOID").alias("unit"), *[F.expr(f"try_cast(`{c}` as bigint)").alias(c) for c in columns]).unpivot(["unit"], columns, "column", "votes")
    refuse(long.where("votes is null or votes < 0"), "unit", "missing or negative votes at units")
    return long.select("unit", F.regexp_extract("column", VOTE_COLUMN, 1).alias("contest"), F.regexp_extract("column", VOTE_COLUMN, 2).alias("party"), "column", "votes")


def contests(votes: DataFrame) -> DataFrame:
    return votes.select("contest").distinct()


def party_name(letter: str) -> str:
    return PARTIES.get(letter.upper(), letter)


def two_party(votes: DataFrame, contest: str) -> DataFrame:
    """(unit, dem, rep) of a contest with exactly one column of each party."""
    mine = votes.where(F.col("contest") == contest)
    per = {r["party"]: r["c"] for r in mine.where("party in ('D', 'R')").groupBy("party").agg(F.countDistinct("column").alias("c")).collect()}
    if per != {"D": 1, "R": 1}:
        raise InvalidTable(f"{contest} needs one D and one R column, has {per}")
    return mine.groupBy("unit").agg(F.sum(F.when(F.col("party") == "D", F.col("votes"))).alias("dem"), F.sum(F.when(F.col("party") == "R", F.col("votes"))).alias("rep"))


def load_membership(spark: SparkSession, path: str) -> DataFrame:
    """(unit, parent) from one JSON object; usual spellings of nothing become null."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("unit", "_p")).select("unit", subdivision_id(F.col("_p")).alias("parent"))


def require_coverage(assignments: DataFrame, values: DataFrame) -> None:
    """Units of the plans and of the table must be the same."""
    refuse(assignments.select("unit").distinct().join(values, "unit", "left_anti"), "unit", "units of plans that the table lacks")
    refuse(values.select("unit").join(assignments.select("unit").distinct(), "unit", "left_anti"), "unit", "units of the table that no plan has")


def write_plans(assignments: DataFrame, path: str) -> None:
    """CSV, a folder for each plan."""
    assignments.select("plan", F.col("unit").alias("GEOID"), "district").repartition("plan").sortWithinPartitions("plan", "GEOID").write.partitionBy("plan").csv(path, header=True, mode="overwrite")


def write_cases(assignments: DataFrame, path: str) -> DataFrame:
    """Plans as CSV under ``path``/plans, a folder for each, and their manifest (plan, units, digest) as JSON lines beside them, which is
    also returned. The digest is that of ``graph.plan_digest``: it depends on the plan alone, not on how files were cut."""
    write_plans(assignments, f"{path}/plans")
    sizes = assignments.groupBy("plan").agg(F.count("*").alias("units"))
    manifest = sizes.join(plan_digest(assignments), "plan")
    manifest.coalesce(1).write.json(f"{path}/manifest", mode="overwrite")
    return assignments.sparkSession.read.schema("plan long, units long, digest string").json(f"{path}/manifest")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(plan, unit, district) of ``write_cases``; plans that are not what the manifest says are refused."""
    rows = spark.read.schema("GEOID string, district int, plan long").csv(f"{path}/plans", header=True).select("plan", F.col("GEOID").alias("unit"), "district")
    manifest = spark.read.schema("plan long, units long, digest string").json(f"{path}/manifest")
    found = rows.groupBy("plan").agg(F.count("*").alias("_units")).join(plan_digest(rows).withColumnRenamed("digest", "_digest"), "plan")
    both = manifest.join(found, "plan", "full_outer").where("NOT (units <=> _units AND digest <=> _digest)")
    refuse(both, "plan", "plans that are not what the manifest says")
    return rows


def write_draws(draws: DataFrame, path: str) -> None:
    """Parquet by chain."""
    draws.repartition("chain").write.partitionBy("chain").parquet(path, mode="overwrite")


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """JSON lines, a folder for each frame."""
    for name, df in frames.items():
        df.write.json(f"{path}/{name}", mode="overwrite")


def verify(recomputed: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose numbers differ by more than a relative 1e-9, or that only one side has."""
    numbers = [c for c, t in recomputed.dtypes if c not in keys and t in ("double", "bigint", "int")]
    p = published.select(*keys, *[F.col(c).alias(f"_{c}") for c in numbers], F.lit(True).alias("_there"))
    both = recomputed.withColumn("_here", F.lit(True)).join(p, keys, "full_outer")
    apart = F.lit(False)
    for c in numbers:
        a, b = F.col(c).cast("double"), F.col(f"_{c}").cast("double")
        near = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
        apart = apart | ~F.coalesce(near, a.isNull() & b.isNull())
    return both.where(F.col("_here").isNull() | F.col("_there").isNull() | apart).drop("_here", "_there")


def require_same(a: DataFrame, b: DataFrame, column: str, what: str) -> None:
    """The two frames must hold the same values of ``column``."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    refuse(x.join(y, column, "left_anti").unionByName(y.join(x, column, "left_anti")), column, what)


def load_inputs(spark: SparkSession, units: str, adjacency: str, elections: str | None = None, plan: str | None = None, contest: str | None = None) -> dict[str, DataFrame]:
    """All tables of a state by name (units, adjacency, votes, plan), each read by its loader and held against the others.

    Refused: an adjacency that is not symmetric, has loops or other units than the table; votes or a plan of other units.
    """
    out = {"units": load_units(spark, units), "adjacency": load_adjacency(spark, adjacency)}
    arcs = out["adjacency"]
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    refuse(arcs.where("u = v"), "u", "units that are their own neighbours")
    refuse(arcs.join(back, ["u", "v"], "left_anti").select(F.concat_ws("-", "u", "v").alias("arc")), "arc", "neighbours on one side only")
    ends = arcs.select(F.col("u").alias("unit")).unionByName(arcs.select(F.col("v").alias("unit"))).distinct()
    refuse(ends.join(out["units"], "unit", "left_anti"), "unit", "neighbours that are no units")
    if elections is not None:
        votes = load_elections(spark, elections)
        named = sorted(r["contest"] for r in contests(votes).collect())
        if contest is None and len(named) != 1:
            raise InvalidTable(f"say which contest: {', '.join(named)}")
        out["votes"] = two_party(votes, contest or named[0])
        require_same(out["units"], out["votes"], "unit", "units and votes differ at units")
    if plan is not None:
        out["plan"] = load_plan(spark, plan)
        require_same(out["units"], out["plan"], "unit", "units and plan differ at units")
    return out


def read_checkpoint(spark: SparkSession, path: str, chain: int, seed: int) -> DataFrame:
    """The draws of one chain that ``write_draws`` left, if they carry this ``seed``; none where another run wrote them."""
    return spark.read.parquet(path).where((F.col("chain") == chain) & (F.col("seed") == seed))
