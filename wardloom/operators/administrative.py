"""How plans cut through subdivisions: splits, pieces and ballot styles.

Frames: ``assignments(plan, unit, district)``, ``membership(unit, parent)`` with null parents allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .components import settle
from .graph import beside, by_unit


def pieces(assignments: DataFrame, membership: DataFrame) -> DataFrame:
    """(plan, parent, districts): distinct districts in each parent; units without parent are left out."""
    known = membership.where(F.col("parent").isNotNull()).select("unit", "parent")
    return assignments.join(known, "unit").groupBy("plan", "parent").agg(F.countDistinct("district").alias("districts"))


def split_metrics(assignments: DataFrame, membership: DataFrame) -> DataFrame:
    """(plan, county_splits, split_pieces, excess_pieces)."""
    return _splits(pieces(assignments, membership))


def _splits(found: DataFrame) -> DataFrame:
    return found.groupBy("plan").agg(F.count_if(F.col("districts") > 1).alias("county_splits"), F.sum("districts").alias("split_pieces"), F.sum(F.col("districts") - 1).alias("excess_pieces"))


def pieces_by_subdivision(assignments: DataFrame, membership: DataFrame) -> DataFrame:
    """(plan, parent, district): which districts reach into which parent."""
    known = membership.where(F.col("parent").isNotNull()).select("unit", "parent")
    return assignments.join(known, "unit").select("plan", "parent", "district").distinct()


def select_layer(layers: dict[str, DataFrame], layer: str | None = None) -> tuple[str, DataFrame]:
    """The one layer that a measure of splits is about, with its name: the only one, or the one asked for.

    Several layers without a choice are refused rather than guessed at; a name that no layer has is refused as well.
    """
    if layer is None and len(layers) == 1:
        return next(iter(layers.items()))
    if layer is None:
        raise ValueError(f"say which of the layers is meant: {', '.join(sorted(layers))}")
    if layer not in layers:
        raise KeyError(f"no layer is named {layer!r}; there are: {', '.join(sorted(layers))}")
    return layer, layers[layer]


def same_units(layers: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``layers`` of (plan, unit, district), if all have the same units; else the first few that one has and another lacks are named."""
    (name, first), *rest = layers.items()
    for other, layer in rest:
        mine, theirs = (df.select("unit").distinct() for df in (first, layer))
        apart = mine.join(theirs, "unit", "left_anti").unionByName(theirs.join(mine, "unit", "left_anti")).orderBy("unit").limit(8).collect()
        if apart:
            raise ValueError(f"layers {name} and {other} differ at units {', '.join(str(r['unit']) for r in apart)}")
    return layers


def ballot_styles(layers: list[DataFrame], membership: DataFrame | None = None) -> DataFrame:
    """(plan, ballot_styles): distinct combinations of districts over the layers, and of parents if given.

    Layers hold (plan, unit, district). With parents, a unit without one makes the count null. Layers meet by unit, in arrays over
    a block of plans.
    """
    out = layers[0].select("plan", "unit", F.col("district").alias("d0"))
    for i, layer in enumerate(layers[1:], 1):
        own = [f"d{j}" for j in range(i)]
        a = by_unit(out.select("plan", "unit", F.struct(*own).alias("district"))).withColumnRenamed("rows", "a")
        b = by_unit(layer).select(F.col("unit").alias("_unit"), F.col("block").alias("_block"), F.col("rows").alias("b"))
        # blocks are compared beside the key, so that layers dealt by unit stay where they lie
        met = a.join(b, (F.col("unit") == F.col("_unit")) & (F.col("block") <= F.col("_block")) & (F.col("block") >= F.col("_block"))).select("unit", F.explode(beside("a", "b")).alias("_r"))
        out = met.select(F.col("_r.a.plan").alias("plan"), "unit", *[F.col(f"_r.a.district.{c}").alias(c) for c in own], F.col("_r.b.district").alias(f"d{i}"))
    keys = [f"d{i}" for i in range(len(layers))]
    if membership is None:
        return out.groupBy("plan").agg(F.countDistinct(*keys).alias("ballot_styles"))
    out = out.join(membership.select("unit", "parent"), "unit", "left")
    styles = F.countDistinct("parent", *keys)
    return out.groupBy("plan").agg(F.when(F.count_if(F.col("parent").isNull()) == 0, styles).alias("ballot_styles"))


def ballot_styles_per_10k(styles: DataFrame, voters: DataFrame) -> DataFrame:
    """(plan, per_10k): styles for each 10,000 of ``voters(unit, voters)``; null without voters."""
    total = voters.agg(F.sum("voters").alias("_voters"))
    return styles.crossJoin(F.broadcast(total)).select("plan", ratio(10000 * F.col("ballot_styles"), F.col("_voters")).alias("per_10k"))


def degeneracy(membership: DataFrame, layers: int = 1) -> DataFrame:
    """(metric, reason): which measures are constant or can't be computed with this membership."""
    sizes = membership.groupBy("parent").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.max(F.when(F.col("parent").isNotNull(), F.col("n"))).alias("most"), F.sum(F.when(F.col("parent").isNull(), F.col("n")).otherwise(0)).alias("bare"), F.count("parent").alias("parents"))
    rules = [
        ("county_splits", F.when(F.col("parents") == 0, "no coverage").when(F.col("most") <= 1, "each parent is one unit")),
        ("split_pieces", F.when(F.col("parents") == 0, "no coverage").when(F.col("most") <= 1, "each parent is one unit")),
        ("ballot_styles", F.when(F.lit(layers) <= 1, "one layer: styles equal districts")),
        ("ballot_styles_by_parent", F.when(F.col("bare") > 0, "some units have no parent")),
    ]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), r.alias("reason")) for m, r in rules])).alias("r")).select("r.metric", "r.reason").where("reason is not null")


# The administrative measures in the order of reports.
REPORTED = ("county_splits", "split_pieces", "excess_pieces", "ballot_styles", "ballot_styles_by_subdivision", "ballot_styles_per_10k", "n_units", "n_units_in_no_subdivision", "n_subdivisions", "n_districts", "n_layers")


def degeneracy_report(membership: DataFrame, layers: int = 1, districts: int | None = None) -> DataFrame:
    """(metric, constant, computable, value, reason) for each measure of :data:`REPORTED`.

    ``constant``: no plan over these units can move it, and ``value`` is what it then is, where that is known. ``reason`` is null
    exactly where a measure is computable and free to vary. ``districts``: how many a plan has, where all have as many.
    """
    sizes = membership.groupBy("parent").agg(F.count("*").alias("n"))
    here = F.col("parent").isNotNull()
    facts = sizes.agg(
        F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias("most"), F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("bare"), F.count("parent").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"),
    )
    whole = F.col("most") <= 1
    split = F.when(F.col("parents") == 0, "no unit belongs to a subdivision").when(whole, "each subdivision is one unit")
    partial = F.when(F.col("bare") > 0, "some units have no subdivision")
    single = F.lit("one layer: styles equal districts" if layers == 1 else None)
    given = F.lit("a property of the input")
    yes, no, one, nothing = F.lit(True), F.lit(False), F.lit(layers == 1), F.lit(None).cast("long")
    count = lambda x: F.lit(x).cast("long")
    rules = {
        "county_splits": (whole, yes, F.when(whole, count(0)), split),
        "split_pieces": (whole, yes, F.when(whole, F.col("covered")), split),
        "excess_pieces": (whole, yes, F.when(whole, count(0)), split),
        "ballot_styles": (one, yes, count(districts) if layers == 1 else nothing, single),
        "ballot_styles_by_subdivision": (whole, F.col("bare") == 0, F.when(whole, F.col("covered")), F.nullif(F.concat_ws("; ", split, partial), F.lit(""))),
        "ballot_styles_per_10k": (one, yes, nothing, single),
        "n_units": (yes, yes, F.col("units"), given),
        "n_units_in_no_subdivision": (yes, yes, F.col("bare"), given),
        "n_subdivisions": (yes, yes, F.col("parents"), given),
        "n_districts": (no, yes, nothing, F.lit(None)),
        "n_layers": (yes, yes, count(layers), given),
    }
    rows = [F.struct(F.lit(m).alias("metric"), c.alias("constant"), k.alias("computable"), v.cast("long").alias("value"), r.cast("string").alias("reason")) for m, (c, k, v, r) in rules.items()]
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def admin_report(assignments: DataFrame, membership: DataFrame, voters: DataFrame | None = None) -> DataFrame:
    """A row a plan with all measures of :data:`REPORTED` over one layer. Styles by subdivision are null where a unit has no
    subdivision; the rate is null without ``voters(unit, voters)``, and a zero electorate is refused."""
    rows = assignments.join(membership.select("unit", "parent"), "unit", "left")
    cells = settle(rows.select("plan", "parent", "district").distinct())  # all that the measures need, but for the units
    by = F.when(F.count_if(F.col("parent").isNull()) == 0, F.countDistinct("parent", "district"))
    styles = cells.groupBy("plan").agg(F.countDistinct("district").alias("ballot_styles"), by.alias("ballot_styles_by_subdivision")).withColumn("n_districts", F.col("ballot_styles"))
    # distinct rows first: units lie dealt to tasks, a count of distinct ones would move them by plan
    sizes = assignments.select("plan", "unit").distinct().groupBy("plan").agg(F.count("unit").alias("n_units"))
    facts = membership.agg(F.count_if(F.col("parent").isNull()).alias("n_units_in_no_subdivision"), F.countDistinct("parent").alias("n_subdivisions"))
    total = None if voters is None else voters.agg(F.sum("voters")).first()[0]
    if voters is not None and not total:
        raise ValueError("no voters: a rate for each 10,000 is not defined")
    rate = F.lit(None).cast("double") if total is None else ratio(10000 * F.col("ballot_styles"), F.lit(total))
    out = sizes.join(_splits(cells.where("parent IS NOT NULL").groupBy("plan", "parent").agg(F.countDistinct("district").alias("districts"))), "plan", "left").join(styles.withColumn("ballot_styles_per_10k", rate), "plan").join(F.broadcast(facts), F.lit(True))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("county_splits", "split_pieces", "excess_pieces")}
    return out.withColumns(none).withColumn("n_layers", F.lit(1)).select("plan", *REPORTED)
