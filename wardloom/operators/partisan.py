"""Partisan measures of districting plans, for every plan of an ensemble at once.

Frames: ``assignments(plan, unit, district)`` and ``votes(unit, dem, rep)``. All measures start from
``districts(plan, district, dem, rep)``, made by one join and one aggregate. Undefined values are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..sources.tables import refuse
from .blocks import Blocks

PREDOMINANCE_BAND, MINORITY_DISTRICT_SHARE, DECLINATION_MIN_DISTRICTS = 0.05, 0.25, 8
SWINGS = [i / 100 for i in range(30, 71)]
METRICS = ("efficiency_gap", "mean_median", "declination", "partisan_bias")
TRUSTED_WHERE_ONE_PARTY_PREDOMINATES = ("efficiency_gap", "declination")


def district_votes(assignments: DataFrame, votes: DataFrame, strict: bool = False) -> DataFrame:
    """(plan, district, dem, rep): votes summed over the district's units.

    ``strict`` first refuses plans and votes whose units differ, each plan having to cover all units; else units that one side
    lacks are left out.
    """
    if strict:
        require_same_units(assignments.source if isinstance(assignments, Blocks) else assignments, votes)
    if isinstance(assignments, Blocks):
        return assignments.sums(votes, ["dem", "rep"]).drop("units")
    return assignments.join(votes.select("unit", "dem", "rep"), "unit").groupBy("plan", "district").agg(F.sum("dem").alias("dem"), F.sum("rep").alias("rep"))


def require_same_units(assignments: DataFrame, values: DataFrame) -> None:
    """Each plan must hold exactly the units of ``values``, each once."""
    n = values.select("unit").distinct().count()
    mine = assignments.join(values.select(F.col("unit").alias("_unit")).distinct(), F.col("unit") == F.col("_unit"), "left")
    # by unit first: units lie dealt to tasks, a count of distinct ones would move them by plan
    each = mine.groupBy("plan", "unit").agg(F.count("*").alias("rows"), F.count_if(F.col("_unit").isNull()).alias("unknown"))
    whole = each.groupBy("plan").agg(F.sum("rows").alias("rows"), F.count("unit").alias("units"), F.sum("unknown").alias("unknown"))
    refuse(whole.where((F.col("unknown") > 0) | (F.col("units") != n) | (F.col("rows") != F.col("units"))), "plan", "plans whose units are not those of the table")


def share() -> Column:
    return ratio(F.col("dem"), F.col("dem") + F.col("rep"))


def district_shares(districts: DataFrame) -> DataFrame:
    return districts.select("plan", "district", share().alias("share"))


def statewide_share(votes: DataFrame) -> DataFrame:
    return votes.agg(ratio(F.sum("dem"), F.sum(F.col("dem") + F.col("rep"))).alias("dem_share"))


def seat_counts(districts: DataFrame) -> DataFrame:
    """(plan, dem_seats, rep_seats, tied): a tie is nobody's seat."""
    return districts.groupBy("plan").agg(F.count_if(F.col("dem") > F.col("rep")).alias("dem_seats"), F.count_if(F.col("rep") > F.col("dem")).alias("rep_seats"), F.count_if(F.col("dem") == F.col("rep")).alias("tied"))


def seat_histogram(districts: DataFrame) -> DataFrame:
    return seat_counts(districts).groupBy(F.col("dem_seats").alias("seats")).agg(F.count("*").alias("plans"))


def median_seats(districts: DataFrame) -> DataFrame:
    return seat_counts(districts).agg(F.median("dem_seats").alias("median_seats"))


def wasted_votes(districts: DataFrame, threshold: str = "majority") -> DataFrame:
    """(plan, district, wasted_dem, wasted_rep): the winner wastes what exceeds the threshold (``majority``: half the
    votes rounded down, plus one; ``half``: half), the loser all; in a tie both waste all."""
    if threshold not in ("majority", "half"):
        raise ValueError(f"threshold must be majority or half, not {threshold!r}")
    total = F.col("dem") + F.col("rep")
    bar = (F.floor(total / 2) + 1).cast("double") if threshold == "majority" else total / F.lit(2.0)
    waste = lambda own, other: F.when(F.col(own) > F.col(other), F.col(own) - bar).otherwise(F.col(own).cast("double"))
    return districts.select("plan", "district", waste("dem", "rep").alias("wasted_dem"), waste("rep", "dem").alias("wasted_rep"), total.alias("total"))


def efficiency_gap(districts: DataFrame, threshold: str = "majority") -> DataFrame:
    """(plan, efficiency_gap): positive favours R."""
    return wasted_votes(districts, threshold).groupBy("plan").agg(ratio(F.sum("wasted_dem") - F.sum("wasted_rep"), F.sum("total")).alias("efficiency_gap"))


def _declination(n: Column, below: Column, above: Column, tied: Column, losing: Column, winning: Column) -> Column:
    theta = F.atan((1 - 2 * losing) * n / below)
    gamma = F.atan((2 * winning - 1) * n / above)
    return F.when((tied == 0) & (below > 0) & (above > 0), 2.0 * (gamma - theta) / math.pi)


def swung(target: float | Column, tie: str = "half") -> Column:
    """The seat that a district gives after a uniform swing; needs the columns share and observed."""
    moved = F.col("share") + (F.lit(target) - F.col("observed") if not isinstance(target, Column) else target - F.col("observed"))
    return F.when(moved > 0.5, 1.0).when((moved == 0.5) & F.lit(tie == "half"), 0.5).otherwise(0.0)


def _shares_observed(districts: DataFrame) -> DataFrame:
    """Shares beside the plan's own statewide share; the sums of a plan are joined back to its districts."""
    observed = districts.groupBy(F.col("plan").alias("_plan")).agg(ratio(F.sum("dem"), F.sum(F.col("dem") + F.col("rep"))).alias("observed"))
    return districts.join(observed, F.col("plan") == F.col("_plan")).select("plan", "district", "dem", "rep", share().alias("share"), "observed")


def partisan_bias(districts: DataFrame, at: float = 0.5) -> DataFrame:
    """(plan, partisan_bias): (S(at) - (1 - S(1 - at))) / 2; positive favours D."""
    if not 0 <= at <= 1:
        raise ValueError(f"at must lie in [0, 1], not {at!r}")
    bias = (F.avg(swung(at)) - (1.0 - F.avg(swung(1.0 - at)))) / 2.0
    return _shares_observed(districts).groupBy("plan").agg(bias.alias("partisan_bias"))


def seats_votes_curve(districts: DataFrame, swings: list[float] | None = None, tie: str = "half") -> DataFrame:
    """(plan, target, seat_share) over uniform swings to each target share."""
    if tie not in ("half", "neither"):
        raise ValueError(f"tie must be half or neither, not {tie!r}")
    at = F.explode(F.array(*[F.lit(float(s)) for s in (SWINGS if swings is None else swings)]))
    return _shares_observed(districts).withColumn("target", at).groupBy("plan", "target").agg(F.avg(swung(F.col("target"), tie)).alias("seat_share"))


def all_metrics(districts: DataFrame) -> DataFrame:
    """One row a plan with every partisan measure side by side; no combined score."""
    d = _shares_observed(districts)
    total = F.col("dem") + F.col("rep")
    bar = F.floor(total / 2) + 1
    waste = lambda own, other: F.when(F.col(own) > F.col(other), F.col(own) - bar).otherwise(F.col(own))
    s = F.col("share")
    n, below, above, tied = F.count("*"), F.count_if(s < 0.5), F.count_if(s > 0.5), F.count_if(s == 0.5)
    return d.groupBy("plan").agg(
        n.alias("n_districts"),
        F.count_if(F.col("dem") > F.col("rep")).alias("dem_seats"),
        F.count_if(F.col("rep") > F.col("dem")).alias("rep_seats"),
        F.count_if(F.col("dem") == F.col("rep")).alias("tied_districts"),
        ratio(F.count_if(F.col("dem") > F.col("rep")), n).alias("dem_seat_share"),
        ratio(F.sum("dem"), F.sum(total)).alias("dem_vote_share"),
        ratio(F.sum(waste("dem", "rep") - waste("rep", "dem")), F.sum(total)).alias("efficiency_gap"),
        (F.avg(s) - F.median(s)).alias("mean_median"),
        _declination(n, below, above, tied, F.avg(F.when(s < 0.5, s)), F.avg(F.when(s > 0.5, s))).alias("declination"),
        ((F.avg(swung(0.5)) - (1.0 - F.avg(swung(0.5)))) / 2.0).alias("partisan_bias"),
        F.median(s).alias("median_share"),
        below.alias("below"),
        above.alias("above"),
        F.count_if(s.between(0.45, 0.55)).alias("competitive"),
    )


def mean_median(districts: DataFrame) -> DataFrame:
    return all_metrics(districts).select("plan", "mean_median")


def declination(districts: DataFrame) -> DataFrame:
    """(plan, declination): null on a tie or a sweep."""
    return all_metrics(districts).select("plan", "declination")


def predominance(metrics: DataFrame, band: float = PREDOMINANCE_BAND, minority_share: float = MINORITY_DISTRICT_SHARE) -> DataFrame:
    """Adds the three arms of one-party predominance to ``all_metrics``: margin, sweep, median; and any of them."""
    major = F.greatest("below", "above")
    minor = F.col("n_districts") - major
    out = metrics.withColumns({
        "arm_margin": F.abs(F.col("dem_vote_share") - 0.5) > band,
        "arm_sweep": (major > minor) & (minor <= minority_share * F.col("n_districts")),
        "arm_median": F.abs(F.col("median_share") - 0.5) > band,
    })
    return out.withColumn("predominates", F.col("arm_margin") | F.col("arm_sweep") | F.col("arm_median"))


def trusted_metrics(metrics: DataFrame, min_districts: int = DECLINATION_MIN_DISTRICTS) -> DataFrame:
    """(plan, trusted): names of the measures that remain usable, in a fixed order."""
    p = predominance(metrics)
    usable = {
        "efficiency_gap": F.lit(True),
        "mean_median": ~F.col("predominates"),
        "declination": F.col("declination").isNotNull() & (F.col("n_districts") >= min_districts),
        "partisan_bias": ~F.col("predominates"),
    }
    return p.select("plan", F.array_compact(F.array(*[F.when(usable[m], F.lit(m)) for m in METRICS])).alias("trusted"))


def caveats(metrics: DataFrame, min_districts: int = DECLINATION_MIN_DISTRICTS) -> DataFrame:
    """(plan, caveats): sentences on which numbers to distrust; the last names those that survive."""
    p = predominance(metrics).join(trusted_metrics(metrics, min_districts).withColumnRenamed("plan", "_p"), F.col("plan") == F.col("_p"))
    n = F.col("n_districts")
    arms = F.concat_ws("; ", *[F.when(F.col(f"arm_{a}"), F.lit(t)) for a, t in (("margin", "statewide margin"), ("sweep", "district sweep"), ("median", "median district"))])
    notes = [
        F.when(F.col("predominates"), F.concat(F.lit("One party predominates ("), arms, F.lit("): only efficiency gap and declination are to be trusted."))),
        F.when((F.col("dem_seats") == n) | (F.col("rep_seats") == n), F.format_string("One party wins all %d seats: declination is undefined.", n)),
        F.when(F.col("tied_districts") > 0, F.format_string("%d districts are exactly tied: seats for neither party.", F.col("tied_districts"))),
        F.when(n < min_districts, F.format_string("Only %d districts: declination is too coarse and bias moves in steps of %s.", n, F.round(1 / n, 4).cast("string"))),
    ]
    survivors = F.concat(F.lit("Usable here: "), F.concat_ws(", ", "trusted"), F.lit("."))
    some = F.array_compact(F.array(*notes))
    return p.select("plan", F.when(F.size(some) > 0, F.concat(some, F.array(survivors))).otherwise(some).alias("caveats"))


def vote_concentration(districts: DataFrame, party: str = "dem") -> DataFrame:
    """(plan, concentration): Herfindahl index of a party's votes over districts."""
    v = F.col(party).cast("double")
    return districts.groupBy("plan").agg((F.sum(v * v) / F.pow(F.sum(v), 2)).alias("concentration"))


def competitive(districts: DataFrame, low: float = 0.45, high: float = 0.55) -> DataFrame:
    return districts.groupBy("plan").agg(F.count_if(share().between(low, high)).alias("competitive"))
