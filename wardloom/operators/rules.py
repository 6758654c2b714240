"""Explicit decision rules over locations, and how well they separate labelled scenarios.

``locations(case_id, kind, shift, metric, status, percentile, n, distinct, ess, max_interior, min_interior[, trusted])``; kind is planted or
null, shift the intended seat shift. Decisions have three values: null where the reference can't express the rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, wilson
from .ordering import numbered


@dataclass(frozen=True)
class Rule:
    """threshold in (0, 1); tail: upper, lower or two_sided; combination: any, all or k_of_n (with k)."""

    threshold: float = 0.95
    tail: str = "two_sided"
    combination: str = "any"
    k: int = 1
    metrics: tuple[str, ...] = ()
    untrusted: str = "exclude"
    min_n: int = 20
    require_expressible: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.threshold < 1:
            raise ValueError(f"threshold must lie in (0, 1), not {self.threshold!r}")
        if self.tail not in ("upper", "lower", "two_sided") or self.combination not in ("any", "all", "k_of_n", "none"):
            raise ValueError("unknown tail or combination")
        if self.combination == "k_of_n" and self.k < 1:
            raise ValueError("k must be 1 or more")

    @property
    def required_n(self) -> int:
        """Draws that the threshold needs: half a tie of one draw must lie beyond it."""
        return max(1, math.ceil(0.5 / (1 - self.threshold)))

    def nominal_fpr(self, n_metrics: int) -> float:
        p = (1 - self.threshold) * (2 if self.tail == "two_sided" else 1)
        return 1 - (1 - min(1.0, p)) ** n_metrics

    def describe(self) -> str:
        return f"{self.combination} of the metrics beyond {self.threshold:g} ({self.tail})"


def screen(locations: DataFrame, rule: Rule) -> DataFrame:
    """Adds screen: eligible, excluded or unresolvable, with the reason."""
    high, low = F.col("max_interior") >= rule.threshold, F.col("min_interior") <= 1 - rule.threshold
    reach = {"upper": high, "lower": low, "two_sided": high & low}[rule.tail]
    reason = F.when(F.col("status") != "located", F.col("status")).when(F.col("n") < rule.min_n, F.lit("min_n"))
    if rule.metrics:
        reason = F.when(~F.col("metric").isin(*rule.metrics), F.lit("not in the rule")).otherwise(reason)
    if "trusted" in locations.columns and rule.untrusted == "exclude":
        reason = F.coalesce(reason, F.when(~F.col("trusted"), F.lit("untrusted")))
    cannot = F.lit(None).cast("string")
    if rule.require_expressible:
        cannot = F.when(~F.coalesce(reach, F.lit(False)), F.lit("not expressible"))
    cannot = F.coalesce(cannot, F.when(F.col("distinct") < rule.required_n, F.lit("too few distinct")), F.when(F.col("ess") < rule.required_n, F.lit("effective size")))
    return locations.withColumns({"reason": F.coalesce(reason, cannot), "screen": F.when(reason.isNotNull(), "excluded").when(cannot.isNotNull(), "unresolvable").otherwise("eligible")})


def statistic(rule: Rule) -> Column:
    p = F.col("percentile")
    return {"upper": p, "lower": 1 - p, "two_sided": F.greatest(p, 1 - p)}[rule.tail]


def fire(screened: DataFrame, rule: Rule) -> DataFrame:
    """Adds fired (eligible metrics only) and the side."""
    fired = F.when(F.col("screen") == "eligible", statistic(rule) >= rule.threshold)
    return screened.withColumns({"fired": fired, "side": F.when(fired, F.when(F.col("percentile") >= 0.5, "high").otherwise("low"))})


def flag(locations: DataFrame, rule: Rule) -> DataFrame:
    """(case_id, kind, shift, eligible, fired, flagged, outlierness): flagged is null when no metric is eligible."""
    f = fire(screen(locations, rule), rule)
    eligible, hits = F.count_if(F.col("screen") == "eligible"), F.count_if(F.col("fired"))
    test = {"any": hits >= 1, "all": hits == eligible, "k_of_n": hits >= rule.k, "none": F.lit(False)}[rule.combination]
    return f.groupBy("case_id", "kind", "shift").agg(eligible.alias("eligible"), hits.alias("fired"), F.when(eligible > 0, test).alias("flagged"), F.max(F.when(F.col("screen") == "eligible", statistic(rule))).alias("outlierness"))


def confusion(decisions: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, unresolved of each kind, rates with Wilson intervals and worst bounds, Youden's J."""
    planted, null = F.col("kind") == "planted", F.col("kind") == "null"
    yes, no, open_ = F.col("flagged"), ~F.col("flagged"), F.col("flagged").isNull()
    c = decisions.agg(
        F.count_if(planted & yes).alias("tp"), F.count_if(null & yes).alias("fp"), F.count_if(null & no).alias("tn"), F.count_if(planted & no).alias("fn"),
        F.count_if(planted & open_).alias("unresolved_planted"), F.count_if(null & open_).alias("unresolved_null"),
    )
    tp, fp, tn, fn, up, un = (F.col(x) for x in ("tp", "fp", "tn", "fn", "unresolved_planted", "unresolved_null"))
    tpr, fpr = ratio(tp, tp + fn), ratio(fp, fp + tn)
    w = {"tpr_low": wilson(tp, tp + fn)["low"], "tpr_high": wilson(tp, tp + fn)["high"], "fpr_low": wilson(fp, fp + tn)["low"], "fpr_high": wilson(fp, fp + tn)["high"]}
    return c.withColumns({"tpr": tpr, "fpr": fpr, **w, "tpr_worst": ratio(tp, tp + fn + up), "fpr_worst": ratio(fp + un, fp + tn + un), "youden": tpr - fpr})


def detection_curve(decisions: DataFrame) -> DataFrame:
    """(magnitude, n, flagged, unresolved, tpr, tpr_worst) over planted cases by absolute shift."""
    c = decisions.where("kind = 'planted'").groupBy(F.abs("shift").alias("magnitude")).agg(F.count("*").alias("n"), F.count_if(F.col("flagged")).alias("flagged"), F.count_if(F.col("flagged").isNull()).alias("unresolved"))
    return c.withColumns({"tpr": ratio(F.col("flagged"), F.col("n") - F.col("unresolved")), "tpr_worst": ratio(F.col("flagged"), F.col("n"))})


def auc(decisions: DataFrame) -> DataFrame:
    """(auc, n_planted, n_null): chance that a planted case stands out more than a null one, ties half.

    Cases are ordered in ranges; equal ones share the mean of their places.
    """
    known = numbered(decisions.where("outlierness is not null and kind in ('planted', 'null')").select("kind", "outlierness"), "_place", F.col("outlierness"))
    planted, null = F.count_if(F.col("kind") == "planted"), F.count_if(F.col("kind") == "null")
    tied = known.groupBy("outlierness").agg(F.avg("_place").alias("rank"), planted.alias("p"), null.alias("z"))
    n1, n0 = F.sum("p"), F.sum("z")
    return tied.agg(ratio(F.sum(F.col("rank") * F.col("p")) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), F.coalesce(n1, F.lit(0)).alias("n_planted"), F.coalesce(n0, F.lit(0)).alias("n_null"))


def auc_with_decision(area: DataFrame, confused: DataFrame) -> DataFrame:
    """``auc`` with decision_auc, the area under the curve through the rule's one operating point: (1 + tpr - fpr) / 2. It is a half
    for detectors that always or never flag, whatever their statistic could do; null where a rate is."""
    return area.join(F.broadcast(confused.select("youden")), F.lit(True)).select("auc", ((1 + F.col("youden")) / 2).alias("decision_auc"), "n_planted", "n_null")


def baselines(decisions: DataFrame) -> DataFrame:
    """The same counts for detectors that always or never flag."""
    both = decisions.select("kind", F.explode(F.array(F.lit("always"), F.lit("never"))).alias("detector"))
    hit = F.col("detector") == "always"
    c = both.groupBy("detector").agg(F.count_if(hit & (F.col("kind") == "planted")).alias("tp"), F.count_if(hit & (F.col("kind") == "null")).alias("fp"), F.count_if(~hit & (F.col("kind") == "null")).alias("tn"), F.count_if(~hit & (F.col("kind") == "planted")).alias("fn"))
    return c.withColumn("youden", ratio(F.col("tp"), F.col("tp") + F.col("fn")) - ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def min_detectable_shift(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """(shift): the smallest magnitude whose worst-case rate reaches the target, as do all larger ones."""
    onward = Window.orderBy(F.desc("magnitude")).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("least", F.min("tpr_worst").over(onward)).agg(F.min(F.when(F.col("least") >= target, F.col("magnitude"))).alias("shift"))


def gates(confused: DataFrame, tpr_gate: float = 0.95, fpr_gate: float = 0.05) -> DataFrame:
    """Adds tpr_pass and fpr_pass, which read the worst bounds."""
    return confused.select("tpr_worst", "fpr_worst", (F.col("tpr_worst") >= tpr_gate).alias("tpr_pass"), (F.col("fpr_worst") <= fpr_gate).alias("fpr_pass"))


def gates_with_shift(confused: DataFrame, shift: DataFrame, most: int = 1, **bars: float) -> DataFrame:
    """``gates`` with shift and shift_pass: whether shifts of ``most`` seats or fewer are found, from ``min_detectable_shift``; a shift that
    is never found fails."""
    out = gates(confused, **bars).join(F.broadcast(shift.select("shift")), F.lit(True))
    return out.withColumn("shift_pass", F.coalesce(F.col("shift") <= most, F.lit(False)))


def alternatives(locations: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, tp, fp, tn, fn, unresolved, youden): every rule, by name, scored on the same cases."""
    out = None
    for name, rule in rules.items():
        c = confusion(flag(locations, rule))
        one = c.select(F.lit(name).alias("rule"), "tp", "fp", "tn", "fn", (F.col("unresolved_planted") + F.col("unresolved_null")).alias("unresolved"), "youden")
        out = one if out is None else out.unionByName(one)
    return out


def rate_at(curve: DataFrame, magnitude: int) -> DataFrame:
    """(tpr) of ``curve(magnitude, tpr)`` at one magnitude; no row where the curve lacks it."""
    return curve.where(F.col("magnitude") == magnitude).select("tpr")
