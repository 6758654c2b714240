"""Does one criterion cost another? Three tests for every ordered pair of criteria, and what they say together.

``rows(chain, draw, *criteria)`` hold how good each draw is by each criterion, larger being better. All pairs and all replicates are
worked on together. Replicates are keyed by a hash of the seed, so they are the same wherever they run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .components import settle
from .experiments import verdict
from .ordering import numbered

# The upper end of rho's interval, the effect in robust deviations, the level of p, and the share of the
# independent rate below which a test speaks of a tradeoff; the best share that conditions, and the share that is good.
RHO, EFFECT, ALPHA, SUPPRESSION, DECILE, TERCILE = -0.10, -0.20, 0.05, 0.5, 0.10, 1 / 3
TESTS = ("correlation", "conditional", "achievability")
SYMMETRIC = ("correlation", "achievability")
#: Chains whose numbers the driver holds at once.
MOST_CHAINS = 10_000


def hashed(*parts: Column) -> Column:
    """A number below 2^32 from sha256 of the parts, joined by bars."""
    return F.conv(F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(8)), 16, 10).cast("long")


class Pairs:
    """The tests of all ordered pairs over the draws of one ensemble."""

    def __init__(self, rows: DataFrame, criteria: tuple[str, ...], reps: int = 1000, seed: int = 7) -> None:
        self.criteria, self.reps, self.seed = criteria, reps, seed
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in criteria])
        self.base = settle(rows.where(known).select("chain", "draw", *[F.col(c).cast("double").alias(c) for c in criteria]))
        self.spark, self.n = self.base.sparkSession, self.base.count()
        chains = self.base.select("chain").distinct().orderBy("chain").limit(MOST_CHAINS + 1).collect()
        if len(chains) > MOST_CHAINS:
            raise ValueError(f"more than {MOST_CHAINS} chains")
        self.chains = len(chains)
        self.numbers = self.spark.createDataFrame([(r["chain"], i) for i, r in enumerate(chains)], f"chain {self.base.schema['chain'].dataType.simpleString()}, k int")
        self.ordered = [(a, b) for a in criteria for b in criteria if a != b]
        self.seeded = F.lit(str(seed))

    def facts(self) -> DataFrame:
        """(criterion, varies, middle, sd, boundary, tercile, worst): what a criterion says by itself. ``boundary`` is its value at
        the end of the best tenth, ``worst`` the median of its lowest tenth."""
        top = max(1, round(DECILE * self.n))
        long = self.base.unpivot(["chain", "draw"], list(self.criteria), "criterion", "good")
        placed = settle(numbered(long, "_place", F.col("criterion"), F.col("good")))
        first = {c: i * self.n for i, c in enumerate(sorted(self.criteria))}
        start = F.create_map(*[x for c, s in first.items() for x in (F.lit(c), F.lit(s))])[F.col("criterion")]
        place = F.col("_place") - start
        out = placed.groupBy("criterion").agg((F.min("good") < F.max("good")).alias("varies"), F.median("good").alias("middle"), F.stddev_pop("good").alias("pop_sd"), F.percentile("good", F.lit(1 - TERCILE)).alias("tercile"), F.max(F.when(place == self.n - top + 1, F.col("good"))).alias("boundary"), F.median(F.when(place <= top, F.col("good"))).alias("worst"))
        away = placed.join(F.broadcast(out.select(F.col("criterion").alias("_c"), "middle")), F.col("criterion") == F.col("_c")).groupBy(F.col("criterion").alias("_c")).agg(F.median(F.abs(F.col("good") - F.col("middle"))).alias("mad"))
        return out.join(away, F.col("criterion") == F.col("_c")).select("criterion", "varies", "middle", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("pop_sd")).alias("sd"), "boundary", "tercile", "worst")

    def rank_parts(self) -> DataFrame:
        """(chain, draw, k, *criteria): for each row and criterion an array over chains: how many draws of that chain are worse, equal
        ones counting half. A rank among any choice of chains is the sum over the chosen ones, plus a half."""
        long = self.base.unpivot(["chain", "draw"], list(self.criteria), "criterion", "good").join(F.broadcast(self.numbers), "chain")
        counts = long.groupBy("criterion", "good", "k").agg(F.count("*").alias("c"))
        grid = counts.select("criterion", "good").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(self.chains - 1))).alias("k"))
        full = grid.join(counts, ["criterion", "good", "k"], "left").select("criterion", "good", "k", F.coalesce("c", F.lit(0)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("criterion", "k").orderBy("good"))
        held = full.select("criterion", "good", "k", (upto - F.col("c") / 2).alias("h")).groupBy("criterion", "good").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]).alias("h"))
        rows = long.join(held, ["criterion", "good"])
        return rows.groupBy("chain", "draw", "k").agg(*[F.max(F.when(F.col("criterion") == c, F.col("h"))).alias(c) for c in self.criteria])

    def correlations(self) -> DataFrame:
        """(a, b, rho, low, high, replicates): Spearman's rho, and the ends of its 95 % interval from whole chains drawn with
        replacement. Replicates in which a side is constant say nothing; replicate -1 is the ensemble itself."""
        picks = self.spark.range(self.reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(self.chains - 1))).alias("j")).select("rep", (hashed(self.seeded, F.col("rep"), F.col("j")) % self.chains).alias("k"))
        per = picks.groupBy("rep", "k").agg(F.count("*").alias("t"))
        whole = self.numbers.select(F.lit(-1).cast("long").alias("rep"), F.col("k").cast("long").alias("k"), F.lit(1).cast("long").alias("t"))
        times = per.unionByName(whole).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("m"))
        times = times.select("rep", F.transform(F.sequence(F.lit(0), F.lit(self.chains - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0).cast("long"))).alias("times"))
        met = settle(self.rank_parts()).join(F.broadcast(times) if self.reps * self.chains <= 1_000_000 else times, F.get("times", F.col("k")) > 0)
        rank = lambda c: F.aggregate(F.zip_with(c, "times", lambda h, t: h * t), F.lit(0.5), lambda x, y: x + y)
        ranked = met.select("rep", F.get("times", F.col("k")).alias("t"), *[rank(c).alias(c) for c in self.criteria])
        pairs = [(a, b) for i, a in enumerate(self.criteria) for b in self.criteria[i:]]
        sums = ranked.groupBy("rep").agg(F.sum("t").alias("n"), *[F.sum(F.col("t") * F.col(c)).alias(f"s_{c}") for c in self.criteria], *[F.sum(F.col("t") * F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs])
        square = lambda a, b: F.col("n") * F.col(f"q_{a}_{b}" if (a, b) in pairs else f"q_{b}_{a}") - F.col(f"s_{a}") * F.col(f"s_{b}")
        rho = lambda a, b: F.when((square(a, a) > 0) & (square(b, b) > 0), square(a, b) / F.sqrt(square(a, a)) / F.sqrt(square(b, b)))
        each = sums.select("rep", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(a, b).alias("rho")) for a, b in self.ordered])).alias("p")).select("rep", "p.*")
        got = each.groupBy("a", "b").agg(F.max(F.when(F.col("rep") < 0, F.col("rho"))).alias("rho"), F.array_sort(F.collect_list(F.when(F.col("rep") >= 0, F.col("rho")))).alias("all"))
        size = F.size("all")
        return got.select("a", "b", "rho", F.get("all", F.floor(0.025 * size).cast("int")).alias("low"), F.get("all", F.least(size - 1, F.floor(0.975 * size).cast("int"))).alias("high"), size.alias("replicates"))

    def conditionals(self, facts: DataFrame) -> DataFrame:
        """(a, b, effect, p): how far the median of b falls in the best tenth of a (ties at its end included), in b's robust
        deviations, and how often it falls as far when a is turned round within each chain."""
        bounds = facts.groupBy().agg(*[F.max(F.when(F.col("criterion") == c, F.col("boundary"))).alias(f"cut_{c}") for c in self.criteria])
        placed = settle(numbered(self.base, "_place", F.col("chain"), F.col("draw")))
        chains = placed.groupBy("chain").agg(F.min("_place").alias("_first"), F.count("*").alias("_len"))
        held = placed.join(chains, "chain").withColumn("i", F.col("_place") - F.col("_first"))
        each = F.filter(F.array(*[F.when(F.col(c) >= F.col(f"cut_{c}"), F.lit(c)) for c in self.criteria]), lambda x: x.isNotNull())
        best = held.join(F.broadcast(bounds), F.lit(True)).select("chain", "i", F.explode(each).alias("a"))
        turn = hashed(self.seeded, F.lit("turn"), F.col("rep"), F.col("chain")) % F.col("_len")
        turns = chains.select("chain", "_len", F.explode(F.sequence(F.lit(-1), F.lit(self.reps - 1))).alias("rep")).select("chain", "_len", "rep", F.when(F.col("rep") < 0, 0).otherwise(turn).alias("_turn"))
        moved = best.join(turns, "chain").select("rep", "a", "chain", F.pmod(F.col("i") - F.col("_turn"), F.col("_len")).alias("i"))
        medians = moved.join(held.select("chain", "i", *self.criteria), ["chain", "i"]).groupBy("rep", "a").agg(*[F.median(c).alias(c) for c in self.criteria])
        long = medians.unpivot(["rep", "a"], list(self.criteria), "b", "top").where("a <> b")
        own = long.where("rep < 0").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("top").alias("own"))
        tested = long.where("rep >= 0").join(F.broadcast(own), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).groupBy("a", "b").agg(F.first("own").alias("own"), F.count_if(F.col("top") <= F.col("own")).alias("worse"), F.count("*").alias("all"))
        scale = facts.select(F.col("criterion").alias("_c"), "middle", "sd")
        return tested.join(F.broadcast(scale), F.col("b") == F.col("_c")).select("a", "b", ratio(F.col("own") - F.col("middle"), F.col("sd")).alias("effect"), ((F.col("worse") + 1) / (F.col("all") + 1)).alias("p"))

    def joint_rates(self, facts: DataFrame) -> DataFrame:
        """(a, b, joint, expected): how often both are in their best third, and how often if they had nothing to do with each other."""
        cuts = facts.groupBy().agg(*[F.max(F.when(F.col("criterion") == c, F.col("tercile"))).alias(f"cut_{c}") for c in self.criteria])
        good = self.base.join(F.broadcast(cuts), F.lit(True)).select(*[(F.col(c) >= F.col(f"cut_{c}")).alias(c) for c in self.criteria])
        sums = good.agg(F.count("*").cast("double").alias("n"), *[F.count_if(c).alias(f"s_{c}") for c in self.criteria], *[F.count_if(F.col(a) & F.col(b)).alias(f"q_{a}_{b}") for a, b in self.ordered])
        rate = lambda x: F.col(x) / F.col("n")
        return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rate(f"q_{a}_{b}").alias("joint"), (rate(f"s_{a}") * rate(f"s_{b}")).alias("expected")) for a, b in self.ordered])).alias("p")).select("p.*")

    def evaluate(self) -> DataFrame:
        """(a, b, rho, low, high, effect, p, attainable, joint, expected, correlation, conditional, achievability, votes, deciding,
        verdict) of every ordered pair.

        A test is ``degenerate`` where it can't decide: a side is constant; more than half of the replicates are; b has no spread;
        or not even the worst tenth of b could reach the bar. Numbers of a test that can't decide stay where they are defined.
        """
        facts = settle(self.facts())
        about = lambda s: facts.select(F.col("criterion").alias(f"_{s}"), F.col("varies").alias(f"varies_{s}"), F.col("sd").alias(f"sd_{s}"), ratio(F.col("worst") - F.col("middle"), F.col("sd")).alias(f"attainable_{s}"))
        named = lambda df: df.withColumnsRenamed({"a": "_x", "b": "_y"})
        out = self.spark.createDataFrame(self.ordered, "a string, b string").join(F.broadcast(about("a")), F.col("a") == F.col("_a")).join(F.broadcast(about("b")), F.col("b") == F.col("_b"))
        for found in (self.correlations(), self.conditionals(facts), self.joint_rates(facts)):
            out = out.join(named(found), (F.col("a") == F.col("_x")) & (F.col("b") == F.col("_y")), "left").drop("_x", "_y")
        both = F.col("varies_a") & F.col("varies_b")
        say = lambda decides, fires: F.when(~F.coalesce(decides, F.lit(False)), "degenerate").when(fires, "tradeoff").otherwise("none")
        judged = out.select(
            "a", "b", "rho", "low", "high", "effect", "p", F.col("attainable_b").alias("attainable"), "joint", "expected",
            say(both & (F.col("replicates") >= self.reps // 2), F.col("high") < RHO).alias("correlation"),
            say(both & (F.col("sd_b") > 0) & (F.col("attainable_b") <= EFFECT), (F.col("effect") <= EFFECT) & (F.col("p") < ALPHA)).alias("conditional"),
            say(both, (F.col("expected") > 0) & (F.col("joint") < SUPPRESSION * F.col("expected"))).alias("achievability"),
        )
        count = lambda what: reduce(lambda x, y: x + y, [what(F.col(t)).cast("int") for t in TESTS])
        voted = judged.withColumns({"fired": count(lambda t: t == "tradeoff"), "decided": count(lambda t: t != "degenerate")})
        return verdict(voted, len(TESTS)).withColumnsRenamed({"fired": "votes", "decided": "deciding"})


def by_test(judged: DataFrame) -> DataFrame:
    """(a, b, test, verdict), as ``experiments.check_symmetry`` reads them."""
    return judged.unpivot(["a", "b"], list(TESTS), "test", "verdict")
