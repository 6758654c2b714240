"""Cases of a detector's bench: baselines, anchors, strata, and chains of a committed run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, wilson
from .components import settle
from .ordering import numbered

#: Strata of null cases in the order in which they are filled, and whether the gates read them.
NULL_STRATA = {"concentration": True, "seat_outcome": False, "random": True}


def most_seats_plan(assignments: DataFrame, seats: DataFrame, party: str = "dem") -> DataFrame:
    """(plan, seats): the plan with the most seats of a party in ``seats(plan, dem_seats, rep_seats)``. Of equal ones that whose
    districts, read in the order of units, come last; of plans that are the same the smallest number."""
    column = f"{party}_seats"
    most = seats.agg(F.max(column).alias("_most"))
    best = seats.join(F.broadcast(most), F.col(column) == F.col("_most")).select(F.col("plan").alias("_plan"), F.col(column).alias("seats"))
    rows = assignments.join(F.broadcast(best), F.col("plan") == F.col("_plan"))
    maps = rows.groupBy("plan", "seats").agg(F.array_sort(F.collect_list(F.struct("unit", "district"))).alias("map"))
    return maps.agg(F.max_by(F.struct("plan", "seats"), F.struct(F.col("map"), -F.col("plan"))).alias("b")).select("b.*").where("plan is not null")


def anchor_pool(draws: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """(plan): the plans that have all measures, in ``draws(plan, metric, value)``; none if a measure has no value at all."""
    rows = draws.where(F.col("metric").isin(*measures) & F.col("value").isNotNull())
    return rows.groupBy("plan").agg(F.countDistinct("metric").alias("c")).where(F.col("c") == len(measures)).select("plan")


def draw_anchors(pool: DataFrame, seed: int, n: int) -> DataFrame:
    """(plan, place): ``n`` plans of the pool in an order that the seed and the plan decide."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("plan").cast("string")), 256)
    first = pool.select("plan", key.alias("_key")).orderBy("_key", "plan").limit(n)
    return first.select("plan", F.row_number().over(Window.orderBy("_key", "plan")).alias("place"))  # n rows


def stratum_rates(flags: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, n, resolved, unresolved, flagged, fpr, low, high) of ``flags(case_id, flagged)`` by ``strata(case_id, stratum)``.

    The rate is over resolved cases (flagged is not null), with its Wilson interval; null where none is resolved.
    """
    rows = flags.join(strata, "case_id")
    out = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count("flagged").alias("resolved"), F.count_if(F.col("flagged").isNull()).alias("unresolved"), F.count_if(F.col("flagged")).alias("flagged"))
    ci = wilson(F.col("flagged"), F.col("resolved"))
    return out.select("*", ratio(F.col("flagged"), F.col("resolved")).alias("fpr"), ci["low"].alias("low"), ci["high"].alias("high"))


def beats_baselines(auc: DataFrame, confusion: DataFrame) -> DataFrame:
    """(ranking, operating_point, verdict) from ``auc(auc)`` and ``confusion(youden)``: does the rule beat constant answers?

    Ranking: an AUC above 0.5. Operating point: more true than false alarms. The verdict is false as soon as one fails, null
    where one is unknown and none fails.
    """
    both = auc.select("auc").join(F.broadcast(confusion.select("youden")), F.lit(True))
    ranking, operating = F.col("auc") > 0.5, F.col("youden") > 0
    return both.select(ranking.alias("ranking"), operating.alias("operating_point"), (ranking & operating).alias("verdict"))


def chains_of(draws: DataFrame, chains: DataFrame, rectangle: int | None = None) -> DataFrame:
    """The draws of a committed run that an analysis may use.

    ``draws(chain, draw, ...)`` and ``chains(chain, completed)``. Without ``rectangle`` those of completed chains; with it the
    first ``rectangle`` draws of every chain that has so many, completed or not.
    """
    if rectangle is None:
        done = chains.where("completed").select("chain")
        return draws.join(F.broadcast(done), "chain")
    long = draws.groupBy("chain").agg(F.countDistinct("draw").alias("_n")).where(F.col("_n") >= rectangle).select("chain")
    place = F.dense_rank().over(Window.partitionBy("chain").orderBy("draw"))
    return draws.join(F.broadcast(long), "chain").withColumn("_place", place).where(F.col("_place") <= rectangle).drop("_place")


def _by_turns(rows: DataFrame, middle: float, *order) -> list:
    """``rows`` with _turn, its place within its side of ``middle`` seats, and the order that takes both sides in turn: the longer
    side first (the upper one if they are equal), plans at the middle last."""
    side = F.when(F.col("seats") > middle, 0).when(F.col("seats") < middle, 1).otherwise(2)
    sided = numbered(rows.withColumn("_side", side), "_all", F.col("_side"), *order)
    sizes = {r["_side"]: r["n"] for r in sided.groupBy("_side").agg(F.count("*").alias("n")).collect()}  # three sides at most
    up, down = sizes.get(0, 0), sizes.get(1, 0)
    start = F.when(F.col("_side") == 0, 0).when(F.col("_side") == 1, up).otherwise(up + down)
    second = F.col("_side") == (1 if up >= down else 0)
    return [sided.withColumn("_turn", F.col("_all") - start), F.col("_side") == 2, F.col("_turn"), second]


def null_cases(pool: DataFrame, sizes: dict[str, int], seed: int, balance: bool = True) -> DataFrame:
    """(case_id, stratum, plan, seats, median_seats, seat_shift, concentration, selection_rank, pool_size, distinct_pool_size,
    in_gate_sample) of ``pool(plan, key, seats, concentration, legal, order)``.

    Strata are filled in the order of ``sizes``, each with so many plans: ``concentration`` from the most concentrated on,
    ``seat_outcome`` from the farthest from the pool's median seats on, ``random`` in an order that the seed decides. Equal ones
    go by ``order``. With ``balance`` the first two take plans above and below the median in turn. A plan stands for its key, the
    first one in number; no key is taken twice, and plans that aren't legal are passed over. The median is that of all
    plans, repeated ones included. Fewer plans than asked for give fewer cases.
    """
    if not set(sizes) <= set(NULL_STRATA):
        raise ValueError(f"strata are {', '.join(NULL_STRATA)}")
    spark = pool.sparkSession
    total, middle = pool.agg(F.count("*"), F.median("seats")).first()
    left = settle(pool.join(pool.groupBy("key").agg(F.min("plan").alias("plan")), ["key", "plan"], "left_semi"))
    schema = "case_id string, stratum string, plan long, seats long, median_seats double, seat_shift double, concentration double, selection_rank int, pool_size long, distinct_pool_size long, in_gate_sample boolean"
    out = spark.createDataFrame([], schema)
    for stratum, n in sizes.items():
        if n < 1:
            continue
        ranks = {"concentration": [F.desc("concentration"), F.col("order")], "seat_outcome": [F.desc(F.abs(F.col("seats") - middle)), F.col("order")], "random": [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("key").cast("string")), 256)]}[stratum]
        rows, *order = _by_turns(left, middle, *ranks) if balance and stratum != "random" else [left, *ranks]
        taken = rows.where("legal").orderBy(*order).limit(n)
        place = F.row_number().over(Window.orderBy(*order)).alias("selection_rank")  # n rows
        named = taken.select("key", "plan", "seats", "concentration", place)
        named = settle(named.select("key", F.format_string(f"null_{stratum}_%02d", F.col("selection_rank")).alias("case_id"), F.lit(stratum).alias("stratum"), F.col("plan").cast("long").alias("plan"), F.col("seats").cast("long").alias("seats"), F.lit(middle).cast("double").alias("median_seats"), (F.col("seats") - middle).cast("double").alias("seat_shift"), "concentration", "selection_rank", F.lit(total).alias("pool_size"), F.lit(left.count()).alias("distinct_pool_size"), F.lit(NULL_STRATA[stratum]).alias("in_gate_sample")))
        out = out.unionByName(named.drop("key"))
        left = left.join(F.broadcast(named.select("key")), "key", "left_anti")  # n keys
    return out


def as_scenarios(cases: DataFrame, planted: DataFrame | None = None) -> DataFrame:
    """(case_id, kind, shift, in_gate_sample) of null cases, and of ``planted(case_id, shift)``: what a detector's bench scores. A null
    case has no intended shift, wherever its plan ended up; planted ones always decide the gates."""
    out = cases.select("case_id", F.lit("null").alias("kind"), F.lit(0).cast("long").alias("shift"), "in_gate_sample")
    if planted is None:
        return out
    return out.unionByName(planted.select("case_id", F.lit("planted").alias("kind"), F.col("shift").cast("long").alias("shift"), F.lit(True).alias("in_gate_sample")))


def matched_starts(draws: DataFrame, keys: DataFrame, anchors: DataFrame, measures: tuple[str, ...], limit: int, width: float = 0.5) -> DataFrame:
    """(anchor, place, plan): for each anchor up to ``limit`` plans to start from, itself at place 0.

    ``draws(plan, metric, value)`` are the ensemble, ``keys(plan, key)`` tell plans that are the same, ``anchors(plan)`` are plans of
    the pool. A start has every measure within ``width`` interquartile ranges of the anchor's. Starts come in order of their
    numbers; of plans that are the same the first one counts, and none is the same as the anchor.

    The measures of a plan are one row. Boxes meet plans in buckets of the first two measures that vary, as wide as a box, so a
    box looks into two of each; the rest is compared on what meets there. All plans are looked at, whatever their number.
    """
    values = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"v{i}") for i, m in enumerate(measures)]
    wide = settle(draws.where(F.col("metric").isin(*measures) & F.col("value").isNotNull()).groupBy("plan").agg(*values).where(" AND ".join(f"v{i} IS NOT NULL" for i in range(len(measures)))))
    spans = wide.agg(*[(F.percentile(f"v{i}", F.lit(0.75)) - F.percentile(f"v{i}", F.lit(0.25))).alias(f"s{i}") for i in range(len(measures))]).first()
    reach = [width * (s or 0.0) for s in spans]
    keyed = wide.join(keys.select(F.col("plan").alias("_plan"), "key"), F.col("plan") == F.col("_plan")).drop("_plan")
    own = keyed.join(anchors.select(F.col("plan").alias("_anchor")), F.col("plan") == F.col("_anchor")).select("_anchor", F.col("key").alias("_key"), *[F.col(f"v{i}").alias(f"a{i}") for i in range(len(measures))])
    first = keyed.join(keyed.groupBy("key").agg(F.min("plan").alias("plan")), ["key", "plan"], "left_semi")
    axes = [i for i, r in enumerate(reach) if r > 0][:2]
    bucket = lambda x, i: F.floor(x / (2 * reach[i]))
    for i in axes:
        first = first.withColumn(f"b{i}", bucket(F.col(f"v{i}"), i))
        own = own.withColumn(f"b{i}", F.explode(F.sequence(bucket(F.col(f"a{i}") - reach[i] * (1 + 1e-9), i), bucket(F.col(f"a{i}") + reach[i] * (1 + 1e-9), i))))
    one = F.lit(0).alias("b")
    met = first.withColumn("b", one).join(own.withColumn("b", one), ["b", *[f"b{i}" for i in axes]])
    for i, r in enumerate(reach):
        met = met.where(F.abs(F.col(f"v{i}") - F.col(f"a{i}")) <= r + 1e-12)
    met = met.where(F.col("key") != F.col("_key")).select(F.col("_anchor").alias("anchor"), "plan")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("plan"))
    others = met.withColumn("place", place).where(F.col("place") < limit)
    itself = own.select(F.col("_anchor").alias("anchor"), F.lit(0).alias("place"), F.col("_anchor").alias("plan")).distinct()
    return itself.unionByName(others.select("anchor", "place", "plan"))
