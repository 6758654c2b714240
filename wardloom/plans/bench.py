"""Queries of legal moves and of the cases of a bench, registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases, forest, ranking, verdicts
from ..operators import convergence as conv
from ..operators import experiments as exp
from ..operators import graph as gr
from ..operators import partisan as par
from ..operators import rules as ru
from ..operators.components import scratch_folder, settle
from ..sources import rounds
from .catalog import _ANCHORS, _DELTA, _MOVES, _RULES, _WIDE, RULE, _chains, _draws, _locations, _shared
from .mapping import State, r
from .registry import query, tidy

# --- what holds a district together ---------------------------------------------------------------------------------

#: A district is a run of units around the ring, which the table's end cuts in two. Within a run neighbours in number touch, and
#: units 50 apart; without a unit the run holds together where such a pair spans the gap.
_SPLIT = """, islands AS (SELECT plan, district, unit, unit - row_number() OVER (PARTITION BY plan, district ORDER BY unit) AS g FROM assign),
runs AS (SELECT plan, district, min(unit) AS a, max(unit) AS b, count(*) OVER (PARTITION BY plan, district) AS k FROM islands GROUP BY plan, district, g),
held AS (SELECT plan, district, unit, (unit = a AND NOT (a = 0 AND k = 2)) OR (unit = b AND NOT (b = n.n - 1 AND k = 2)) OR greatest(a, unit - 49) <= least(unit - 1, b - 50) AS whole FROM assign JOIN runs USING (plan, district), n WHERE unit BETWEEN a AND b)
"""


@query(_SPLIT + "SELECT plan, district, unit, 2 AS splits FROM held WHERE NOT whole")
def articulation_units(s: State) -> DataFrame:
    """Units of all plans without which their district falls apart."""
    return forest.articulation_units(forest.spanning_forest(s.assignments(), s.edges()))


@query(_MOVES.rstrip() + _SPLIT + f"SELECT d.*, CASE WHEN whole THEN 1 ELSE 2 END AS parts_left, whole AS legal FROM ({_DELTA}) d JOIN held ON held.plan = d.plan AND held.unit = d.unit")
def legal_moves(s: State) -> DataFrame:
    """Every single-unit move of every plan, and whether the district that it leaves stays in one piece."""
    moves = gr.move_candidates(s.blocks(), s.edges(), s.units(), s.orders.count() / 8.0)
    return forest.legal_moves(moves, forest.spanning_forest(s.blocks(), s.edges(), nodes="boundary"))


_LEGAL = """, legal AS (SELECT plan, max(abs(pop - i)) <= 0.05 * any_value(i) + 1e-9 AS legal FROM dist, (SELECT sum(pop) / 8.0::DOUBLE AS i FROM units) GROUP BY plan)
"""


def _legality(s: State) -> DataFrame:
    return gr.legality(s.blocks(), s.units(), 8, 0.05, forest.parts(forest.spanning_forest(s.blocks(), s.edges(), nodes="parts")))


@query(_LEGAL + "SELECT plan, TRUE AS coverage, TRUE AS ids, TRUE AS non_empty, TRUE AS contiguous, legal AS balanced, legal FROM legal")
def legality_with_contiguity(s: State) -> DataFrame:
    """All rules of a legal plan, contiguity among them, for every plan; bands around the ring are in one piece."""
    got = _legality(s)
    return got.select("plan", "coverage", "ids", "non_empty", "contiguous", "balanced", (F.col("coverage") & F.col("ids") & F.col("non_empty") & F.col("contiguous") & F.col("balanced")).alias("legal"))


@query("SELECT plan, district, count(DISTINCT unit % 50)::BIGINT AS pieces FROM (SELECT p.range AS plan, unit, (unit % 5 + 1)::INTEGER AS district FROM units, range(200) p) GROUP BY ALL")
def contiguity_of_strips(s: State) -> DataFrame:
    """Pieces of districts that are every fifth unit: columns of squares, five apart."""
    return gr.contiguity(forest.parts(forest.spanning_forest(s.layer2(), s.edges())))


# --- cases ----------------------------------------------------------------------------------------------------------

_POOL = _LEGAL + f""", maps AS (SELECT plan, list(district ORDER BY unit) AS ord FROM assign GROUP BY plan),
named AS (SELECT plan, unit, min(unit) OVER (PARTITION BY plan, district) AS district FROM assign), keys AS (SELECT plan, left(sha256(string_agg(unit::VARCHAR || ':' || district::VARCHAR, ';' ORDER BY unit)), 16) AS key FROM named GROUP BY plan),
conc AS (SELECT plan, {r('sum(dem::DOUBLE * dem) / pow(sum(dem)::DOUBLE, 2)')} AS concentration FROM dist GROUP BY plan),
mid AS (SELECT median(dem_seats)::DOUBLE AS m FROM metrics),
pool AS (SELECT plan, key, dem_seats AS seats, concentration, legal, ord, m, CASE WHEN dem_seats > m THEN 0 WHEN dem_seats < m THEN 1 ELSE 2 END AS side FROM metrics JOIN keys USING (plan) JOIN conc USING (plan) JOIN legal USING (plan) JOIN maps USING (plan), mid),
first AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY key ORDER BY plan) = 1)
"""


def _stratum_sql(name: str, source: str, rank: str, n: int) -> str:
    """Rows of one stratum; those above and below the median in turn where it is ranked."""
    turn = "0" if name == "random" else f"row_number() OVER (PARTITION BY side ORDER BY {rank})"
    order = rank if name == "random" else "side = 2, turn, side = CASE WHEN up >= down THEN 1 ELSE 0 END"
    return f"""{name}_turns AS (SELECT *, {turn} AS turn, count(*) FILTER (WHERE side = 0) OVER () AS up, count(*) FILTER (WHERE side = 1) OVER () AS down, count(*) OVER () AS left_over FROM {source}),
s_{name} AS (SELECT *, row_number() OVER (ORDER BY {order})::INTEGER AS rank FROM {name}_turns WHERE legal QUALIFY rank <= {n})"""


_NULLS = _POOL + ", " + _stratum_sql("concentration", "first", "concentration DESC, ord", 12) + ", without1 AS (SELECT * FROM first WHERE key NOT IN (SELECT key FROM s_concentration)), " + _stratum_sql("seat_outcome", "without1", "abs(seats - m) DESC, ord", 12) + ", without2 AS (SELECT * FROM without1 WHERE key NOT IN (SELECT key FROM s_seat_outcome)), " + _stratum_sql("random", "without2", "sha256('11|' || key)", 16) + " " + " UNION ALL ".join(f"SELECT printf('null_{n}_%02d', rank) AS case_id, '{n}' AS stratum, plan, seats, m AS median_seats, {r('seats - m')} AS seat_shift, concentration, rank AS selection_rank, (SELECT count(*) FROM pool) AS pool_size, left_over AS distinct_pool_size, {'FALSE' if n == 'seat_outcome' else 'TRUE'} AS in_gate_sample FROM s_{n}" for n in ("concentration", "seat_outcome", "random"))


def _keys(s: State) -> DataFrame:
    return s.once("keys", lambda: gr.canonical_key(s.blocks()))


@query(_NULLS)
def null_cases(s: State) -> DataFrame:
    """Null cases of three strata, no plan twice, legal ones only."""
    return _null_cases(s)


def _null_cases(s: State) -> DataFrame:
    votes = s.once("votes", lambda: par.district_votes(s.blocks(), s.votes()))
    seats = par.seat_counts(votes).select("plan", F.col("dem_seats").alias("seats"))
    legal = _legality(s).select("plan", (F.col("coverage") & F.col("ids") & F.col("non_empty") & F.col("contiguous") & F.col("balanced")).alias("legal"))
    order = s.blocks().order()
    pool = seats.join(tidy(par.vote_concentration(votes)), "plan").join(_keys(s), "plan").join(legal, "plan").join(order, "plan")
    return cases.null_cases(s.once("pool", lambda: pool), {"concentration": 12, "seat_outcome": 12, "random": 16}, 11)


_STARTS = _WIDE + f""", eligible AS (SELECT plan FROM draws WHERE metric IN {_ANCHORS} GROUP BY plan HAVING count(value) = 5),
named AS (SELECT plan, unit, min(unit) OVER (PARTITION BY plan, district) AS district FROM assign), keys AS (SELECT plan, left(sha256(string_agg(unit::VARCHAR || ':' || district::VARCHAR, ';' ORDER BY unit)), 16) AS key FROM named GROUP BY plan),
picked AS (SELECT plan FROM eligible QUALIFY row_number() OVER (ORDER BY sha256('5|' || plan::VARCHAR)) <= 6),
five AS (SELECT plan, metric, value FROM draws JOIN eligible USING (plan) WHERE metric IN {_ANCHORS}),
iqr AS (SELECT metric, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM five GROUP BY metric),
firsts AS (SELECT min(plan) AS plan, key FROM eligible JOIN keys USING (plan) GROUP BY key),
inside AS (SELECT p.plan AS anchor, f.plan FROM picked p JOIN keys pk ON pk.plan = p.plan JOIN firsts f ON f.key <> pk.key JOIN five a ON a.plan = p.plan JOIN five b ON b.plan = f.plan AND b.metric = a.metric JOIN iqr ON iqr.metric = a.metric GROUP BY p.plan, f.plan HAVING bool_and(abs(a.value - b.value) <= 0.5 * w + 1e-12))
SELECT plan AS anchor, 0 AS place, plan FROM picked UNION ALL (SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY plan)::INTEGER AS place, plan FROM inside QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY plan) < 8)
"""


@query(_STARTS)
def anchor_starts(s: State) -> DataFrame:
    """Six anchors, and for each up to eight plans to start from that resemble it in all five measures."""
    anchors = cases.draw_anchors(cases.anchor_pool(_draws(s), _ANCHORS), 5, 6)
    return cases.matched_starts(_draws(s), _keys(s), anchors, _ANCHORS, limit=8)


# --- what criteria cost each other ----------------------------------------------------------------------------------

CRITERIA = ("compactness", "few_cuts", "county_integrity", "equality", "low_gap", "symmetry", "competition")
_GOOD = {"compactness": "polsby_popper_mean", "few_cuts": "-cut_edges", "county_integrity": "-county_splits", "equality": "-spread", "low_gap": "-abs(efficiency_gap)", "symmetry": "-abs(mean_median)", "competition": "competitive"}
_RUN = 100  # plans of a run; two runs stand for two tolerances

_CRITERIA = _WIDE + f""", good AS (SELECT plan // {_RUN} AS run, plan // 25 AS chain, plan % 25 AS i, criterion, good FROM (""" + " UNION ALL ".join(f"SELECT plan, {i} AS k, '{c}' AS criterion, ({x})::DOUBLE AS good FROM wide" for i, (c, x) in enumerate(_GOOD.items())) + f""")),
vary AS (SELECT run, criterion FROM good GROUP BY ALL HAVING min(good) < max(good)),
ranked AS (SELECT *, rank() OVER (PARTITION BY run, criterion ORDER BY good) + (count(*) OVER (PARTITION BY run, criterion, good) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY run, criterion ORDER BY good DESC) AS place FROM good),
lv AS (SELECT * FROM (VALUES {', '.join(f'({q}::DOUBLE, {max(1, round((1 - q) * _RUN))})' for q in (0.0, 0.25, 0.5, 0.75, 0.9))}) t(level, spot)),
cut AS (SELECT run, criterion AS target, level, good AS cut FROM ranked JOIN lv ON place = spot JOIN vary USING (run, criterion)),
kept AS (SELECT g.run, g.chain, g.i, target, level, good >= cut AS kept FROM good g JOIN cut ON cut.run = g.run AND target = criterion),
us AS (SELECT k.run, target, level, r.criterion AS other, count(*) FILTER (WHERE kept) AS kept, count(*) AS n, sum(rk) FILTER (WHERE kept) AS s FROM kept k JOIN ranked r ON r.run = k.run AND r.chain = k.chain AND r.i = k.i AND r.criterion <> target JOIN vary v ON v.run = r.run AND v.criterion = r.criterion GROUP BY ALL),
deltas AS (SELECT run, target, level, other, kept, n - kept AS excluded, level > 0 AND least(kept, n - kept) < 0.01 * n AS refused, CASE WHEN level = 0 THEN 0.0 WHEN least(kept, n - kept) >= 0.01 * n THEN (2 * s - kept * (kept + 1)) / (kept * (n - kept))::DOUBLE - 1 END AS delta FROM us)
"""


def _criteria(s: State):
    good = [F.expr(x).cast("double").alias(c) for c, x in _GOOD.items()]
    return ranking.Criteria(_shared(s).select(F.floor(F.col("plan") / _RUN).alias("run"), F.floor(F.col("plan") / 25).alias("chain"), (F.col("plan") % 25).alias("draw"), *good), CRITERIA)


@query(_CRITERIA + f"SELECT run, target, level, other, kept, excluded, refused, {r('delta')} AS delta FROM deltas")
def criteria_deltas(s: State) -> DataFrame:
    """What adopting each of seven criteria costs each other one, at five levels, in two runs."""
    return _criteria(s).deltas()


_REPS = 40


@query(_CRITERIA + f""", strict AS (SELECT run, target, max(level) AS level FROM deltas WHERE NOT refused GROUP BY ALL),
shift AS (SELECT run, chain, t.range AS rep, ('0x' || left(sha256('11|' || t.range || '|' || run || '|' || chain), 8))::BIGINT % 25 AS turn FROM (SELECT DISTINCT run, chain FROM good), range({_REPS}) t),
turned AS (SELECT k.run, rep, target, kept, k.chain, (k.i + turn) % 25 AS j FROM kept k JOIN strict USING (run, target, level) JOIN shift h ON h.run = k.run AND h.chain = k.chain),
chance AS (SELECT t.run, t.target, rep, r.criterion AS other, (2 * sum(rk) FILTER (WHERE kept) - count(*) FILTER (WHERE kept) * (count(*) FILTER (WHERE kept) + 1)) / nullif(count(*) FILTER (WHERE kept) * count(*) FILTER (WHERE NOT kept), 0)::DOUBLE - 1 AS d FROM turned t JOIN ranked r ON r.run = t.run AND r.chain = t.chain AND r.i = t.j AND r.criterion <> t.target GROUP BY ALL),
worsts AS (SELECT run, target, rep, least(0.0, min(d)) AS w FROM chance GROUP BY ALL HAVING min(d) IS NOT NULL),
floors AS (SELECT run, target, list_sort(list(w))[greatest(0, floor(0.05 * count(*))::INT - 1) + 1] AS floor FROM worsts GROUP BY ALL),
named AS (SELECT *, list_position({list(CRITERIA)}, other) AS k FROM deltas),
by_level AS (SELECT run, target, level, any_value(refused) AS refused, min(delta) AS worst, CASE WHEN level > 0 THEN arg_min(other, (delta, k)) END AS other FROM named GROUP BY run, target, level),
best AS (SELECT run, target, min(worst) AS worst, arg_min(level, (worst, level)) AS level, arg_min(struct_pack(o := other), (worst, level)).o AS displaces, max(worst) FILTER (WHERE level = 0.5) AS real, (count(*) FILTER (WHERE refused))::INT AS levels_refused FROM by_level GROUP BY ALL)
SELECT a.run, row_number() OVER (PARTITION BY a.run ORDER BY b.worst NULLS LAST, list_position({list(CRITERIA)}, a.criterion))::INT * CASE WHEN b.target IS NULL THEN NULL ELSE 1 END AS place, a.criterion, {r('worst')} AS worst, level, displaces, {r('floor')} AS floor, CASE WHEN b.target IS NOT NULL THEN coalesce(worst < floor, FALSE) END AS clears, CASE WHEN b.target IS NOT NULL THEN worst <= -0.147 AND coalesce(worst < floor, FALSE) END AS binds, CASE WHEN b.target IS NOT NULL THEN coalesce(real <= -0.147, FALSE) END AS binds_at_realistic, levels_refused
FROM (SELECT DISTINCT run, criterion FROM good) a LEFT JOIN best b ON b.run = a.run AND b.target = a.criterion LEFT JOIN floors f ON f.run = a.run AND f.target = a.criterion""")
def criteria_with_floor(s: State) -> DataFrame:
    """Seven criteria of two runs by their worst delta, and whether it lies below what chance gives."""
    return _criteria(s).ranking(reps=_REPS)


_SCENARIOS = _NULLS.replace("SELECT printf", "SELECT * FROM (SELECT printf", 1) + ")"


@query(_SCENARIOS.replace("SELECT * FROM (", "SELECT case_id, 'null' AS kind, 0::BIGINT AS shift, in_gate_sample FROM (", 1))
def null_scenarios(s: State) -> DataFrame:
    """The null cases as scenarios of a detector's bench."""
    return cases.as_scenarios(_null_cases(s))


# --- rules and convergence ------------------------------------------------------------------------------------------

def _flags(s: State) -> DataFrame:
    return s.once("flags", lambda: ru.flag(_locations(s), RULE))


@query(_RULES + f"SELECT {r('(SELECT avg(CASE WHEN a.outlierness > b.outlierness THEN 1.0 WHEN a.outlierness = b.outlierness THEN 0.5 ELSE 0.0 END) FROM flags a JOIN flags b ON a.kind = $$planted$$ AND b.kind = $$null$$)')} AS auc, {r('(1 + tp / nullif(tp + fn, 0)::DOUBLE - fp / nullif(fp + tn, 0)::DOUBLE) / 2')} AS decision_auc, (SELECT count(*) FROM flags WHERE kind = 'planted' AND outlierness IS NOT NULL) AS n_planted, (SELECT count(*) FROM flags WHERE kind = 'null' AND outlierness IS NOT NULL) AS n_null FROM conf")
def auc_with_decision(s: State) -> DataFrame:
    """The area under the curve of the statistic, and of the rule's one operating point."""
    return ru.auc_with_decision(ru.auc(_flags(s)), ru.confusion(_flags(s)))


@query(_RULES + f", found AS (SELECT min(magnitude) FILTER (WHERE ok) AS shift FROM (SELECT a.magnitude, bool_and(b.flagged / b.n::DOUBLE >= 0.5) AS ok FROM curve a JOIN curve b ON b.magnitude >= a.magnitude GROUP BY 1)) SELECT {r('tp / nullif(tp + fn + up, 0)::DOUBLE')} AS tpr_worst, {r('(fp + un) / nullif(fp + tn + un, 0)::DOUBLE')} AS fpr_worst, tp / nullif(tp + fn + up, 0)::DOUBLE >= 0.95 AS tpr_pass, (fp + un) / nullif(fp + tn + un, 0)::DOUBLE <= 0.05 AS fpr_pass, shift, coalesce(shift <= 1, FALSE) AS shift_pass FROM conf, found")
def gates_with_shift(s: State) -> DataFrame:
    """All three gates of the rule."""
    return ru.gates_with_shift(ru.confusion(_flags(s)), ru.min_detectable_shift(ru.detection_curve(_flags(s)), 0.5))


@query()
def convergence_block(s: State) -> DataFrame:
    """R-hat and effective size of each measure together; ranked statistics have no SQL."""
    return conv.diagnostics(_chains(s))


# --- rounds over time -----------------------------------------------------------------------------------------------

@query("""!WITH o AS (SELECT year(o_orderdate) AS round, o_orderstatus, o_totalprice FROM orders)
SELECT round, count(*) AS cases, round(avg(o_totalprice), 4) + 0.0 AS mean, CASE WHEN round > 1993 THEN round(avg((o_orderstatus = 'F')::INT), 6) + 0.0 END AS fpr, CASE WHEN round > 1995 THEN count(*) FILTER (WHERE o_orderstatus = 'O') END AS open, NULL::DOUBLE AS never FROM o GROUP BY round""")
def round_history(s: State) -> DataFrame:
    """Reports of one round a year, whose fields grow from year to year, written and read again."""
    year = F.year("o_orderdate")
    by = s.orders.groupBy(year.alias("year")).agg(F.count("*").alias("cases"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("fpr"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    report = F.to_json(F.struct("cases", F.struct(F.col("mean")).alias("price"), F.when(F.col("year") > 1993, F.struct("fpr")).alias("gates"), F.when(F.col("year") > 1995, F.col("open")).alias("open")))
    with scratch_folder(s.spark) as home:
        by.select(report.alias("report"), F.concat(F.lit("round-"), F.col("year")).alias("at")).repartition("at").write.partitionBy("at").text(home)
        got = rounds.round_history(rounds.read_rounds(s.spark, f"{home}/*/*.txt"), ["cases", "price.mean", "gates.fpr", "open", "never"])
        return settle(got)


# --- verdicts on pairs ----------------------------------------------------------------------------------------------

_TRIALS = 1000

_VERDICTS = _WIDE + """, good AS (SELECT plan // 25 AS chain, plan % 25 AS i, criterion, good FROM (""" + " UNION ALL ".join(f"SELECT plan, '{c}' AS criterion, ({x})::DOUBLE AS good FROM wide" for c, x in _GOOD.items()) + f""")),
mids AS (SELECT criterion, min(good) < max(good) AS varies, median(good) AS middle, stddev_pop(good) AS pop_sd, quantile_cont(good, 1 - 1 / 3::DOUBLE) AS tercile FROM good GROUP BY criterion),
facts AS (SELECT m.*, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE pop_sd END AS sd, boundary, worst FROM mids m JOIN (SELECT g.criterion, median(abs(good - middle)) AS mad FROM good g JOIN mids USING (criterion) GROUP BY 1) USING (criterion) JOIN (SELECT criterion, min(good) FILTER (WHERE down <= 20) AS boundary, median(good) FILTER (WHERE up <= 20) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY good DESC) AS down, row_number() OVER (PARTITION BY criterion ORDER BY good) AS up FROM good) GROUP BY 1) USING (criterion)),
times AS (SELECT rep, k, count(*) AS t FROM (SELECT r.range AS rep, ('0x' || left(sha256('7|' || r.range || '|' || j.range), 8))::BIGINT % 8 AS k FROM range({_TRIALS}) r, range(8) j) GROUP BY ALL UNION ALL SELECT -1, range, 1 FROM range(8)),
again AS (SELECT rep, criterion, chain, i, t, sum(t) OVER (PARTITION BY rep, criterion ORDER BY good) - (sum(t) OVER (PARTITION BY rep, criterion, good) - 1) / 2.0::DOUBLE AS rk FROM good JOIN times ON chain = k),
moments AS (SELECT x.rep, x.criterion AS a, y.criterion AS b, sum(x.t) * sum(x.t * x.rk * y.rk) - sum(x.t * x.rk) * sum(x.t * y.rk) AS xy, sum(x.t) * sum(x.t * x.rk * x.rk) - sum(x.t * x.rk) * sum(x.t * x.rk) AS xx, sum(x.t) * sum(x.t * y.rk * y.rk) - sum(x.t * y.rk) * sum(x.t * y.rk) AS yy FROM again x JOIN again y ON y.rep = x.rep AND y.chain = x.chain AND y.i = x.i AND y.criterion <> x.criterion GROUP BY ALL),
rhos AS (SELECT rep, a, b, CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx) / sqrt(yy) END AS rho FROM moments),
cor AS (SELECT a, b, max(rho) FILTER (WHERE rep < 0) AS rho, list_sort(list(rho) FILTER (WHERE rep >= 0 AND rho IS NOT NULL)) AS s FROM rhos GROUP BY a, b),
shifts AS (SELECT c.range AS chain, r.range AS rep, CASE WHEN r.range < 0 THEN 0 ELSE ('0x' || left(sha256('7|turn|' || r.range || '|' || c.range), 8))::BIGINT % 25 END AS turn FROM range(8) c, range(-1, {_TRIALS}) r),
moved AS (SELECT rep, g.criterion AS a, g.chain, ((i - turn) % 25 + 25) % 25 AS i FROM good g JOIN facts f ON f.criterion = g.criterion AND good >= boundary JOIN shifts s ON s.chain = g.chain),
tops AS (SELECT rep, a, y.criterion AS b, median(y.good) AS top FROM moved m JOIN good y ON y.chain = m.chain AND y.i = m.i AND y.criterion <> a GROUP BY ALL),
cond AS (SELECT a, b, any_value(own) AS own, (count(*) FILTER (WHERE top <= own) + 1) / (count(*) + 1)::DOUBLE AS p FROM tops JOIN (SELECT a, b, top AS own FROM tops WHERE rep < 0) USING (a, b) WHERE rep >= 0 GROUP BY a, b),
thirds AS (SELECT chain, i, g.criterion, good >= tercile AS best FROM good g JOIN facts USING (criterion)),
joint AS (SELECT x.criterion AS a, y.criterion AS b, count(*) FILTER (WHERE x.best AND y.best) / count(*)::DOUBLE AS joint, (count(*) FILTER (WHERE x.best) / count(*)::DOUBLE) * (count(*) FILTER (WHERE y.best) / count(*)::DOUBLE) AS expected FROM thirds x JOIN thirds y ON y.chain = x.chain AND y.i = x.i AND y.criterion <> x.criterion GROUP BY ALL),
whole AS (SELECT a, b, rho, s[floor(0.025 * len(s))::INT + 1] AS low, s[least(len(s) - 1, floor(0.975 * len(s))::INT) + 1] AS high, len(s) AS reps, CASE WHEN fb.sd <> 0 THEN (own - fb.middle) / fb.sd END AS effect, p, CASE WHEN fb.sd <> 0 THEN (fb.worst - fb.middle) / fb.sd END AS attainable, joint, expected, fa.varies AND fb.varies AS vary, fb.sd FROM cor JOIN cond USING (a, b) JOIN joint USING (a, b) JOIN facts fa ON fa.criterion = a JOIN facts fb ON fb.criterion = b),
said AS (SELECT *, CASE WHEN NOT vary OR coalesce(reps, 0) < {_TRIALS // 2} THEN 'degenerate' WHEN high < -0.1 THEN 'tradeoff' ELSE 'none' END AS correlation, CASE WHEN NOT vary OR sd = 0 OR coalesce(attainable > -0.2, TRUE) THEN 'degenerate' WHEN effect <= -0.2 AND p < 0.05 THEN 'tradeoff' ELSE 'none' END AS conditional, CASE WHEN NOT vary THEN 'degenerate' WHEN expected > 0 AND joint < 0.5 * expected THEN 'tradeoff' ELSE 'none' END AS achievability FROM whole),
voted AS (SELECT *, (correlation = 'tradeoff')::INT + (conditional = 'tradeoff')::INT + (achievability = 'tradeoff')::INT AS votes, (correlation <> 'degenerate')::INT + (conditional <> 'degenerate')::INT + (achievability <> 'degenerate')::INT AS deciding FROM said),
judged AS (SELECT *, CASE WHEN deciding = 0 THEN 'degenerate' WHEN votes = 0 THEN 'none' WHEN votes = 3 AND deciding = 3 THEN 'strong' ELSE 'weak' END AS verdict FROM voted)
"""


def _judged(s: State) -> DataFrame:
    good = [F.expr(x).cast("double").alias(c) for c, x in _GOOD.items()]
    rows = _shared(s).select(F.floor(F.col("plan") / 25).alias("chain"), (F.col("plan") % 25).alias("draw"), *good)
    return s.once("judged", lambda: verdicts.Pairs(rows, CRITERIA, reps=_TRIALS).evaluate())


@query(_VERDICTS + "SELECT a, b, " + ", ".join(f"{r(c)} AS {c}" for c in ("rho", "low", "high", "effect", "p", "attainable", "joint", "expected")) + ", correlation, conditional, achievability, votes, deciding, verdict FROM judged")
def pair_verdicts(s: State) -> DataFrame:
    """Three tests of every ordered pair of seven criteria, with replicates, and their verdict."""
    return _judged(s)


@query(_VERDICTS + ", t AS (UNPIVOT (SELECT a, b, correlation, achievability FROM judged) ON correlation, achievability INTO NAME test VALUE verdict) SELECT x.test, count(*) AS checked, count(*) FILTER (WHERE x.verdict <> y.verdict) AS mismatches FROM t x JOIN t y ON x.a = y.b AND x.b = y.a AND x.test = y.test WHERE x.a < x.b GROUP BY x.test")
def symmetry_of_verdicts(s: State) -> DataFrame:
    """How often a test that should not care for direction decides otherwise when a pair is turned round."""
    return exp.check_symmetry(verdicts.by_test(_judged(s)), verdicts.SYMMETRIC)


@query(_VERDICTS + "SELECT least(a, b) AS a, greatest(a, b) AS b, array_to_string(list_sort(list(DISTINCT verdict)), ',') AS verdicts FROM judged GROUP BY ALL")
def pair_relationships(s: State) -> DataFrame:
    """Verdicts by unordered pair."""
    return exp.relationships(_judged(s)).withColumn("verdicts", F.array_join("verdicts", ","))
