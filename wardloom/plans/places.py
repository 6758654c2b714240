"""Queries of places and outlines, registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import contexts, nearest, polygons, spatial
from ..operators import partisan as par
from ..sources import names
from .mapping import State, table
from .catalog import _ARMS
from .registry import query

# --- records brought to units ---------------------------------------------------------------------------------------

def _records(s: State) -> DataFrame:
    """Orders as records of votes with a place, of which a third names its unit, a third names none and a third one that doesn't
    exist. Places reach beyond all outlines."""
    key = F.col("o_orderkey")
    claimed = F.when(key % 3 == 0, F.col("o_custkey")).when(key % 3 == 1, -F.col("o_custkey") - 1)
    dem, rep = ((F.col("o_orderstatus") == x).cast("long") for x in "FO")
    return s.orders.select(key.alias("record"), claimed.alias("claimed"), (key * 7919 % 8000 / 100.0 - 15).alias("x"), (key * 104729 % 6000 / 100.0 - 15).alias("y"), dem.alias("dem"), rep.alias("rep"))


_RECORDS = """!WITH rec AS (SELECT o_orderkey AS record, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN -o_custkey - 1 END AS claimed, o_orderkey * 7919 % 8000 / 100.0::DOUBLE - 15 AS x, o_orderkey * 104729 % 6000 / 100.0::DOUBLE - 15 AS y, o_orderstatus FROM orders),
sq AS (SELECT c_custkey AS unit, c_custkey % 50 AS x0, c_custkey // 50 AS y0 FROM customer),
known AS (SELECT record, unit FROM rec JOIN sq ON claimed = unit),
apart AS (SELECT record, unit, sqrt(pow(greatest(x0 - x, 0, x - x0 - 1), 2) + pow(greatest(y0 - y, 0, y - y0 - 1), 2)) AS distance FROM rec ANTI JOIN known USING (record), sq),
near AS (SELECT record, min((distance, unit)) AS hit FROM apart GROUP BY record),
placed AS (SELECT record, unit, 'id' AS how, 0.0::DOUBLE AS distance FROM known UNION ALL SELECT record, hit[2], CASE WHEN hit[1] > 0 THEN 'nearest' ELSE 'inside' END, hit[1] FROM near)
"""


@query(_RECORDS + "SELECT record, unit, how, round(distance, 9) + 0.0 AS distance FROM placed")
def placed_records(s: State) -> DataFrame:
    """The unit of each record: by its id, else the outline around its place, else the nearest outline."""
    return nearest.placed_records(_records(s), s.membership(), s.unit_geom(), cell=1.0)


@query(_RECORDS + "SELECT sq.unit, count(record) FILTER (WHERE o_orderstatus = 'F') AS dem, count(record) FILTER (WHERE o_orderstatus = 'O') AS rep FROM sq LEFT JOIN (SELECT placed.unit, record, o_orderstatus FROM placed JOIN rec USING (record)) p ON p.unit = sq.unit GROUP BY 1")
def placed_votes(s: State) -> DataFrame:
    """Votes of all records on all units; none is lost on the way."""
    records = _records(s)
    return nearest.summed_on_units(records, nearest.placed_records(records, s.membership(), s.unit_geom(), cell=1.0), s.membership(), ["dem", "rep"])


@query(_RECORDS + "SELECT record, claimed, min(s.unit) AS unit FROM rec JOIN known k USING (record) JOIN sq s ON x >= x0 AND x <= x0 + 1 AND y >= y0 AND y <= y0 + 1 GROUP BY ALL HAVING min(s.unit) <> claimed")
def records_claimed_elsewhere(s: State) -> DataFrame:
    """Records whose place lies in another unit than the one they name."""
    return nearest.claimed_elsewhere(_records(s), s.membership(), s.unit_geom(), cell=1.0)


# --- polygons -------------------------------------------------------------------------------------------------------

def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def _layers(s: State) -> tuple[DataFrame, DataFrame]:
    """Units that are squares without a quarter, and zones that are square frames around a hole."""
    x, y = F.col("x"), F.col("y")
    units = s.membership().select("unit", (F.col("unit") % 50).cast("double").alias("x"), F.floor(F.col("unit") / 50).cast("double").alias("y"))
    bent = _ring((x, y), (x + 1, y), (x + 1, y + 0.5), (x + 0.5, y + 0.5), (x + 0.5, y + 1), (x, y + 1))
    cell = units.select(F.floor(x / 2.7).alias("i"), F.floor(y / 2.4).alias("j")).distinct().select((F.col("j") * 100 + F.col("i")).alias("zone"), (F.col("i") * 2.7).alias("x"), (F.col("j") * 2.4).alias("y"))
    box = lambda low, high: _ring((x + low, y + low), (x + high, y + low), (x + high, y + high), (x + low, y + high))
    return units.select("unit", F.array(bent).alias("rings")), cell.select("zone", F.array(box(0.0, 2.4), box(0.6, 1.8)).alias("rings"))


_LAYERS = """!WITH u AS (SELECT c_custkey AS unit, (c_custkey % 50)::DOUBLE AS x, (c_custkey // 50)::DOUBLE AS y FROM customer),
ub AS (SELECT unit, x AS x0, y AS y0, x + 1 AS x1, y + 0.5 AS y1 FROM u UNION ALL SELECT unit, x, y + 0.5, x + 0.5, y + 1 FROM u),
cell AS (SELECT DISTINCT floor(x / 2.7::DOUBLE)::BIGINT AS i, floor(y / 2.4::DOUBLE)::BIGINT AS j FROM u),
zb AS (SELECT j * 100 + i AS zone, i * 2.7::DOUBLE + low AS x0, j * 2.4::DOUBLE + low AS y0, i * 2.7::DOUBLE + high AS x1, j * 2.4::DOUBLE + high AS y1, sign FROM cell, (VALUES (0.0::DOUBLE, 2.4::DOUBLE, 1), (0.6::DOUBLE, 1.8::DOUBLE, -1)) t(low, high, sign)),
shared AS (SELECT unit, zone, sum(sign * (least(u.x1, z.x1) - greatest(u.x0, z.x0)) * (least(u.y1, z.y1) - greatest(u.y0, z.y0))) AS area FROM ub u JOIN zb z ON u.x0 < z.x1 AND z.x0 < u.x1 AND u.y0 < z.y1 AND z.y0 < u.y1 GROUP BY ALL)
"""


@query(_LAYERS + "SELECT unit, zone, round(area, 9) + 0.0 AS area, round(area / 0.75, 9) + 0.0 AS share FROM shared WHERE round(area, 9) > 0")
def polygon_overlay(s: State) -> DataFrame:
    """The area that each unit and zone share, for shapes with notches and holes."""
    units, zones = _layers(s)
    return polygons.overlay(units, zones, tile=5.0).where("round(area, 9) > 0")


@query(_LAYERS + "SELECT unit, 0.75::DOUBLE AS area, round(coalesce(sum(area), 0), 9) + 0.0 AS covered, round(0.75 - coalesce(sum(area), 0), 9) + 0.0 AS outside FROM u LEFT JOIN shared USING (unit) GROUP BY unit")
def area_outside_zones(s: State) -> DataFrame:
    """How much of each unit lies in no zone."""
    units, zones = _layers(s)
    return polygons.uncovered(units, polygons.overlay(units, zones, tile=5.0))


#: Runs of units in a district: in one row of squares, in two rows without a common column, or else in one piece.
_RUNS = """, islands AS (SELECT plan, district, unit, unit - row_number() OVER (PARTITION BY plan, district ORDER BY unit) AS g FROM assign),
runs AS (SELECT plan, district, min(unit) AS a, max(unit) AS b FROM islands GROUP BY plan, district, g)
"""


@query(_RUNS + "SELECT plan, district, sum(CASE WHEN b // 50 = a // 50 + 1 AND b - 50 < a THEN 2 ELSE 1 END)::BIGINT AS rings, 0::BIGINT AS holes, sum(b - a + 1)::DOUBLE AS area FROM runs GROUP BY ALL")
def dissolved_districts(s: State) -> DataFrame:
    """Rings, holes and area of the outline of every district of every plan."""
    rings = polygons.dissolve(s.blocks(), s.unit_geom())
    return rings.groupBy("plan", "district").agg(F.count("*").alias("rings"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").alias("area"))


@query(_RUNS + "SELECT plan, district, sum(CASE WHEN b // 50 = a // 50 + 1 AND b - 50 < a THEN 2 ELSE 1 END)::BIGINT AS rook, sum(CASE WHEN b // 50 = a // 50 + 1 AND b - 50 < a - 1 THEN 2 ELSE 1 END)::BIGINT AS queen FROM runs GROUP BY ALL")
def pieces_by_contact(s: State) -> DataFrame:
    """Parts of the districts of all plans by shared sides, and by shared corners."""
    geom = s.once("geom", lambda: s.unit_geom().repartition("unit"))  # few bytes, much work
    return spatial.pieces_by_contact(s.blocks(), spatial.rook_edges(geom), spatial.queen_edges(geom))


@query("SELECT unit, dem AS land, rep AS water, CASE WHEN dem + rep > 0 THEN round(rep / (dem + rep)::DOUBLE, 9) + 0.0 END AS share FROM units")
def water_share(s: State) -> DataFrame:
    """Two counts of a unit's orders as its areas of land and water."""
    return spatial.water_share(s.membership(), s.votes().select("unit", F.col("dem").alias("land"), F.col("rep").alias("water")))


# --- contexts -------------------------------------------------------------------------------------------------------

_USABLE = {"efficiency_gap": "TRUE", "mean_median": "NOT (arm_margin OR arm_sweep OR arm_median)", "declination": "declination IS NOT NULL AND n_districts >= 8", "partisan_bias": "NOT (arm_margin OR arm_sweep OR arm_median)"}


@query(_ARMS.rstrip() + """, f AS (SELECT max(c) <= 1 AS whole FROM (SELECT count(*) AS c FROM units GROUP BY parent)),
spoken AS (""" + " UNION ALL ".join(f"SELECT plan, '{m}' AS metric, {x} AS usable, 'not to be trusted on these votes' AS why FROM arms" for m, x in _USABLE.items()) + """ UNION ALL SELECT plan, metric, fine, why FROM arms, f, LATERAL (VALUES
('county_splits', NOT whole, 'each subdivision is one unit'), ('split_pieces', NOT whole, 'each subdivision is one unit'), ('excess_pieces', NOT whole, 'each subdivision is one unit'), ('ballot_styles', FALSE, 'one layer: styles equal districts'),
('ballot_styles_by_subdivision', NOT whole, 'each subdivision is one unit'), ('ballot_styles_per_10k', FALSE, 'one layer: styles equal districts'), ('n_units', FALSE, 'a property of the input'), ('n_units_in_no_subdivision', FALSE, 'a property of the input'),
('n_subdivisions', FALSE, 'a property of the input'), ('n_districts', TRUE, ''), ('n_layers', FALSE, 'a property of the input')) t(metric, fine, why))
SELECT plan, metric, usable, CASE WHEN NOT usable THEN why END AS reason FROM spoken""")
def plan_contexts(s: State) -> DataFrame:
    """Which measures mean little for which plan, and why."""
    return contexts.context_for(par.all_metrics(par.district_votes(s.assignments(), s.votes())), s.membership(), 1, 8)


@query("SELECT plan, district, dem, rep FROM dist")
def district_votes_held(s: State) -> DataFrame:
    """Votes by district where plans and votes are first held against each other, unit by unit."""
    return par.district_votes(s.assignments(), s.votes(), strict=True)


# --- names ----------------------------------------------------------------------------------------------------------

def _spelled(s: State) -> tuple[DataFrame, DataFrame]:
    """Nations as units, their numbers written in letters, and orders as records that spell their nation in three ways."""
    nation = table(s.spark, s.dir, "nation").select("n_nationkey", F.translate("n_name", "0123456789", "ABCDEFGHIJ").alias("n_name"))
    rows = s.orders.join(s.customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.initcap("n_name"), F.lit(" County"))).when(F.col("o_orderstatus") == "O", F.lower(F.regexp_replace("n_name", "(.)(.)", "$1\\'$2"))).otherwise(F.concat(F.lit(" "), F.col("n_name")))
    return nation.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name")), rows.select(name.alias("name"), F.lit(1).alias("records"), (F.col("o_orderstatus") == "F").cast("int").alias("dem"), (F.col("o_orderstatus") == "O").cast("int").alias("rep"))


_SPELLED = """!WITH rec AS (SELECT n_nationkey AS unit, translate(n_name, '0123456789', 'ABCDEFGHIJ') AS n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query(_SPELLED + "SELECT unit, count(*) AS records, count(*) FILTER (WHERE o_orderstatus = 'F') AS dem, count(*) FILTER (WHERE o_orderstatus = 'O') AS rep FROM rec GROUP BY unit")
def county_sums_by_name(s: State) -> DataFrame:
    """Sums of records on the units whose names they spell in several ways; as many as there are orders."""
    units, records = _spelled(s)
    return names.summed_by_name(units, records, ["records", "dem", "rep"], {"records": s.orders.count()})


@query(_SPELLED + "SELECT regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS key, count(DISTINCT o_orderstatus) AS spellings FROM rec GROUP BY 1 HAVING spellings > 1")
def name_collisions(s: State) -> DataFrame:
    """Keys that several spellings come down to."""
    return names.name_collisions(_spelled(s)[1].select("name")).select("key", "spellings")
