"""Districting frames derived from the given tables, and the same in DuckDB SQL.

Customers are units, their orders people and votes, their nations counties. Plans are bands of units on a ring, turned by
``SHIFT`` units from one plan to the next. ``DRAWS`` plans in a row make a chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import Blocks
from ..operators.components import settle

PLANS, K, SHIFT, DRAWS, WIDTH = 200, 8, 7, 25, 50
#: Rows of all plans that one task makes, at most, about.
ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class State:
    """The frames of one state, read from ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.customer = table(spark, sf_dir, "customer")
        self.n = self.customer.count()  # from the footers
        self._kept: dict[str, DataFrame] = {}
        self._blocks: Blocks | None = None

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that several operators of one query read: computed and written once."""
        if name not in self._kept:
            self._kept[name] = settle(make())
        return self._kept[name]

    @property
    def orders(self) -> DataFrame:
        return table(self.spark, self.dir, "orders")

    def units(self) -> DataFrame:
        """unit, pop, parent, dem, rep (contest A)."""
        by = self.orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("pop"), F.count_if(F.col("o_orderstatus") == "F").alias("dem"), F.count_if(F.col("o_orderstatus") == "O").alias("rep"))
        base = self.customer.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("parent"))
        return base.join(by, "unit", "left").select("unit", "parent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pop", "dem", "rep")])

    def votes(self) -> DataFrame:
        return self.units().select("unit", "dem", "rep")

    def votes_b(self) -> DataFrame:
        """Contest B: returned line items."""
        lines = table(self.spark, self.dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_returnflag")
        by = lines.join(self.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("unit")).agg(F.count_if(F.col("l_returnflag") == "A").alias("dem"), F.count_if(F.col("l_returnflag") == "R").alias("rep"))
        return self.customer.select(F.col("c_custkey").alias("unit")).join(by, "unit", "left").select("unit", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dem", "rep")])

    def membership(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("parent"))

    def assignments(self, plans: int = PLANS, repeat: int = 1, ordered: bool = False) -> DataFrame:
        """plan, unit, district; with ``repeat`` each plan comes so many times, ``ordered`` units lie in ranges by task.

        Units are dealt to tasks before they meet the plans, so joins and groups by unit move no rows of plans. They meet them in
        a join and not in an array, since Spark takes an exploded array to be as small as its table, and broadcasts all plans.
        """
        n = self.n
        turned = F.pmod(F.col("unit") + SHIFT * F.floor(F.col("plan") / repeat), F.lit(n))
        parts = max(1, math.ceil(n * plans / ROWS))
        units = self.customer.select(F.col("c_custkey").alias("unit"))
        units = units.repartitionByRange(parts, "unit") if ordered else units.repartition(parts, "unit")
        rows = units.crossJoin(F.broadcast(self.spark.range(plans).withColumnRenamed("id", "plan")))
        return rows.select("plan", "unit", (F.floor(turned * K / n) + 1).cast("int").alias("district"))

    def blocks(self) -> Blocks:
        """The assignments, packed once for all operators of a query."""
        if self._blocks is None:
            self._blocks = Blocks(self.assignments(ordered=True))
        return self._blocks

    def layer2(self, plans: int = PLANS) -> DataFrame:
        return self.assignments(plans).select("plan", "unit", (F.col("unit") % 5 + 1).cast("int").alias("district"))

    def edges(self) -> DataFrame:
        """u, v, shared_len: a ring and a lattice of width ``WIDTH``, each pair once; grid neighbours share a side."""
        n = self.n
        u = F.col("c_custkey")
        ring = self.customer.select(F.least(u, F.pmod(u + 1, F.lit(n))).alias("u"), F.greatest(u, F.pmod(u + 1, F.lit(n))).alias("v"))
        grid = self.customer.where(u + WIDTH < n).select(u.alias("u"), (u + WIDTH).alias("v"))
        side = ((F.col("v") - F.col("u") == WIDTH) | ((F.col("v") - F.col("u") == 1) & (F.col("u") % WIDTH != WIDTH - 1))).cast("double")
        return ring.unionByName(grid).where("u <> v").distinct().select("u", "v", side.alias("shared_len"))

    def unit_geom(self) -> DataFrame:
        u = F.col("c_custkey")
        x, y = (u % WIDTH).cast("double"), F.floor(u / WIDTH).cast("double")
        corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
        ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
        return self.customer.select(u.alias("unit"), F.lit(1.0).alias("area"), F.lit(4.0).alias("perimeter"), ring.alias("ring"))


#: The same frames as DuckDB SQL; queries go on with more common table expressions or a SELECT.
PRELUDE = f"""WITH n AS (SELECT count(*) AS n FROM customer),
by_unit AS (SELECT o_custkey AS unit, count(*) AS pop, count(*) FILTER (WHERE o_orderstatus = 'F') AS dem, count(*) FILTER (WHERE o_orderstatus = 'O') AS rep FROM orders GROUP BY 1),
units AS (SELECT c_custkey AS unit, c_nationkey AS parent, coalesce(pop, 0) AS pop, coalesce(dem, 0) AS dem, coalesce(rep, 0) AS rep FROM customer LEFT JOIN by_unit ON unit = c_custkey),
by_line AS (SELECT o_custkey AS unit, count(*) FILTER (WHERE l_returnflag = 'A') AS dem, count(*) FILTER (WHERE l_returnflag = 'R') AS rep FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
votes_b AS (SELECT c_custkey AS unit, coalesce(dem, 0) AS dem, coalesce(rep, 0) AS rep FROM customer LEFT JOIN by_line ON unit = c_custkey),
assign AS (SELECT p.range AS plan, unit, (((unit + {SHIFT} * p.range) % n.n) * {K} // n.n + 1)::INTEGER AS district FROM units, range({PLANS}) p, n),
raw_edges AS (SELECT least(unit, (unit + 1) % n.n) AS u, greatest(unit, (unit + 1) % n.n) AS v FROM units, n UNION SELECT unit, unit + {WIDTH} FROM units, n WHERE unit + {WIDTH} < n.n),
edges AS (SELECT u, v, CASE WHEN v - u = {WIDTH} OR (v - u = 1 AND u % {WIDTH} <> {WIDTH} - 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS shared_len FROM raw_edges WHERE u <> v),
dist AS (SELECT plan, district, sum(dem)::BIGINT AS dem, sum(rep)::BIGINT AS rep, sum(pop)::BIGINT AS pop FROM assign JOIN units USING (unit) GROUP BY ALL),
sh AS (SELECT *, dem / (dem + rep)::DOUBLE AS share, (sum(dem) OVER (PARTITION BY plan) / (sum(dem + rep) OVER (PARTITION BY plan))::DOUBLE)::DOUBLE AS observed,
  CASE WHEN dem > rep THEN dem - ((dem + rep) // 2 + 1) ELSE dem END AS wd, CASE WHEN rep > dem THEN rep - ((dem + rep) // 2 + 1) ELSE rep END AS wr FROM dist),
ends AS (SELECT a.plan, e.*, a.district AS du, b.district AS dv FROM edges e JOIN assign a ON a.unit = e.u JOIN assign b ON b.unit = e.v AND b.plan = a.plan),
metrics AS (SELECT plan, count(*) AS n_districts, count(*) FILTER (WHERE dem > rep) AS dem_seats, count(*) FILTER (WHERE rep > dem) AS rep_seats, count(*) FILTER (WHERE dem = rep) AS tied_districts,
  sum(dem) / sum(dem + rep)::DOUBLE AS dem_vote_share, (sum(wd - wr)) / sum(dem + rep)::DOUBLE AS efficiency_gap, avg(share) - median(share) AS mean_median, median(share) AS median_share,
  count(*) FILTER (WHERE share < 0.5) AS below, count(*) FILTER (WHERE share > 0.5) AS above, count(*) FILTER (WHERE share BETWEEN 0.45 AND 0.55) AS competitive,
  CASE WHEN count(*) FILTER (WHERE share = 0.5) = 0 AND count(*) FILTER (WHERE share < 0.5) > 0 AND count(*) FILTER (WHERE share > 0.5) > 0 THEN
    2.0 * (atan((2 * avg(share) FILTER (WHERE share > 0.5) - 1) * count(*) / count(*) FILTER (WHERE share > 0.5)) - atan((1 - 2 * avg(share) FILTER (WHERE share < 0.5)) * count(*) / count(*) FILTER (WHERE share < 0.5))) / pi() END AS declination,
  avg(CASE WHEN share + (0.5 - observed) > 0.5 THEN 1.0 WHEN share + (0.5 - observed) = 0.5 THEN 0.5 ELSE 0.0 END) - 0.5 AS partisan_bias
  FROM sh GROUP BY plan),
cuts AS (SELECT plan, count(*) FILTER (WHERE du <> dv) AS cut_edges FROM ends GROUP BY plan),
spread AS (SELECT plan, max(pop) - min(pop) AS spread, min(pop) AS least, max(pop) AS most FROM dist GROUP BY plan),
pieces AS (SELECT plan, parent, count(DISTINCT district) AS districts FROM assign JOIN units USING (unit) GROUP BY ALL),
splits AS (SELECT plan, count(*) FILTER (WHERE districts > 1) AS county_splits, sum(districts)::BIGINT AS split_pieces, sum(districts - 1)::BIGINT AS excess_pieces FROM pieces GROUP BY plan),
ap AS (SELECT a.plan, a.district, count(*)::DOUBLE AS area, 4.0 * count(*) - 2 * coalesce(any_value(i.inner_len), 0.0) AS perimeter FROM assign a LEFT JOIN (SELECT plan, du AS district, sum(shared_len) AS inner_len FROM ends WHERE du = dv GROUP BY ALL) i USING (plan, district) GROUP BY ALL),
ratios AS (SELECT plan, district, 4 * pi() * area / (perimeter * perimeter) AS polsby_popper, perimeter / (2 * sqrt(pi() * area)) AS schwartzberg FROM ap),
shapes AS (SELECT plan, avg(polsby_popper) AS polsby_popper_mean, min(polsby_popper) AS polsby_popper_min, max(polsby_popper) AS polsby_popper_max, avg(schwartzberg) AS schwartzberg_mean, min(schwartzberg) AS schwartzberg_min, max(schwartzberg) AS schwartzberg_max FROM ratios GROUP BY plan)
"""


def r(x: str) -> str:
    """Rounded as the Spark side rounds."""
    return f"round({x}, 9) + 0.0"
