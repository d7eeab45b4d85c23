"""The driver's tables in the roles of the library: cube, points, fields, runs; and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder; roles are made from them when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cube(self) -> DataFrame:
        """(cell, t, month, v, draft): a supplier's month; t counts months from January 1992."""
        t = month_index(F.col("l_shipdate"), 1992)
        own = self.lineitem.select(F.col("l_suppkey").alias("cell"), t.alias("t"), "l_extendedprice", "l_quantity")
        cube = own.groupBy("cell", "t").agg(F.avg("l_extendedprice").alias("v"), F.avg("l_quantity").alias("draft"))
        return cube.select("cell", "t", F.pmod("t", F.lit(12)).alias("month"), "v", "draft")

    @cached_property
    def cell_region(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("region"))

    @cached_property
    def points(self) -> DataFrame:
        """(region, draft, melt): orders; the melt follows the draft."""
        own = self.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("draft"), F.sum("l_extendedprice").alias("melt"))
        orders = self.orders.select("o_orderkey", F.col("o_orderpriority").alias("region"))
        return own.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("region", "draft", (F.col("melt") / 1000.0).alias("melt"), F.col("l_orderkey").alias("point"))

    @cached_property
    def bent(self) -> DataFrame:
        """(region, draft, melt): a flat part up to 25 and a line beyond."""
        melt = 5 + 0.4 * F.greatest(F.col("l_quantity") - 25, F.lit(0.0)) + F.col("l_discount")
        return self.lineitem.select(F.col("l_returnflag").alias("region"), F.col("l_quantity").alias("draft"), melt.alias("melt"), "l_orderkey", "l_linenumber")

    @cached_property
    def noise(self) -> DataFrame:
        return self.lineitem.select(F.col("l_returnflag").alias("region"), F.col("l_quantity").alias("draft"), (F.col("l_extendedprice") / 1000.0).alias("melt"))

    @cached_property
    def runs(self) -> DataFrame:
        """(member, t, v): monthly order value by priority."""
        t = month_index(F.col("o_orderdate"), 1992)
        return self.orders.groupBy(F.col("o_orderpriority").alias("member"), t.alias("t")).agg(F.sum("o_totalprice").alias("v"))

    @cached_property
    def field(self) -> DataFrame:
        """(ix, iy, cell_id, x, y, value): counts of lines by quantity and discount, a 50 x 11 grid."""
        own = self.lineitem.groupBy((F.col("l_quantity") - 1).cast("int").alias("ix"), F.round(F.col("l_discount") * 100).cast("int").alias("iy")).agg(F.avg("l_extendedprice").alias("value"), F.count("*").alias("n"))
        return own.select("ix", "iy", (F.col("iy") * 50 + F.col("ix")).cast("long").alias("cell_id"), F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "value", "n")

    @cached_property
    def polygons(self) -> DataFrame:
        """Four polygons over (account balance / 1000, nation): a square, a concave one, one with a hole, one that overlaps."""
        ring = lambda *p: [[{"x": float(a), "y": float(b)} for a, b in p]]
        hole = [*ring((0, 0), (9, 0), (9, 20), (0, 20)), *ring((3, 5), (3, 15), (6, 15), (6, 5))]
        rows = [(1, "square", ring((0.5, 2.5), (4.5, 2.5), (4.5, 9.5), (0.5, 9.5))), (2, "concave", ring((-1, 0), (9.9, 0), (9.9, 24.5), (5, 8.2), (-1, 24.5))), (3, "holed", hole), (4, "overlap", ring((2.25, 6.5), (7.75, 6.5), (7.75, 18.5), (2.25, 18.5)))]
        from ..operators.regions import with_bounds

        return with_bounds(self.spark.createDataFrame(rows, "region_id int, name string, rings array<array<struct<x:double,y:double>>>"))

    @cached_property
    def customers(self) -> DataFrame:
        """(cell_id, x, y): customers as points of a plane."""
        return self.customer.select(F.col("c_custkey").alias("cell_id"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_nationkey") + 0.25).cast("double").alias("y"))


def r(column: str | Column, digits: int = 4) -> Column:
    """Rounded for comparison, without a negative zero. A part of the last digit is added first, because averages of cents
    often lie just between two digits, where the last bit of a sum would decide."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(nudge(digits)), digits) + F.lit(0.0)


def nudge(digits: int) -> float:
    return 0.0313 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with every double rounded."""
    return df.select(*(r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, digits: int = 4, ctes: str = ""):
    """Registers a function of Tables under its name; sql is what its result is held against. ``{r:x}`` stands for x rounded,
    in the SQL."""
    import re

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)), digits)
        if sql is not None:
            own = re.sub(r"\{r:((?:[^{}]|\{[^{}]*\})*)\}", lambda m: f"(round(({m[1]})::DOUBLE + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0)", sql)
            body = own.strip()
            if not body.startswith("SELECT"):  # it begins with tables of its own
                SQL[f.__name__] = f"WITH {ctes}, {body}" if ctes else f"WITH {body}"
            else:
                SQL[f.__name__] = f"WITH {ctes} {body}" if ctes else body
        return f

    return add


CUBE = """cube AS (
  SELECT l_suppkey AS cell, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INT AS t, ((month(l_shipdate) - 1) % 12)::INT AS month,
    avg(l_extendedprice) AS v, avg(l_quantity) AS draft FROM lineitem GROUP BY ALL)"""
CELL_REGION = "cell_region AS (SELECT s_suppkey AS cell, s_nationkey AS region FROM supplier)"
POINTS = """points AS (
  SELECT o_orderpriority AS region, draft, melt / 1000.0 AS melt, l_orderkey AS point
  FROM (SELECT l_orderkey, sum(l_quantity) AS draft, sum(l_extendedprice) AS melt FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)"""
BENT = "bent AS (SELECT l_returnflag AS region, l_quantity AS draft, 5 + 0.4::DOUBLE * greatest(l_quantity - 25, 0) + l_discount AS melt, l_orderkey, l_linenumber FROM lineitem)"
NOISE = "noise AS (SELECT l_returnflag AS region, l_quantity AS draft, l_extendedprice / 1000.0 AS melt FROM lineitem)"
RUNS = """runs AS (SELECT o_orderpriority AS member, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::INT AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"""
FIELD = """field AS (
  SELECT ix, iy, (iy * 50 + ix)::BIGINT AS cell_id, ix::DOUBLE AS x, iy::DOUBLE AS y, value, n FROM (
    SELECT (l_quantity - 1)::INT AS ix, round(l_discount * 100)::INT AS iy, avg(l_extendedprice) AS value, count(*) AS n FROM lineitem GROUP BY ALL))"""
CUSTOMERS = "customers AS (SELECT c_custkey AS cell_id, c_acctbal / 1000.0 AS x, c_nationkey + 0.25::DOUBLE AS y FROM customer)"
EDGES = """corners(region_id, ring, i, x, y) AS (VALUES
  (1, 0, 0, 0.5::DOUBLE, 2.5::DOUBLE), (1, 0, 1, 4.5, 2.5), (1, 0, 2, 4.5, 9.5), (1, 0, 3, 0.5, 9.5),
  (2, 0, 0, -1, 0), (2, 0, 1, 9.9, 0), (2, 0, 2, 9.9, 24.5), (2, 0, 3, 5, 8.2), (2, 0, 4, -1, 24.5),
  (3, 0, 0, 0, 0), (3, 0, 1, 9, 0), (3, 0, 2, 9, 20), (3, 0, 3, 0, 20), (3, 1, 0, 3, 5), (3, 1, 1, 3, 15), (3, 1, 2, 6, 15), (3, 1, 3, 6, 5),
  (4, 0, 0, 2.25, 6.5), (4, 0, 1, 7.75, 6.5), (4, 0, 2, 7.75, 18.5), (4, 0, 3, 2.25, 18.5)),
edge AS (
  SELECT a.region_id, a.ring, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
  FROM (SELECT *, count(*) OVER (PARTITION BY region_id, ring) AS n FROM corners) a JOIN corners b ON a.region_id = b.region_id AND a.ring = b.ring AND b.i = (a.i + 1) % a.n),
bridge AS (
  SELECT cell_id, region_id FROM customers, edge
  GROUP BY ALL HAVING sum(CASE WHEN (y0 > y) != (y1 > y) AND x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) THEN 1 ELSE 0 END) % 2 = 1)"""
