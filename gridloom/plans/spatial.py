"""Queries of regions, filling, regridding, subsets, run trees and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.columns import with_step
from ..operators import fill, mesh, regions, regress, regrid, subset
from ..sources import io
from .base import CELL_REGION, CUBE, CUSTOMERS, EDGES, FIELD, RUNS, Tables, query

_GEO = f"{CUSTOMERS}, {EDGES}"


@query("SELECT cell_id, region_id FROM bridge", ctes=_GEO)
def g_cells_in_polygons(t: Tables) -> DataFrame:
    return regions.cell_region(t.customers, t.polygons)


@query("""SELECT cell_id, region_id FROM customers JOIN (SELECT region_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM corners GROUP BY 1)
ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax""", ctes=_GEO)
def g_cells_in_boxes(t: Tables) -> DataFrame:
    return regions.in_boxes(t.customers, t.polygons).select("cell_id", "region_id")


@query("""d AS (
  SELECT cell_id, region_id, sum(CASE WHEN (y0 > y) != (y1 > y) AND x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min(sqrt(pow(x - x0 - p * (x1 - x0), 2) + pow(y - y0 - p * (y1 - y0), 2))) AS away
  FROM (SELECT *, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)), 0), 1) AS p FROM customers, edge) GROUP BY ALL)
SELECT cell_id, region_id FROM d WHERE inside OR away <= 0.4""", ctes=_GEO)
def g_cells_within_buffer(t: Tables) -> DataFrame:
    return regions.cell_region(t.customers, t.polygons, buffer=0.4)


@query("""s AS (SELECT region_id, sum(x0 * y1 - x1 * y0) AS s, sum((x0 + x1) * (x0 * y1 - x1 * y0)) AS sx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) AS sy FROM edge GROUP BY 1)
SELECT s.region_id, {r:abs(s / 2)} AS area, {r:sx / (3 * s)} AS cx, {r:sy / (3 * s)} AS cy, {r:sqrt(pow(sx / (3 * s) - 5, 2) + pow(sy / (3 * s) - 12, 2))} AS distance, count(c.cell_id) AS n_cells FROM s LEFT JOIN bridge c ON c.region_id = s.region_id GROUP BY ALL""", ctes=_GEO)
def f_area_and_centroid(t: Tables) -> DataFrame:
    n = regions.cell_region(t.customers, t.polygons).groupBy("region_id").agg(F.count("*").alias("n_cells"))
    return regions.areas(t.polygons).join(regions.distances(t.polygons, 5.0, 12.0), "region_id").join(n, "region_id", "left").fillna(0, ["n_cells"])


@query("SELECT region_id, {r:sum(x * 3.5)} AS total, count(*) AS n_cells FROM customers JOIN bridge USING (cell_id) GROUP BY 1", ctes=_GEO)
def g_region_sum(t: Tables) -> DataFrame:
    return regions.region_sum(t.customers, regions.cell_region(t.customers, t.polygons), "cell_id", "x", 3.5)


@query("SELECT region_id, {r:sum(x * (y * 1e6) * 3.15576e7 / 1e12)} AS gt_per_year, count(*) AS n_cells FROM customers JOIN bridge USING (cell_id) GROUP BY 1", ctes=_GEO)
def a_regional_net_melt(t: Tables) -> DataFrame:
    own = t.customers.withColumn("area", F.col("y") * 1e6)
    return regions.net_melt(own, regions.cell_region(t.customers, t.polygons), "cell_id", "x", "area")


@query("SELECT cell_id, {r:max(region_id * 10.0)} AS level FROM bridge GROUP BY 1", ctes=_GEO)
def g_merge_by_priority(t: Tables) -> DataFrame:
    values = t.polygons.select("region_id", (F.col("region_id") * 10.0).alias("level"))
    pieces = regions.paint(regions.cell_region(t.customers, t.polygons), values)
    return regions.merge_by_priority(pieces, t.polygons.select("region_id", F.col("region_id").alias("priority")), "cell_id", "region_id", "level")


@query("SELECT r_name AS name, (row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 1 WHEN 'AFRICA' THEN 2 ELSE 3 END, r_name) - 1)::INT AS priority FROM region")
def u_listed_then_alphabetical(t: Tables) -> DataFrame:
    return regions.listed_then_alphabetical(t.region, ["ASIA", "AFRICA"], "r_name").select(F.col("r_name").alias("name"), F.col("priority").cast("int").alias("priority"))


_ORDERS = """named AS (SELECT * FROM (VALUES (1, 'square'), (2, 'concave'), (3, 'holed'), (4, 'overlap'), (9, 'absent')) AS n(region_id, name)),
shape AS (SELECT region_id, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cy FROM edge GROUP BY 1),
orders_ AS (
  SELECT 'listed' AS kind, region_id, name, row_number() OVER (ORDER BY CASE name WHEN 'overlap' THEN 1 WHEN 'concave' THEN 2 ELSE 3 END, name) - 1 AS priority FROM named
  UNION ALL SELECT 'area', region_id, name, row_number() OVER (ORDER BY coalesce(area, 0), name) - 1 FROM named LEFT JOIN shape USING (region_id)
  UNION ALL SELECT 'distance', region_id, name, row_number() OVER (ORDER BY coalesce(sqrt(pow(cx - 5, 2) + pow(cy - 12, 2)), 1e300) DESC, name) - 1 FROM named LEFT JOIN shape USING (region_id))"""


@query("SELECT kind, cell_id, arg_max(name, priority) AS name, {r:arg_max(region_id * 10.0, priority)} AS level FROM bridge JOIN orders_ USING (region_id) GROUP BY ALL", ctes=f"{_GEO}, {_ORDERS}")
def g_merge_in_three_orders(t: Tables) -> DataFrame:
    regions_ = t.polygons.select("region_id", "name", "rings")
    names = regions_.select("name").unionByName(t.spark.createDataFrame([("absent",)], "name string"))
    pieces = regions.paint(regions.cell_region(t.customers, t.polygons), regions_.select("region_id", "name", (F.col("region_id") * 10.0).alias("level"))).withColumn("label", F.col("name"))
    orders = {"listed": regions.listed_then_alphabetical(names, ["overlap", "concave"]), "area": regions.by_area(names, regions_), "distance": regions.by_distance(names, regions_, 5.0, 12.0)}
    parts = [regions.merge_by_priority(pieces, x, "cell_id", "name", "label", "level").select(F.lit(k).alias("kind"), "cell_id", F.col("label").alias("name"), "level") for k, x in orders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT cell, {r:avg(v)} AS v FROM cube JOIN cell_region USING (cell) GROUP BY 1", ctes=f"{CUBE}, {CELL_REGION}")
def g_merge_pieces(t: Tables) -> DataFrame:
    own = t.cube.join(t.cell_region, "cell").groupBy("cell", "region").agg(F.avg("v").alias("v"))
    pieces = subset.union_all(own.filter("region < 12"), own.filter("region >= 12"))
    return regions.merge_no_conflicts(pieces, "cell", "v")


@query("""SELECT c.cell, c.t, {r:coalesce(CASE WHEN region = 3 THEN v * 2 END, v)} AS v FROM cube c JOIN cell_region USING (cell)""", ctes=f"{CUBE}, {CELL_REGION}")
def g_overlay(t: Tables) -> DataFrame:
    part = t.cube.join(t.cell_region.filter("region = 3"), "cell").select("cell", "t", (F.col("v") * 2).alias("v"))
    return regions.overlay(t.cube, part, ["cell", "t"], "v").select("cell", "t", "v")


_MEAN_FIT = "f AS (SELECT cell, avg(v) AS m, avg(draft) AS d FROM cube GROUP BY 1)"


@query("SELECT cell, t, {r:v - m} AS variability, {r:v - (m + 2 * d)} AS adjusted FROM cube JOIN f USING (cell)", ctes=f"{CUBE}, {_MEAN_FIT}")
def j_cell_arithmetic(t: Tables) -> DataFrame:
    mean = t.cube.groupBy("cell").agg(F.avg("v").alias("m"), F.avg("draft").alias("d"))
    return t.cube.join(mean, "cell").select("cell", "t", (F.col("v") - F.col("m")).alias("variability"), (F.col("v") - (F.col("m") + 2 * F.col("d"))).alias("adjusted"))


@query("SELECT c.cell, g.t, {r:v} AS v FROM (SELECT DISTINCT cell FROM cube) c CROSS JOIN (SELECT DISTINCT t FROM cube) g LEFT JOIN cube USING (cell, t)", ctes=CUBE)
def j_align(t: Tables) -> DataFrame:
    grid = t.cube.select("cell").distinct().crossJoin(t.cube.select("t").distinct())
    return regrid.align(t.cube.select("cell", "t", "v"), grid, ["cell", "t"])


@query("SELECT a.cell, {r:a.v - b.v} AS difference FROM cube a JOIN cube b ON a.cell = b.cell AND a.t = 100 AND b.t = 50", ctes=CUBE)
def j_difference_map(t: Tables) -> DataFrame:
    return regrid.difference(t.cube.filter("t = 100"), t.cube.filter("t = 50"), "cell", "v")


@query("""o AS (SELECT n_nationkey AS region, n_regionkey + 0.5::DOUBLE AS obs_mean, 0.1::DOUBLE * (n_nationkey + 1) AS obs_sigma FROM nation WHERE n_nationkey < 20),
c AS (SELECT region, (t - 36) / 12.0::DOUBLE AS years, avg(v) AS v FROM cube JOIN cell_region USING (cell) GROUP BY region, t)
SELECT region, {r:years} AS years, {r:v} AS v, {r:obs_mean} AS obs_mean, {r:obs_sigma} AS obs_sigma, {r:years * (obs_mean - obs_sigma)} AS obs_low, {r:years * (obs_mean + obs_sigma)} AS obs_high FROM c LEFT JOIN o USING (region)""", ctes=f"{CUBE}, {CELL_REGION}")
def j_observed_bands(t: Tables) -> DataFrame:
    observed = t.nation.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("region"), (F.col("n_regionkey") + 0.5).cast("double").alias("obs_mean"), (0.1 * (F.col("n_nationkey") + 1)).alias("obs_sigma"))
    own = t.cube.join(t.cell_region, "cell").groupBy("region", ((F.col("t") - 36) / 12.0).alias("years")).agg(F.avg("v").alias("v"))
    return regions.observed_bands(own, observed, "region", "years")


@query("SELECT {r:sum(n_regionkey + 0.5::DOUBLE)} AS obs_mean, {r:sqrt(sum(pow(0.1::DOUBLE * (n_nationkey + 1), 2)))} AS obs_sigma FROM nation")
def j_observed_total(t: Tables) -> DataFrame:
    return regions.observed_total(t.nation.select((F.col("n_regionkey") + 0.5).cast("double").alias("obs_mean"), (0.1 * (F.col("n_nationkey") + 1)).alias("obs_sigma")))


@query("SELECT s_suppkey, s_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, s_nationkey::VARCHAR) AS display_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j_display_names(t: Tables) -> DataFrame:
    names = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return regions.display_names(t.supplier.select("s_suppkey", "s_nationkey"), names, "s_nationkey")


_BASIN = """b AS (SELECT l_suppkey AS cell, s_nationkey AS basin, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INT AS t, avg(l_quantity) AS tf, avg(l_discount) AS dt, avg(l_tax) AS off, sum(l_linenumber) % 2 = 0 AS floating
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


@query("""m AS (SELECT t, basin, avg(tf) AS m FROM b GROUP BY ALL)
SELECT cell, t, {r:CASE WHEN floating THEN -(14500.0 * 2.0 / 31556926.0 * 910.0) * (tf + dt) * abs(m + dt) + off ELSE 0 END} AS melt FROM b JOIN m USING (t, basin)""", ctes=_BASIN)
def a_basin_melt(t: Tables) -> DataFrame:
    from ..functions.columns import month_index

    own = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_suppkey").alias("cell"), F.col("s_nationkey").alias("basin"), month_index(F.col("l_shipdate"), 1992).alias("t"))
    own = own.agg(F.avg("l_quantity").alias("tf"), F.avg("l_discount").alias("dt"), F.avg("l_tax").alias("off"), (F.sum("l_linenumber") % 2 == 0).alias("floating"))
    return regions.basin_melt(own, "t", "basin", "tf", "dt", "off", "floating", 14500.0, 2.0).select("cell", "t", "melt")


_GAPPY = "h AS (SELECT (ix // 25)::INT AS region, cell_id, ix, iy, value FROM field WHERE NOT (n % 3 = 0)), cells AS (SELECT (ix // 25)::INT AS region, cell_id, ix, iy FROM field)"
_NEAR = """w AS (SELECT c.region, c.cell_id, arg_min(h.cell_id, (pow(c.ix - h.ix, 2) + pow(c.iy - h.iy, 2), h.iy, h.ix)) AS source FROM cells c JOIN h ON c.region = h.region WHERE c.cell_id NOT IN (SELECT cell_id FROM h) GROUP BY ALL)"""


def _gappy(t: Tables) -> tuple[DataFrame, DataFrame]:
    cells = t.field.select(F.floor(F.col("ix") / 25).cast("int").alias("region"), "cell_id", "ix", "iy", "value", "n")
    return cells.drop("value", "n"), cells.filter("n % 3 <> 0").select("region", "cell_id", "value")


@query("SELECT region, cell_id, source FROM w", ctes=f"{FIELD}, {_GAPPY}, {_NEAR}")
def j_nearest_source(t: Tables) -> DataFrame:
    cells, have = _gappy(t)
    return fill.fill_map(cells, have, "region", "cell_id", "ix", "iy")


@query("""SELECT h.region, h.cell_id, s::INT AS t, {r:h.value + s} AS value FROM h, (SELECT unnest(range(0, 5)) AS s)
UNION ALL SELECT w.region, w.cell_id, s::INT, {r:h.value + s} FROM w JOIN h ON w.source = h.cell_id AND w.region = h.region, (SELECT unnest(range(0, 5)) AS s)""", ctes=f"{FIELD}, {_GAPPY}, {_NEAR}")
def j_fill_over_time(t: Tables) -> DataFrame:
    cells, have = _gappy(t)
    steps = t.spark.range(5).select(F.col("id").cast("int").alias("t"))
    cube = have.crossJoin(steps).select("cell_id", "t", (F.col("value") + F.col("t")).alias("value"))
    return fill.extrapolate(cube, cells.select("cell_id", F.col("region").alias("region_id")), cells, "cell_id", "t", "value").withColumnRenamed("region_id", "region")


@query("""SELECT c.cell_id, {r:min(sqrt(pow(c.x - v.x, 2) + pow(c.y - v.y, 2)))} AS dist FROM customers c, (SELECT DISTINCT x, y FROM corners) v GROUP BY 1""", ctes=_GEO)
def j_distance_to_vertices(t: Tables) -> DataFrame:
    vertices = regions.edges(t.polygons).select(F.col("x0").alias("x"), F.col("y0").alias("y"))
    return fill.distance_to(t.customers, vertices, "cell_id", "x", "y", 2.0)


_TARGETS = "goal AS (SELECT p_partkey AS dst, (p_retailprice % 60) - 3 AS x, (p_size % 13) + 0.3::DOUBLE - 1 AS y FROM part)"


def _targets(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("dst"), (F.col("p_retailprice") % 60 - 3).alias("x"), (F.col("p_size") % 13 + 0.3 - 1).cast("double").alias("y"))


_CORNER = """k AS (SELECT dst, x, y, least(greatest(floor(x), 0), 48)::INT AS i, least(greatest(floor(y), 0), 9)::INT AS j FROM goal),
q AS (SELECT k.*, k.x - i AS a, k.y - j AS b, f00.value AS v00, f10.value AS v10, f01.value AS v01, f11.value AS v11 FROM k
  JOIN field f00 ON f00.ix = i AND f00.iy = j JOIN field f10 ON f10.ix = i + 1 AND f10.iy = j JOIN field f01 ON f01.ix = i AND f01.iy = j + 1 JOIN field f11 ON f11.ix = i + 1 AND f11.iy = j + 1)"""


@query("SELECT dst, {r:(1 - a) * (1 - b) * v00 + a * (1 - b) * v10 + (1 - a) * b * v01 + a * b * v11} AS value FROM q", ctes=f"{FIELD}, {_TARGETS}, {_CORNER}")
def j_bilinear(t: Tables) -> DataFrame:
    return regrid.apply_weights(t.field, regrid.bilinear_weights(_targets(t), "dst", "x", "y", 0.0, 0.0, 1.0, 1.0, 50, 11), "cell_id", "value")


@query("""SELECT dst, {r:CASE WHEN q.x < 0 OR q.y < 0 OR q.x > 49 OR q.y > 10 THEN n.value WHEN a + b <= 1 THEN (1 - a - b) * v00 + a * v10 + b * v01 ELSE (a + b - 1) * v11 + (1 - a) * v01 + (1 - b) * v10 END} AS value
FROM q JOIN field n ON n.ix = least(greatest(floor(q.x + 0.5), 0), 49) AND n.iy = least(greatest(floor(q.y + 0.5), 0), 10)""", ctes=f"{FIELD}, {_TARGETS}, {_CORNER}")
def j_triangles(t: Tables) -> DataFrame:
    return regrid.apply_weights(t.field, regrid.triangle_weights(_targets(t), "dst", "x", "y", 0.0, 0.0, 1.0, 1.0, 50, 11), "cell_id", "value")


@query("""SELECT dst, {r:arg_min(value, (pow(g.x - f.x, 2) + pow(g.y - f.y, 2), f.y, f.x))} AS value FROM goal g, field f GROUP BY 1""", ctes=f"{FIELD}, {_TARGETS}")
def j_nearest_regrid(t: Tables) -> DataFrame:
    return regrid.apply_weights(t.field, regrid.nearest_weights(_targets(t), t.field, "dst", "cell_id", "x", "y", 2.0), "cell_id", "value")


@query("""w AS (SELECT dst, i AS sx, j AS sy, (1 - a) * (1 - b) AS w FROM q UNION ALL SELECT dst, i + 1, j, a * (1 - b) FROM q UNION ALL SELECT dst, i, j + 1, (1 - a) * b FROM q UNION ALL SELECT dst, i + 1, j + 1, a * b FROM q),
s AS (SELECT dst, sum(w * value) FILTER (n % 3 != 0) AS t, coalesce(sum(w) FILTER (n % 3 != 0), 0) AS w FROM w JOIN field ON ix = sx AND iy = sy GROUP BY 1)
SELECT dst, {r:CASE WHEN w > 0.01 THEN t / w END} AS value FROM s""", ctes=f"{FIELD}, {_TARGETS}, {_CORNER}")
def j_renormalised(t: Tables) -> DataFrame:
    weights = regrid.bilinear_weights(_targets(t), "dst", "x", "y", 0.0, 0.0, 1.0, 1.0, 50, 11)
    own = t.field.withColumn("value", F.when(F.col("n") % 3 != 0, F.col("value")))
    return regrid.apply_weights(own, weights, "cell_id", "value", renormalise=0.01)


_MESH = """node AS (SELECT s_suppkey AS id, (s_suppkey % 10) + 0.3::DOUBLE * (s_suppkey // 10) AS x, (s_suppkey // 10)::DOUBLE AS y FROM supplier),
corner AS (SELECT id AS a, id + 1 AS b, id + 10 AS c FROM node WHERE id % 10 < 9 UNION ALL SELECT id + 11, id + 10, id + 1 FROM node WHERE id % 10 < 9),
tri AS (SELECT k.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM corner k JOIN node a ON k.a = a.id JOIN node b ON k.b = b.id JOIN node c ON k.c = c.id),
goal AS (SELECT p_partkey AS dst, (p_retailprice * 7) % 14 + 0.0123 - 1 AS x, (p_size * 3) % (SELECT max(s_suppkey) // 10 + 2 FROM supplier) + 0.371 - 0.5 AS y FROM part),
met AS (SELECT dst, a, b, c, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wa, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wb FROM goal, tri),
inside AS (SELECT dst, min({'a': a, 'b': b, 'c': c, 'wa': wa, 'wb': wb}) AS m FROM met WHERE wa >= -1e-12 AND wb >= -1e-12 AND 1 - wa - wb >= -1e-12 GROUP BY 1)"""


@query("""SELECT dst, unnest([m.a, m.b, m.c]) AS src, {r:unnest([m.wa, m.wb, 1 - m.wa - m.wb])} AS w FROM inside
UNION ALL SELECT dst, arg_min(id, (pow(g.x - n.x, 2) + pow(g.y - n.y, 2), n.y, n.x, n.id)), 1.0 FROM goal g ANTI JOIN inside USING (dst) CROSS JOIN node n GROUP BY dst""", ctes=_MESH)
def j_mesh_triangles(t: Tables) -> DataFrame:
    """Parts in a skewed mesh of triangles between suppliers."""
    k = F.col("s_suppkey")
    nodes = t.supplier.select(k.alias("node"), (k % 10 + 0.3 * F.floor(k / 10)).alias("x"), F.floor(k / 10).cast("double").alias("y"))
    first = nodes.filter("node % 10 < 9")
    corners = first.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"), (F.col("node") + 10).alias("c")).unionByName(first.select((F.col("node") + 11).alias("a"), (F.col("node") + 10).alias("b"), (F.col("node") + 1).alias("c")))
    for c in "abc":
        corners = corners.join(nodes.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)
    rows = t.supplier.agg((F.floor(F.max("s_suppkey") / 10) + 2).alias("rows"))
    goal = t.part.crossJoin(rows).select(F.col("p_partkey").alias("dst"), ((F.col("p_retailprice") * 7) % 14 + 0.0123 - 1).alias("x"), ((F.col("p_size") * 3) % F.col("rows") + 0.371 - 0.5).cast("double").alias("y"))
    return regrid.mesh_weights(goal, corners, nodes, "dst", "node", "x", "y", 3.0)


_OVER = """w AS (SELECT p_partkey AS dst, (p_partkey * 7 + k * k) % (SELECT max(s_suppkey) FROM supplier) + 1 AS src, (k + 1) * 0.25::DOUBLE AS w FROM part, (SELECT unnest(range(3)) AS k)),
f AS (SELECT cell, t, CASE WHEN (cell + t) % 7 <> 0 THEN v END AS v FROM cube)"""


@query("SELECT t, dst, {r:sum(w * v)} AS v, {r:CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 0.5 THEN sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) END} AS mean FROM f JOIN w ON src = cell GROUP BY t, dst", ctes=f"{CUBE}, {_OVER}")
def j_weights_over_times(t: Tables) -> DataFrame:
    """Sparse weights over all times of a cube with gaps, plain and renormalised."""
    field = t.cube.select("cell", "t", F.when((F.col("cell") + F.col("t")) % 7 != 0, F.col("v")).alias("v"))
    cells = t.supplier.agg(F.max("s_suppkey").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    weights = t.part.select("p_partkey", k).crossJoin(cells).select(F.col("p_partkey").alias("dst"), ((F.col("p_partkey") * 7 + F.col("k") * F.col("k")) % F.col("n") + 1).alias("src"), ((F.col("k") + 1) * 0.25).cast("double").alias("w"))
    return regrid.apply_weights_over(field, weights, "cell", "t", "v", more={"mean": 0.5}).select("t", "dst", "v", "mean")


_SCATTERED = """node AS (SELECT s_suppkey AS id, s_acctbal / 1000.0::DOUBLE AS x, (s_suppkey * 7919 % 1009) / 100.0::DOUBLE AS y FROM supplier),
pair AS (SELECT a.id AS a, a.x AS ax, a.y AS ay, b.id AS b, b.x AS bx, b.y AS by_ FROM node a JOIN node b ON a.id < b.id),
three AS (SELECT p.*, c.id AS c, c.x AS cx, c.y AS cy, (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) AS turn FROM pair p JOIN node c ON p.b < c.id),
tri AS (SELECT a, b, c, ax, ay, bx, by_, cx, cy FROM three t WHERE abs(turn) > 1e-9 AND NOT EXISTS (
  SELECT 1 FROM node p WHERE p.id NOT IN (t.a, t.b, t.c) AND sign(turn) * (
    (pow(ax - x, 2) + pow(ay - y, 2)) * ((bx - x) * (cy - y) - (cx - x) * (by_ - y)) - (pow(bx - x, 2) + pow(by_ - y, 2)) * ((ax - x) * (cy - y) - (cx - x) * (ay - y))
    + (pow(cx - x, 2) + pow(cy - y, 2)) * ((ax - x) * (by_ - y) - (bx - x) * (ay - y))) > 0))"""


def _scattered(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") / 1000.0).alias("x"), (F.col("s_suppkey") * 7919 % 1009 / 100.0).alias("y"))


@query("SELECT a, b, c, {r:ax} AS ax, {r:ay} AS ay FROM tri", ctes=_SCATTERED)
def j_delaunay(t: Tables) -> DataFrame:
    """Triangles between suppliers as scattered nodes."""
    return mesh.delaunay(_scattered(t), tile=40).select("a", "b", "c", "ax", "ay")


@query("""SELECT dst, unnest([m.a, m.b, m.c]) AS src, {r:unnest([m.wa, m.wb, 1 - m.wa - m.wb])} AS w FROM inside
UNION ALL SELECT dst, arg_min(id, (pow(g.x - n.x, 2) + pow(g.y - n.y, 2), n.y, n.x, n.id)), 1.0 FROM goal g ANTI JOIN inside USING (dst) CROSS JOIN node n GROUP BY dst""", ctes=_SCATTERED + """,
goal AS (SELECT p_partkey AS dst, (p_retailprice * 7) % 12 + 0.0123 - 1 AS x, (p_size * 3) % 12 + 0.371 - 0.5 AS y FROM part),
met AS (SELECT dst, a, b, c, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wa, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wb FROM goal, tri),
inside AS (SELECT dst, min({'a': a, 'b': b, 'c': c, 'wa': wa, 'wb': wb}) AS m FROM met WHERE wa >= -1e-12 AND wb >= -1e-12 AND 1 - wa - wb >= -1e-12 GROUP BY 1)""")
def j_barycentric_scattered(t: Tables) -> DataFrame:
    """Parts in the triangles between scattered suppliers, outside the hull at the nearest supplier."""
    nodes = _scattered(t)
    goal = t.part.select(F.col("p_partkey").alias("dst"), ((F.col("p_retailprice") * 7) % 12 + 0.0123 - 1).cast("double").alias("x"), ((F.col("p_size") * 3) % 12 + 0.371 - 0.5).cast("double").alias("y"))
    return regrid.mesh_weights(goal, mesh.delaunay(nodes, tile=40), nodes, "dst", "node", "x", "y", 1.0)


@query("""SELECT cell, t, 'melt' AS field, {r:v * 2 + 1} AS value FROM cube UNION ALL SELECT cell, t, 'thickness', {r:greatest(draft - 25, 0)} FROM cube""", ctes=CUBE)
def j_map_fields(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("v", "melt", 2.0, 1.0), ("draft", "thickness", 1.0, -25.0), ("absent", "other", 1.0, 0.0)], "source string, field string, scale double, offset double")
    return regrid.map_fields(t.cube, mapping, ["cell", "t"])


_LAYERS = """lay AS (SELECT l_orderkey, l_linenumber, q / sum(q) OVER (PARTITION BY l_orderkey) AS frac, l_extendedprice
  FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL))"""


def _layers(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    own = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), F.avg("l_extendedprice").alias("l_extendedprice"))
    frac = F.col("q") / F.sum("q").over(Window.partitionBy("l_orderkey"))
    return own.select("l_orderkey", "l_linenumber", frac.alias("frac"), "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, {r:b - frac} AS top, {r:b - 0.5 * frac} AS centre, {r:b} AS bottom
FROM (SELECT *, sum(frac) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS b FROM lay)""", ctes=_LAYERS)
def j_sigma_levels(t: Tables) -> DataFrame:
    return regrid.sigma_levels(_layers(t), "l_orderkey", "l_linenumber", "frac").select("l_orderkey", "l_linenumber", "top", "centre", "bottom")


@query("""s AS (SELECT l_orderkey, b - 0.5 * frac AS c, l_extendedprice AS v FROM (SELECT *, sum(frac) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS b FROM lay)),
g AS (SELECT l_orderkey, c AS c0, v AS v0, lead(c) OVER w AS c1, lead(v) OVER w AS v1, lag(c) OVER w IS NULL AS first FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY c))
SELECT l_orderkey, {r:target} AS target, {r:CASE WHEN c1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * least(greatest((target - c0) / (c1 - c0), 0), 1) END} AS l_extendedprice
FROM g, (VALUES (0.1::DOUBLE), (0.5), (0.9)) AS x(target) WHERE target >= c0 AND (target < c1 OR c1 IS NULL) OR first AND target < c0""", ctes=_LAYERS)
def j_interpolate_layers(t: Tables) -> DataFrame:
    own = regrid.sigma_levels(_layers(t), "l_orderkey", "l_linenumber", "frac")
    goal = t.spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "target double")
    return regrid.interpolate_layers(own, "l_orderkey", "centre", "l_extendedprice", goal)


@query("SELECT cell, t, {r:v} AS v FROM cube WHERE t BETWEEN 40 AND 60", ctes=CUBE)
def p_range(t: Tables) -> DataFrame:
    return subset.by_range(t.cube, "t", 40, 60).select("cell", "t", "v")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1995 AND year(o_orderdate) <= 1998")
def p_years(t: Tables) -> DataFrame:
    return subset.by_years(t.orders, "o_orderdate", 1995, 1998).select("o_orderkey")


@query("s AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::INT AS t_idx FROM (SELECT DISTINCT t FROM cube)) SELECT cell, t, t_idx FROM cube JOIN s USING (t) WHERE t_idx >= 10 AND t_idx < 20", ctes=CUBE)
def p_steps(t: Tables) -> DataFrame:
    return subset.by_steps(t.cube, "t", 10, 20).select("cell", "t", "t_idx")


@query("SELECT (row_number() OVER (ORDER BY t) - 1)::INT AS t_idx, t FROM (SELECT DISTINCT t FROM cube)", ctes=CUBE)
def p_step_numbers(t: Tables) -> DataFrame:
    return with_step(t.cube, "t").select("t_idx", "t").distinct()


@query("SELECT cell_id, x AS x1, y AS y1, {r:CASE WHEN n % 3 = 0 THEN 0 ELSE value END} AS value FROM field", ctes=FIELD)
def p_rename_and_fill(t: Tables) -> DataFrame:
    own = t.field.select("cell_id", "x", "y", F.when(F.col("n") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return subset.rename_and_fill(own)


@query("SELECT l_orderkey, l_linenumber, {r:CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END} AS l_extendedprice FROM lineitem")
def p_where(t: Tables) -> DataFrame:
    return subset.where(t.lineitem, "l_extendedprice", F.col("l_discount") > 0.05, 0.0).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT 'part' AS kind, c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%r#%1' || '%' AND c_nationkey BETWEEN 3 AND 20
UNION ALL SELECT 'whole', c_custkey, c_name FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)""")
def p_regions(t: Tables) -> DataFrame:
    part = subset.regions_named(subset.regions_named(subset.regions_between(t.customer, "c_nationkey", 3, 20), "c_name", "R#"), "c_name", "1")
    first = t.customer.agg(F.min("c_name")).first()[0]
    whole = subset.regions_named(t.customer, "c_name", first, exact=True)
    return part.select(F.lit("part").alias("kind"), "c_custkey", "c_name").unionByName(whole.select(F.lit("whole").alias("kind"), "c_custkey", "c_name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax != 0)")
def p_active_cells(t: Tables) -> DataFrame:
    return subset.active_cells(t.lineitem, "l_orderkey", "l_tax").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey AS cell, ((p_size + 3) & 4) = 0 AS grounded_now, ((p_size + 3) & 4) = 4 AS floating_now, ((p_size + 3) & 4) = 4 AND (p_size & 4) = 0 AS newly_floating FROM part")
def p_newly_floating(t: Tables) -> DataFrame:
    early = t.part.select(F.col("p_partkey").alias("cell"), F.col("p_size").alias("mask"))
    return subset.newly_floating(early, early.withColumn("mask", F.col("mask") + 3), "cell", "mask")


@query("SELECT c_custkey, c_acctbal > -(1028.0::DOUBLE / 910.0::DOUBLE) * (c_nationkey * 100 - 1500) AS grounded, c_acctbal > 0 AS extent FROM customer")
def p_masks_from_thickness(t: Tables) -> DataFrame:
    grounded, extent = scalars.floating("c_acctbal", F.col("c_nationkey") * 100 - 1500)
    return t.customer.select("c_custkey", grounded.alias("grounded"), extent.alias("extent"))


@query("SELECT p_partkey, (p_size & 4) = 4 AS floating, (p_size & 2) = 2 AS dynamic FROM part")
def p_bits(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalars.has_bits("p_size", 4).alias("floating"), scalars.has_bits("p_size", 2).alias("dynamic"))


def _tree(t: Tables) -> DataFrame:
    return t.orders.select(F.concat(F.lit("E"), F.substring("o_orderpriority", 1, 1)).alias("ensemble"), F.concat(F.lit("EM"), F.month("o_orderdate").cast("string")).alias("experiment"))


_TREE = "tree AS (SELECT DISTINCT 'E' || o_orderpriority[1] AS ensemble, 'EM' || month(o_orderdate) AS experiment FROM orders)"


@query("SELECT ensemble, array_to_string(list_sort(list(experiment)), ',') AS experiments FROM tree GROUP BY 1", ctes=_TREE)
def s_experiments(t: Tables) -> DataFrame:
    return io.experiments(_tree(t)).select("ensemble", F.array_join("experiments", ",").alias("experiments"))


@query("SELECT ensemble, experiment, ensemble || ':' || experiment AS display_name FROM tree WHERE experiment = 'EM3' OR ensemble = 'E1' AND experiment LIKE 'EM1%' OR ensemble LIKE 'E_' AND experiment = 'EM7'", ctes=_TREE)
def s_select_runs(t: Tables) -> DataFrame:
    return io.select_runs(_tree(t), "EM3, E1:EM1*, E?:EM7")


@query("SELECT experiment, arg_min(ensemble, (base_rank, ensemble)) AS ensemble, min(base_rank) AS base_rank FROM (SELECT *, (ensemble[2])::INT % 3 AS base_rank FROM tree WHERE NOT (ensemble = 'E3' AND experiment = 'EM5')) GROUP BY 1", ctes=_TREE)
def s_first_base(t: Tables) -> DataFrame:
    own = _tree(t).distinct().filter("NOT (ensemble = 'E3' AND experiment = 'EM5')").withColumn("base_rank", F.substring("ensemble", 2, 1).cast("int") % 3)
    return io.first_base(own)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def s_remaining_work(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return io.remaining(t.customer.select("c_custkey"), done, "c_custkey")


@query("SELECT l_suppkey AS name FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 != 0)")
def u_unknown_names(t: Tables) -> DataFrame:
    known = t.supplier.filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("name"))
    return subset.unknown_names(t.lineitem.select(F.col("l_suppkey").alias("name")), known, "name")


@query("SELECT DISTINCT s_nationkey AS name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def u_common_names(t: Tables) -> DataFrame:
    return subset.common_names(t.supplier.select("s_nationkey"), t.customer.select("c_nationkey"), t.nation.filter("n_regionkey < 3").select("n_nationkey"))


@query("SELECT ix, iy, n, a, b FROM (SELECT ix, iy, n, 'low' AS a, NULL AS b FROM field WHERE ix < 10 UNION ALL SELECT ix, iy, n, NULL, 'high' FROM field WHERE ix >= 40)", ctes=FIELD)
def u_union_all(t: Tables) -> DataFrame:
    own = t.field.select("ix", "iy", "n")
    return subset.union_all(own.filter("ix < 10").withColumn("a", F.lit("low")), own.filter("ix >= 40").withColumn("b", F.lit("high")))


@query("""o AS (SELECT *, l_returnflag AS region, l_quantity * 40 AS h FROM lineitem), m AS (SELECT region, avg(h) AS mu, stddev_pop(h) AS sd FROM o GROUP BY 1)
SELECT l_orderkey, l_linenumber, {r:pow(h, 0.25)} AS draft, CASE WHEN h > 1000 THEN 1.0::DOUBLE ELSE 0.0 END AS threshold, {r:pow(1 / (l_tax + 1e-6), 0.5)} AS distance,
  {r:exp(-0.5 * pow((h - 800) / 320, 2))} AS gauss, {r:exp(-0.5 * pow((h - mu) / sd, 2))} AS gauss_own, {r:1 / (1 + exp(-0.1 * (h - 900)))} AS sigmoid, {r:1 / (1 + exp(-0.005 * (h - mu)))} AS sigmoid_own,
  {r:1 / (1 + exp(-0.005 * (h - mu))) / (l_tax + 1e-6)} AS sigmoid_distance, {r:pow(h, 0.25) / (l_tax + 1e-6)} AS draft_distance,
  {r:CASE WHEN l_discount > 0 THEN pow(abs(l_discount - 0.05), 2) * pow(h, 0.5) * pow(1 / (l_tax + 1e-6), 0.25) * exp(-0.5 * pow((h - 1200) / 300, 2)) * CASE WHEN h > 1000 THEN 1 ELSE 0 END * CASE WHEN h > 1500 THEN 1 ELSE 0 END END} AS combined
FROM o JOIN m USING (region)""")
def f_weights(t: Tables) -> DataFrame:
    own = t.lineitem.withColumns({"region": F.col("l_returnflag"), "h": F.col("l_quantity") * 40, "m": F.when(F.col("l_discount") > 0, F.col("l_discount") - 0.05)})
    q, p = "h", "l_extendedprice"
    own = regress.with_moments(own, "region", q)
    return own.select(
        "l_orderkey", "l_linenumber",
        scalars.draft_weight(p, q, 0.25).alias("draft"), scalars.threshold_weight(q).alias("threshold"), scalars.inverse_distance_weight("l_tax", 0.5).alias("distance"),
        scalars.gaussian_weight(q, 800.0, 320.0).alias("gauss"), scalars.gaussian_weight_of(q).alias("gauss_own"), scalars.sigmoid_weight(q, 900.0, 0.1).alias("sigmoid"), scalars.sigmoid_weight_of(q).alias("sigmoid_own"),
        scalars.product(scalars.sigmoid_weight_of(q), scalars.inverse_distance_weight("l_tax")).alias("sigmoid_distance"),
        scalars.product(scalars.draft_weight(p, q, 0.25), scalars.inverse_distance_weight("l_tax")).alias("draft_distance"), scalars.combined_weight("m", q, "l_tax", F.lit(1500.0), 2, 0.5, 0.25).alias("combined"),
    )


@query("""SELECT l_orderkey, l_linenumber, {r:CASE WHEN q < 20 THEN 0 ELSE 0.4 * q + 2 END} AS zero, {r:CASE WHEN q < 20 THEN 3.5 ELSE 0.4 * q + 2 END} AS mean, {r:CASE WHEN q < 20 THEN 10 ELSE 0.4 * q + 2 END} AS threshold,
  {r:CASE WHEN l_linenumber = 1 OR q < 20 THEN 7 ELSE 2 + 0.4 * q END} AS stored, {r:CASE WHEN q < 20 THEN 0 ELSE greatest(0.4 * q - 10, 0) END} AS floored FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def f_predictions(t: Tables) -> DataFrame:
    lit = lambda v: F.lit(float(v))
    three = scalars.piecewise_three("l_quantity", lit(20), lit(0.4), lit(2), lit(3.5))
    stored = scalars.from_parameters("l_quantity", lit(20), lit(7), F.col("l_linenumber"), lit(2), lit(0.4))
    floored = scalars.from_model("l_quantity", lit(20), lit(0.4), lit(-10), F.lit("linear"))
    return t.lineitem.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in three.items()), stored.alias("stored"), floored.alias("floored"))


@query("""SELECT c_custkey, {r:b * (910.0 / 31536000) * 1e6} AS flux, {r:b * 31536000 / 910} AS melt, {r:b * 1e12 / 3.62e14 * 910 / 1028 * 1000} AS sea_level, {r:b * 365.25 * 86400 / 1e12 * 1e6} AS gt,
  {r:sqrt(b * b + c_nationkey * c_nationkey) * 31536000 / 1e6} AS speed, {r:CASE WHEN b > 0 THEN log10(b) END} AS log, {r:b * 910} AS kg FROM (SELECT *, c_acctbal AS b FROM customer)""")
def f_units(t: Tables) -> DataFrame:
    b = "c_acctbal"
    return t.customer.select(
        "c_custkey", (scalars.melt_to_flux(b) * 1e6).alias("flux"), scalars.flux_to_melt(b).alias("melt"), scalars.flotation_to_sea_level(b, 1e12).alias("sea_level"), (scalars.kg_s_to_gt_year(b) * 1e6).alias("gt"),
        (scalars.speed(b, "c_nationkey") / 1e6).alias("speed"), scalars.log10_or_null(b).alias("log"), scalars.scaled(F.lit("totalIceVolume"), b, "kg").alias("kg"),
    )


@query("""SELECT c_custkey, name, unit, {r:c_acctbal * CASE WHEN name ILIKE '%volume%' THEN CASE unit WHEN 'm3' THEN 1 WHEN 'kg' THEN 910 ELSE 910 / 1e12 * 1e9 END WHEN name ILIKE '%area%' THEN 1e-6 * CASE unit WHEN 'Gt' THEN 1e9 ELSE 1 END
  WHEN name ILIKE '%flux%' OR name ILIKE '%massbal%' THEN CASE unit WHEN 'm3' THEN 1 / 910.0::DOUBLE WHEN 'kg' THEN 1 ELSE 1e-12 * 1e9 END ELSE CASE unit WHEN 'Gt' THEN 1e9 ELSE 1 END END} AS value
FROM customer, (VALUES ('totalIceVolume'), ('groundedIceArea'), ('totalCalvingFlux'), ('totalFloatingBasalMassBal'), ('deltat')) AS n(name), (VALUES ('m3'), ('kg'), ('Gt')) AS u(unit)""")
def f_scaled_statistics(t: Tables) -> DataFrame:
    """Every kind of statistic in every unit; those of Gt times 1e9, so that digits are left to compare."""
    names = t.spark.createDataFrame([(x,) for x in ("totalIceVolume", "groundedIceArea", "totalCalvingFlux", "totalFloatingBasalMassBal", "deltat")], "name string")
    own = t.customer.select("c_custkey", "c_acctbal").crossJoin(names)
    parts = [own.select("c_custkey", "name", F.lit(u).alias("unit"), (scalars.scaled("name", "c_acctbal", u) * (1e9 if u == "Gt" else 1.0)).alias("value")) for u in ("m3", "kg", "Gt")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_custkey, {r:c_acctbal} AS there_and_back, {r:c_acctbal / (1 / 3.62e14 * 910 / 1028 * 1000) / 1e12} AS volume FROM customer")
def f_sea_level_back(t: Tables) -> DataFrame:
    back = scalars.sea_level_to_flotation(scalars.flotation_to_sea_level("c_acctbal", 1e12), 1e12)
    return t.customer.select("c_custkey", back.alias("there_and_back"), (scalars.sea_level_to_flotation("c_acctbal") / 1e12).alias("volume"))


@query("""SELECT p_partkey, regexp_replace(trim(p_type), '[^A-Za-z0-9]', '', 'g') AS plain, nullif(regexp_extract(p_name || '_2015_' || p_partkey, '([0-9]{4})', 1), '')::INT AS year,
  rpad(printf('%04d-07-01_00:00:00', p_size), 64, ' ') AS stamp, p_size AS member FROM part""")
def f_text(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit("_2015_"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", scalars.plain_name("p_type").alias("plain"), scalars.year_in(name).alias("year"), scalars.stamp("p_size").alias("stamp"), scalars.member_in(F.concat(F.lit("EM"), F.col("p_size").cast("string")), "EM").alias("member"))


def _stereo_sql() -> str:
    e, a, phi_c = 0.0818191908426215, 6378137.0, math.radians(-71)
    s = math.sin(phi_c)
    tc = math.tan(math.pi / 4 + phi_c / 2) * ((1 - e * s) / (1 + e * s)) ** (-e / 2)
    mc = math.cos(phi_c) / math.sqrt(1 - (e * s) ** 2)
    return f"""p AS (SELECT c_custkey, radians(c_nationkey * 14.0 - 170) AS lon, radians(-60 - (c_custkey % 30)) AS lat FROM customer),
q AS (SELECT *, {a * mc / tc!r} * tan(pi() / 4 + lat / 2) * pow((1 - {e} * sin(lat)) / (1 + {e} * sin(lat)), {-e / 2!r}) AS rho FROM p)
SELECT c_custkey, {{r:rho * sin(lon)}} AS x, {{r:rho * cos(lon)}} AS y, CASE WHEN rho * cos(lon) > 1e6 THEN 'north' WHEN rho * sin(lon) > 0 THEN 'east' ELSE 'other' END AS sector FROM q"""


@query(_stereo_sql(), digits=2)
def f_polar_plane(t: Tables) -> DataFrame:
    x, y = scalars.polar_stereographic(F.col("c_nationkey") * 14.0 - 170, -60 - F.col("c_custkey") % 30)
    own = t.customer.select("c_custkey", x.alias("x"), y.alias("y"))
    return own.withColumn("sector", scalars.sector("x", "y", [("north", "{y} > 1e6"), ("east", "{x} > 0")]))


@query("SELECT t, member, {r:v} AS v FROM runs WHERE t BETWEEN 40 AND 60", digits=2, ctes=RUNS)
def p_run_window(t: Tables) -> DataFrame:
    return subset.by_range(t.runs, "t", 40, 60)
