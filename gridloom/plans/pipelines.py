"""The three whole jobs: components of a cube, parameters of the shelves, forcing realisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.columns import month_of
from ..operators import fill, generator, regions, regress, stats, subset
from ..operators import timeseries as ts
from ..sources.shared import kept, stored
from ..streaming import means
from .base import CELL_REGION, CUBE, Tables, query


def decomposed(cube: DataFrame, bridge: DataFrame, grid: DataFrame, cell: str, t: str, v: str, draft: str, start: int, end: int) -> DataFrame:
    """(region_id, cell, t, seasonality, variability) with gaps filled from the nearest cell of the region.

    Cut the years, remove each cell's trend and season, regress the time means on draft per region, subtract the fit. One
    window shuffle by cell carries everything up to the fill; the fit is a row a cell. The flat series are written once, for
    means and components read them; both components have the same gaps, so one fill moves both."""
    own = subset.by_range(cube, t, start, end).withColumn("__month", month_of(t))
    flat = ts.deseasonalise(ts.detrend(own, cell, t, v, "__d"), cell, "__month", "__d", "__s")
    flat = stored(flat.select(cell, t, draft, "__d", "__s"), "components")
    mean = stats.time_mean(flat, cell, "__s", draft).join(bridge, cell)
    fit = regress.with_fit(mean, regress.draft_regression(mean, "region_id", draft, "__s"), "region_id", draft, "__f").select(cell, "__f").groupBy(cell).agg(F.avg("__f").alias("__f"))
    both = F.struct((F.col("__d") - F.col("__s")).alias("seasonality"), (F.col("__s") - F.coalesce("__f", F.lit(0.0))).alias("variability"))
    parts = flat.join(fit, cell, "left").select(cell, t, F.when(F.col("__s").isNotNull(), both).alias("value"))  # __s is null where __d is
    return fill.extrapolate(stored(parts, "components"), bridge, grid, cell, t, "value").select("region_id", cell, t, "value.*")


def components(*args, **named) -> tuple[DataFrame, DataFrame]:
    """(seasonality, variability) of ``decomposed``, each (region_id, cell, t, value)."""
    full = stored(decomposed(*args, **named), "components")
    return tuple(full.select("region_id", *(c for c in full.columns if c not in ("region_id", "seasonality", "variability")), F.col(name).alias("value")) for name in ("seasonality", "variability"))


def shelf_grid(points: DataFrame, bridge: DataFrame, priorities: DataFrame, cell: str, t: str, draft: str, melt: str) -> DataFrame:
    """(cell, the five parameters): each region's parameters on its cells, the higher priority where regions overlap."""
    mean = stats.time_mean(points, cell, draft, melt).join(bridge, cell)
    params = regress.shelf_parameters(mean, "region_id", draft, melt, noisy="mean")
    names = ["minDraft", "constantValue", "paramType", "alpha0", "alpha1"]
    painted = regions.paint(bridge, params.select("region_id", *names))
    merged = regions.merge_by_priority(painted, priorities, cell, "region_id", *names)
    return subset.rename_and_fill(merged)


def forcings(variability: DataFrame, seasonality: DataFrame, cell: str, t: str, n: int, seed: int, modes: int | None = None) -> DataFrame:
    """(realization, t, cell, value): normalise, decompose, randomise phases, rebuild, add the season."""
    own = ts.normalise(variability, cell, "value", "z")
    loadings, scores, _ = generator.eof(own.select(cell, t, "z"), cell, t, "z", modes)
    moments = own.select(cell, "value_mean", "value_std").distinct()
    drawn = generator.phase_randomised(scores, t, n, seed)
    return generator.realisations(loadings, drawn, moments, seasonality.withColumnRenamed("value", "season"), cell, t, "value_mean", "value_std", "season")


def analyse_regions(points: DataFrame, key: str, draft: str, melt: str, rule: str | regress.Assessment = "balanced", n_bins: int = 50, min_points: int = 10, min_range: float = 100.0, penalty: float = 10.0) -> DataFrame:
    """One record a region: assessment, threshold (the median draft where bins are too few or the drafts lie closer than
    min_range), strategy, skill, ranges."""
    gate = regress.assess(points, key, draft, melt, rule)
    ranges = ((F.max(draft) - F.min(draft)).alias("__range"), (F.max(melt) - F.min(melt)).alias("melt_range"))
    whole = stats.with_quantiles(points, key, draft, (0.5,), ranges, True).withColumn("__mid", F.col("__q")[0])
    at = regress.thresholds(regress.binned(points, key, draft, melt, n_bins, min_points), key, penalty=penalty, min_size=3)
    at = kept(whole.join(at, key, "left").select(key, "melt_range", F.when(F.col("__range") >= min_range, F.coalesce("threshold", "__mid")).otherwise(F.col("__mid")).alias("threshold")), "regions")
    fits = kept(regress.strategy_fit(gate, regress.piecewise_fit(points, at, key, draft, melt), key), "regions")
    predicted = scalars.from_strategy(draft, "threshold", "slope", "intercept", "model_type")
    skill = regress.skill(points.join(fits, key).withColumn("__p", predicted), key, melt, "__p").select(key, F.col("r2").alias("skill_r2"), "rmse", "mae", "bias")
    return gate.select(key, "n", "correlation", "r2", "is_meaningful", "category", "confidence", "draft_range").join(at.select(key, "melt_range"), key).join(fits, key).join(skill, key, "left")


def _grid(t: Tables) -> tuple[DataFrame, DataFrame]:
    bridge = t.supplier.select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("region_id"))
    grid = t.supplier.select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") % 10).cast("int").alias("ix"), F.floor(F.col("s_suppkey") / 10).cast("int").alias("iy"))
    return bridge, grid


# the trend and season of each cell, the fit of the cells' means on draft per region, and the nearest cell of the region for gaps
_COMPONENTS = """own AS (SELECT cell, t, month, draft, v - coalesce(regr_slope(v, t) OVER c * (t - regr_avgx(v, t) OVER c), 0) AS d FROM cube WHERE t BETWEEN 40 AND 111 WINDOW c AS (PARTITION BY cell)),
flat AS (SELECT *, d - avg(d) OVER (PARTITION BY cell, month) + avg(d) OVER (PARTITION BY cell) AS s FROM own),
mean AS (SELECT cell, first(region) AS region, avg(s) AS s, avg(draft) AS draft FROM flat JOIN cell_region USING (cell) GROUP BY 1),
line AS (SELECT region, regr_slope(s, draft) AS a, regr_intercept(s, draft) AS b FROM mean GROUP BY 1),
part AS (SELECT m.region, f.cell, t, d - f.s AS seasonality, f.s - coalesce(a * m.draft + b, 0) AS variability FROM flat f JOIN mean m USING (cell) JOIN line USING (region)),
place AS (SELECT s_suppkey AS cell, s_nationkey AS region, (s_suppkey % 10)::INT AS ix, (s_suppkey // 10)::INT AS iy FROM supplier),
gap AS (SELECT p.*, x.t FROM place p JOIN (SELECT DISTINCT region, t FROM part) x USING (region) ANTI JOIN part q ON q.cell = p.cell AND q.t = x.t),
source AS (SELECT g.cell, g.t, g.region, arg_min(p.cell, (pow(g.ix - p.ix, 2) + pow(g.iy - p.iy, 2), p.iy, p.ix)) AS source FROM gap g JOIN part q ON q.region = g.region AND q.t = g.t JOIN place p ON p.cell = q.cell GROUP BY ALL)"""


@query("""SELECT region AS region_id, cell, t, {r:seasonality} AS seasonality, {r:variability} AS variability FROM part
UNION ALL SELECT s.region, s.cell, s.t, {r:seasonality}, {r:variability} FROM source s JOIN part p ON p.cell = s.source AND p.t = s.t""", ctes=f"{CUBE}, {CELL_REGION}, {_COMPONENTS}")
def plan_components(t: Tables) -> DataFrame:
    bridge, grid = _grid(t)
    return decomposed(t.cube, bridge, grid, "cell", "t", "v", "draft", 40, 111)


@query()
def plan_shelf_grid(t: Tables) -> DataFrame:
    melt = 5 + 0.4 * F.greatest(F.col("l_quantity") - 25, F.lit(0.0)) + F.col("l_discount")
    own = t.lineitem.select(F.col("l_partkey").alias("cell"), F.lit(0).alias("t"), F.col("l_quantity").alias("draft"), melt.alias("melt"))
    cells = own.select("cell").distinct()
    bridge = cells.select("cell", (F.col("cell") % 3).alias("region_id")).unionByName(cells.filter("cell % 5 = 0").select("cell", F.lit(7).cast("long").alias("region_id")))
    priority = bridge.select("region_id").distinct().withColumn("priority", F.col("region_id"))
    return shelf_grid(own, bridge, priority, "cell", "t", "draft", "melt")


@query()
def plan_forcings(t: Tables) -> DataFrame:
    _, grid = _grid(t)
    everywhere = grid.select("cell", F.lit(0).alias("region_id"))
    own = fill.extrapolate(t.cube.select("cell", "t", "v"), everywhere, grid, "cell", "t", "v").select("cell", "t", "v")
    own = stored(own.withColumn("month", month_of("t")), "whole")
    flat = ts.deseasonalise(own, "cell", "month", "v", "value")
    season = flat.select("cell", "t", (F.col("v") - F.col("value")).alias("value"))
    return forcings(flat.select("cell", "t", "value"), season, "cell", "t", 3, 11, modes=10)


@query()
def r_analyse_regions(t: Tables) -> DataFrame:
    return analyse_regions(t.bent, "region", "draft", "melt", min_range=20.0)


@query("SELECT cell, m AS member, t, {r:CASE WHEN c.t >= 80 THEN c.v + m + x.v ELSE c.v + m END} AS v FROM cube c CROSS JOIN (VALUES (0), (2)) AS k(m) LEFT JOIN (SELECT cell, t + 20 AS t, v FROM cube) x USING (cell, t)", ctes=CUBE)
def j_members_with_trend(t: Tables) -> DataFrame:
    members = t.spark.range(3).select(F.col("id").cast("int").alias("member"))
    base = t.cube.crossJoin(members).select("member", "cell", "t", (F.col("v") + F.col("member")).alias("v"))
    trend = t.cube.filter("t >= 60").select("cell", (F.col("t") - 60).alias("t"), "v").crossJoin(members)
    last = t.cube.agg(F.max("t").alias("last"))
    trend = trend.crossJoin(last).filter("t + 80 <= last AND NOT (member = 1 AND t > 5)")
    return ts.apply_to_members(base, trend.select("member", "cell", "t", "v"), "member", "cell", "t", "v", 80)[0].select("cell", "member", "t", "v")


@query("SELECT l_suppkey, {r:avg(l_extendedprice)} AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def a_streamed_mean(t: Tables) -> DataFrame:
    stream = means.read_growing(t.spark, f"{t.sf_dir}/lineitem.parque[t]")
    return means.means_now(t.spark, stream, "l_suppkey", "l_extendedprice")
