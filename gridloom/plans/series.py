"""Queries of the series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import month_of
from ..operators import generator, stats, subset
from ..operators import timeseries as ts
from .base import CELL_REGION, CUBE, RUNS, Tables, query

_W = "(PARTITION BY cell)"
_TREND = f"regr_slope(v, t) OVER {_W} * (t - regr_avgx(v, t) OVER {_W})"


@query(f"""SELECT t, {{r:avg(w)}} AS v FROM (
  SELECT t, y - avg(y) OVER (PARTITION BY cell, month) + avg(y) OVER {_W} AS w FROM (
    SELECT *, v - coalesce({_TREND}, 0) AS y FROM cube WHERE t > 35 AND t <= 110)) GROUP BY t""", ctes=CUBE)
def w_detrended_mean_series(t: Tables) -> DataFrame:
    own = ts.deseasonalise(ts.detrend(t.cube.filter((F.col("t") > 35) & (F.col("t") <= 110)), "cell", "t", "v"), "cell", "month", "v")
    return stats.spatial_mean(own, "t", "v")


@query(f"SELECT cell, t, {{r:v - coalesce({_TREND}, 0)}} AS v FROM cube", ctes=CUBE)
def w_detrend(t: Tables) -> DataFrame:
    return ts.detrend(t.cube, "cell", "t", "v").select("cell", "t", "v")


@query(f"SELECT cell, t, {{r:v - coalesce({_TREND}, 0) - avg(v) OVER {_W}}} AS v FROM cube", ctes=CUBE)
def w_detrend_no_mean(t: Tables) -> DataFrame:
    return ts.detrend(t.cube, "cell", "t", "v", keep_mean=False).select("cell", "t", "v")


# normal equations of a parabola in t less its mean
_QUADRATIC = f"""u AS (SELECT cell, t, v, t - avg(t) OVER {_W} AS u, avg(v) OVER {_W} AS m FROM cube),
p AS (SELECT cell, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(v) AS r0, sum(u * v) AS r1, sum(u * u * v) AS r2 FROM u GROUP BY 1),
c AS (SELECT *, n * (s2 * s4 - s3 * s3) - s2 * s2 * s2 AS det FROM p),
k AS (SELECT cell, (r0 * (s2 * s4 - s3 * s3) - s2 * (r2 * s2 - r1 * s3)) / det AS a, (n * (r1 * s4 - s3 * r2) + r0 * s3 * s2 - s2 * s2 * r1) / det AS b, (n * (s2 * r2 - s3 * r1) - s2 * s2 * r0) / det AS c FROM c)"""


@query("SELECT cell, t, {r:v - a - b * u - c * u * u + m} AS v FROM u JOIN k USING (cell)", digits=2, ctes=f"{CUBE}, {_QUADRATIC}")
def w_detrend_quadratic(t: Tables) -> DataFrame:
    return ts.detrend(t.cube, "cell", "t", "v", deg=2).select("cell", "t", "v")


@query("""m AS (SELECT t, avg(v) AS m FROM cube GROUP BY t),
f AS (SELECT t, regr_slope(m, t) OVER () * (t - regr_avgx(m, t) OVER ()) AS d FROM m)
SELECT cell, t, {r:v - d} AS v FROM cube JOIN f USING (t)""", ctes=CUBE)
def w_detrend_uniform(t: Tables) -> DataFrame:
    return ts.detrend_uniform(t.cube, "t", "v").select("cell", "t", "v")


@query(f"SELECT cell, t, {{r:v - avg(v) OVER (PARTITION BY cell, month) + avg(v) OVER {_W}}} AS v FROM cube", ctes=CUBE)
def w_deseasonalise(t: Tables) -> DataFrame:
    return ts.deseasonalise(t.cube, "cell", "month", "v").select("cell", "t", "v")


@query("""m AS (SELECT t, month, avg(v) AS m FROM cube GROUP BY ALL),
f AS (SELECT t, avg(m) OVER (PARTITION BY month) - avg(m) OVER () AS d FROM m)
SELECT cell, t, {r:v - d} AS v FROM cube JOIN f USING (t)""", ctes=CUBE)
def w_deseasonalise_uniform(t: Tables) -> DataFrame:
    return ts.deseasonalise_uniform(t.cube, "t", "v", month_of("t")).select("cell", "t", "v")


@query("SELECT cell, t, {r:v - avg(v) OVER (PARTITION BY cell, month)} AS v FROM cube", ctes=CUBE)
def w_anomaly(t: Tables) -> DataFrame:
    return ts.deseasonalise(t.cube, "cell", "month", "v", keep_mean=False).select("cell", "t", "v")


@query(f"SELECT cell, t, {{r:{_TREND}}} AS trend FROM cube", ctes=CUBE)
def w_trend(t: Tables) -> DataFrame:
    return ts.fitted_trend(t.cube, "cell", "t", "v").select("cell", "t", "trend")


@query(f"""SELECT cell, t, {{r:y - avg(y) OVER (PARTITION BY cell, month)}} AS residual FROM (
  SELECT *, v - coalesce({_TREND}, 0) - avg(v) OVER {_W} AS y FROM cube)""", ctes=CUBE)
def w_residual(t: Tables) -> DataFrame:
    return ts.residual(t.cube, "cell", "t", "month", "v").select("cell", "t", "residual")


_FIRST = "first_value(v) OVER (PARTITION BY member ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT member, t, {{r:v - {_FIRST}}} AS change, {{r:(v - {_FIRST}) / {_FIRST} * 100}} AS pct FROM runs", ctes=RUNS)
def w_change(t: Tables) -> DataFrame:
    own = ts.change_from_start(t.runs, "member", "t", "v")
    return ts.change_from_start(own, "member", "t", "v", "pct", percent=True).select("member", "t", "change", "pct")


@query(f"SELECT member, t, {{r:(v - {_FIRST}) / v * 100}} AS change FROM runs", ctes=RUNS)
def w_change_current(t: Tables) -> DataFrame:
    return ts.change_from_start(t.runs, "member", "t", "v", percent=True, base="current").select("member", "t", "change")


@query(f"SELECT member, t, {{r:{_FIRST} - v}} AS change FROM runs", ctes=RUNS)
def w_flipped_change(t: Tables) -> DataFrame:
    return ts.change_from_start(t.runs, "member", "t", "v", flip=True).select("member", "t", "change")


@query("SELECT event_id, {r:(epoch(ts) / 86400.0 - min(epoch(ts) / 86400.0) OVER (PARTITION BY user_id)) / 365.0} AS years FROM events", digits=8)
def w_elapsed_years(t: Tables) -> DataFrame:
    own = t.events.withColumn("days", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400.0)
    return ts.elapsed_years(own, "user_id", "days").select("event_id", "years")


@query("""SELECT cell, t, {r:sum(v * draft) OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING)} AS total FROM cube""", digits=2, ctes=CUBE)
def w_cumulative_flux(t: Tables) -> DataFrame:
    return ts.cumulative(t.cube, "cell", "t", "v", "draft").select("cell", "t", "total")


_FLUX = """flux AS (
  SELECT s_nationkey AS region, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INT AS t, avg(l_quantity) AS dt, sum(l_quantity) AS smb, sum(l_discount) AS gl, sum(l_tax) AS mig,
    sum(l_linenumber)::DOUBLE AS fsmb, count(*)::DOUBLE AS calv, sum(l_extendedprice) / 1000 AS bmb FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _flux(t: Tables) -> DataFrame:
    from ..functions.columns import month_index

    own = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return own.groupBy(F.col("s_nationkey").alias("region"), month_index(F.col("l_shipdate"), 1992).alias("t")).agg(
        F.avg("l_quantity").alias("dt"), F.sum("l_quantity").alias("smb"), F.sum("l_discount").alias("gl"), F.sum("l_tax").alias("mig"),
        F.sum("l_linenumber").cast("double").alias("fsmb"), F.count("*").cast("double").alias("calv"), (F.sum("l_extendedprice") / 1000).alias("bmb"),
    )


_RUN = "OVER (PARTITION BY region ORDER BY t ROWS UNBOUNDED PRECEDING)"


@query(f"""SELECT region, t, {{r:sum((smb - gl - mig) * dt) {_RUN}}} AS grounded, {{r:sum((smb - gl) * dt) {_RUN}}} AS grounded_no_migration,
  {{r:sum((fsmb + gl + mig - calv + bmb) * dt) {_RUN}}} AS floating, {{r:sum((fsmb + gl - calv + bmb) * dt) {_RUN}}} AS floating_no_migration FROM flux""", digits=2, ctes=_FLUX)
def w_mass_budget(t: Tables) -> DataFrame:
    own = ts.budget(_flux(t), "region", "t", "dt", "smb", "gl", "mig", "fsmb", "calv", "bmb")
    return own.select("region", "t", "grounded", "grounded_no_migration", "floating", "floating_no_migration")


@query("SELECT t, {r:sum(smb)} AS total, {r:sum(smb) FILTER (region IS DISTINCT FROM 3)} AS total_without FROM flux GROUP BY t", ctes=_FLUX)
def w_totals_without_region(t: Tables) -> DataFrame:
    return ts.totals_without(_flux(t), [], "t", "region", "smb", 3)


@query()
def w_break_points(t: Tables) -> DataFrame:
    return generator.break_points(t.runs, "member", "t", "v", model="rbf", penalty=3.0)


@query()
def w_piecewise_detrend(t: Tables) -> DataFrame:
    return generator.segment_trends(t.cube, "cell", "t", "v", penalty=3.0)


@query()
def w_piecewise_detrend_mean_series(t: Tables) -> DataFrame:
    mean = stats.spatial_mean(t.cube, "t", "v").withColumn("one", F.lit(0))
    return generator.segment_trends(mean, "one", "t", "v", penalty=3.0).drop("one")


@query()
def w_trend_component(t: Tables) -> DataFrame:
    return generator.trend_component(t.cube, "cell", "t", "v", penalty=3.0)


@query("""SELECT cell, {r:(avg(v) FILTER (t BETWEEN 96 AND 107) - avg(v) FILTER (t BETWEEN 36 AND 47)) / 5.0} AS rate FROM cube GROUP BY cell""", ctes=CUBE)
def w_rate_between(t: Tables) -> DataFrame:
    return ts.rate_between(t.cube, "cell", "t", "v", (36, 47), (96, 107), 5.0)


@query(f"""SELECT cell, t, {{r:v_mean}} AS v_mean, {{r:v_std}} AS v_std, {{r:(v - v_mean) / CASE WHEN v_std = 0 THEN 1e-10 ELSE v_std END}} AS z
FROM (SELECT *, avg(v) OVER {_W} AS v_mean, stddev_pop(v) OVER {_W} AS v_std FROM cube)""", ctes=CUBE)
def w_normalise(t: Tables) -> DataFrame:
    return ts.normalise(t.cube, "cell", "v", "z").select("cell", "t", "v_mean", "v_std", "z")


@query("SELECT cell, t, {r:v} AS v FROM cube", ctes=CUBE)
def w_unnormalise(t: Tables) -> DataFrame:
    return ts.unnormalise(ts.normalise(t.cube, "cell", "v", "z"), "z", "v_mean", "v_std", "v").select("cell", "t", "v")


@query("""x AS (SELECT cell, t - 30 AS t, v FROM cube WHERE t >= 70 AND t < 100)
SELECT cell, t, {r:CASE WHEN b.t >= 40 THEN b.v + x.v ELSE b.v END} AS v FROM (SELECT * FROM cube WHERE t < 70) b LEFT JOIN x USING (cell, t)""", ctes=CUBE)
def j_add_over_window(t: Tables) -> DataFrame:
    base, extra = t.cube.filter("t < 70"), t.cube.filter("t >= 70 AND t < 100")
    return ts.add_over_window(base, extra, "cell", "t", "v", 40, 70).select("cell", "t", "v")


@query("""SELECT a.cell, a.t, {r:a.v + b.v} AS v FROM cube a LEFT JOIN cube b ON a.cell = b.cell AND b.t = a.t + 20 WHERE a.t >= 40 AND a.t < 60""", ctes=CUBE)
def j_add_two_windows(t: Tables) -> DataFrame:
    return ts.add_over_window(t.cube, t.cube, "cell", "t", "v", 40, 60, 20, only_window=True).select("cell", "t", "v")


@query("""m AS (SELECT cell, month, avg(v) AS v FROM cube GROUP BY ALL)
SELECT cell, s::INT AS t_idx, {r:v} AS v FROM (SELECT unnest(range(0, 36)) AS s) JOIN m ON s % 12 = month""", ctes=CUBE)
def j_repeat_climatology(t: Tables) -> DataFrame:
    steps = t.spark.range(36).select(F.col("id").cast("int").alias("t_idx"))
    return ts.climatology_repeated(t.cube, "cell", "t", "v", steps)


_EV = """e AS (SELECT user_id, h, avg(value) AS value FROM (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts)::DOUBLE AS h, value FROM events) GROUP BY ALL),
seg AS (SELECT user_id, h AS h0, value AS v0, lead(h) OVER w AS h1, lead(value) OVER w AS v1, lag(h) OVER w IS NULL AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY h)),
goal AS (SELECT unnest(range(0, 720, 24))::DOUBLE AS target)"""


def _events(t: Tables) -> tuple[DataFrame, DataFrame]:
    h = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600).cast("double")
    own = t.events.groupBy("user_id", h.alias("h")).agg(F.avg("value").alias("value"))
    return own, t.spark.range(0, 720, 24).select(F.col("id").cast("double").alias("target"))


@query("""SELECT user_id, target, {r:CASE WHEN h1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (target - h0) / (h1 - h0) END} AS value
FROM seg JOIN goal ON target >= h0 AND target < h1 OR h1 IS NULL AND target = h0""", ctes=_EV)
def j_interpolate(t: Tables) -> DataFrame:
    own, goal = _events(t)
    return ts.interpolate(own, "user_id", "h", "value", goal)


@query("""SELECT user_id, target, {r:CASE WHEN h1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * least(greatest((target - h0) / (h1 - h0), 0), 1) END} AS value
FROM seg JOIN goal ON target >= h0 AND (target < h1 OR h1 IS NULL) OR first AND target < h0""", ctes=_EV)
def j_interpolate_clamped(t: Tables) -> DataFrame:
    own, goal = _events(t)
    return ts.interpolate_clamped(own, "user_id", "h", "value", goal)


@query("SELECT t, {r:avg(v)} AS v FROM (SELECT cell, t, v FROM cube WHERE cell IN (SELECT cell FROM cell_region WHERE region < 10)) GROUP BY t", ctes=f"{CUBE}, {CELL_REGION}")
def p_series_of_chosen_cells(t: Tables) -> DataFrame:
    chosen = t.cell_region.filter("region < 10")
    subset.require_known(chosen, t.supplier.select(F.col("s_suppkey").alias("cell")), "cell")
    own = subset.chosen_cells(t.cube, chosen, "cell")
    return stats.spatial_mean(own, "t", "v")


def whole(t: Tables) -> DataFrame:
    """(cell, t, v): every supplier at every month of the cube; a missing month takes the supplier's mean."""
    ends = t.cube.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row
    own = t.cube.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("known"), F.avg("v").alias("mean"))
    rows = own.crossJoin(ends).select("cell", F.explode(F.sequence("lo", "hi")).alias("t"), "known", "mean")
    return rows.select("cell", "t", F.coalesce(F.try_element_at("known", F.col("t")), "mean").alias("v"))


WHOLE = """whole AS (
  SELECT cell, t, coalesce(v, mean) AS v FROM (SELECT cell, avg(v) AS mean FROM cube GROUP BY 1) CROSS JOIN (SELECT unnest(range(min(t), max(t) + 1))::INT AS t FROM cube) LEFT JOIN cube USING (cell, t))"""


@query()
def e_variance(t: Tables) -> DataFrame:
    return generator.eof(whole(t), "cell", "t", "v")[2]


@query("SELECT t, cell, {r:v - avg(v) OVER (PARTITION BY cell)} AS value FROM whole", ctes=f"{CUBE}, {WHOLE}")
def e_all_modes_give_the_field_back(t: Tables) -> DataFrame:
    loadings, scores, _ = generator.eof(whole(t), "cell", "t", "v")
    return generator.reconstructed(loadings, scores, "cell", "t")


@query()
def e_phase_randomised(t: Tables) -> DataFrame:
    scores = generator.eof(whole(t), "cell", "t", "v", modes=5)[1]
    return generator.phase_randomised(scores, "t", 4, seed=7)


@query()
def e_realisations(t: Tables) -> DataFrame:
    own = ts.normalise(whole(t), "cell", "v", "z")
    loadings, scores, _ = generator.eof(own.select("cell", "t", "z"), "cell", "t", "z")
    drawn = generator.phase_randomised(scores, "t", 2, seed=3)
    moments = own.select("cell", "v_mean", "v_std").distinct()
    month = own.withColumn("month", month_of("t"))
    season = ts.deseasonalise(month, "cell", "month", "v", "flat").withColumn("season", F.col("v") - F.col("flat"))
    return generator.realisations(loadings, drawn, moments, season, "cell", "t", "v_mean", "v_std", "season")
