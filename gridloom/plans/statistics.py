"""Queries of means, distributions and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import moments, stats
from ..operators import timeseries as ts
from ..sources.shared import file_system, shared_dir
from ..streaming import means
from ..streaming import moments as streamed
from .base import CELL_REGION, CUBE, FIELD, POINTS, RUNS, Tables, query


@query("SELECT cell, {r:avg(v)} AS v, {r:avg(draft)} AS draft FROM cube GROUP BY cell", ctes=CUBE)
def a_time_mean(t: Tables) -> DataFrame:
    return stats.time_mean(t.cube, "cell", "v", "draft")


@query("SELECT t, region, {r:avg(v)} AS v FROM cube JOIN cell_region USING (cell) GROUP BY ALL", ctes=f"{CUBE}, {CELL_REGION}")
def a_regional_mean_series(t: Tables) -> DataFrame:
    return stats.spatial_mean(t.cube.join(t.cell_region, "cell"), ["t", "region"], "v")


@query("SELECT t, {r:sum(v)} AS v FROM cube GROUP BY t", digits=2, ctes=CUBE)
def a_spatial_sum(t: Tables) -> DataFrame:
    return stats.spatial_sum(t.cube, "t", "v")


@query("SELECT cell, t, {r:v - (SELECT avg(v) FROM cube)} AS v FROM cube", ctes=CUBE)
def a_minus_grand_mean(t: Tables) -> DataFrame:
    return stats.minus_grand_mean(t.cube, "v").select("cell", "t", "v")


@query("SELECT cell, (1992 + t // 12)::INT AS year, {r:avg(v)} AS v FROM cube GROUP BY ALL", ctes=CUBE)
def a_annual_mean(t: Tables) -> DataFrame:
    year = (F.lit(1992) + F.floor(F.col("t") / 12)).cast("int").alias("year")
    return stats.annual_mean(t.cube, "cell", year, "v")


@query("SELECT cell, (t // 12)::INT AS t, {r:avg(v)} AS v FROM cube WHERE t >= 36 AND t < 108 GROUP BY cell, t // 12", ctes=CUBE)
def a_coarsen_time(t: Tables) -> DataFrame:
    return stats.coarsen_time(t.cube.filter("t >= 36 AND t < 108"), "cell", "t", "v")


@query("""SELECT 0 AS t, (ix // 4)::INT AS ix, (iy // 4)::INT AS iy, {r:avg(x)} AS x, {r:avg(y)} AS y, {r:avg(value)} AS value
FROM field WHERE ix < 48 AND iy < 8 GROUP BY ix // 4, iy // 4""", ctes=FIELD)
def a_coarsen_space(t: Tables) -> DataFrame:
    return stats.coarsen_space(t.field.withColumn("t", F.lit(0)), "t", "ix", "iy", "x", "y", 4, "value")


@query("""SELECT cell, month, {r:avg(w)} AS w FROM (
  SELECT *, v - coalesce(regr_slope(v, t) OVER c * (t - regr_avgx(v, t) OVER c), 0) - avg(v) OVER c AS w FROM cube WINDOW c AS (PARTITION BY cell)) GROUP BY ALL""", ctes=CUBE)
def a_seasonal_cycle(t: Tables) -> DataFrame:
    return stats.climatology(ts.detrend(t.cube, "cell", "t", "v", "w", keep_mean=False), "cell", "month", "w")


@query("SELECT cell, {r:avg(v)} AS mean, count(v) AS n FROM cube GROUP BY cell", ctes=CUBE)
def a_merged_mean(t: Tables) -> DataFrame:
    parts = stats.partial_means(t.cube.withColumn("part", F.floor(F.col("t") / 12)), "part", "cell", "v")
    return stats.merged_mean(parts, "cell")


_SEASONS = """fit AS (SELECT cell, t, month, v, v - coalesce(regr_slope(v, t) OVER c * (t - regr_avgx(v, t) OVER c), 0) AS y, coalesce(regr_slope(v, t) OVER c, 0) AS slope, avg(v) OVER c AS mean, count(*) OVER c AS n FROM cube WINDOW c AS (PARTITION BY cell)),
flat AS (SELECT *, y - avg(y) OVER (PARTITION BY cell, month) AS e FROM fit),
lefts AS (SELECT cell, avg(e * e) AS left_over FROM flat GROUP BY 1)
SELECT cell, month, any_value(n) AS n, count(*) AS n_month, {r:any_value(mean)} AS mean, {r:any_value(slope)} AS slope, {r:avg(y) - any_value(mean)} AS season, {r:any_value(left_over) / 1e6} AS left_over
FROM flat JOIN lefts USING (cell) GROUP BY cell, month"""


def _seasons(done: DataFrame) -> DataFrame:
    own = done.select("cell", "n", "mean", "slope", (F.col("left") / 1e6).alias("left_over"), F.explode("seasons").alias("s"))
    return own.select("cell", "s.month", "n", F.col("s.n").alias("n_month"), "mean", "slope", F.col("s.season").alias("season"), "left_over")


@query(_SEASONS, digits=3, ctes=CUBE)
def a_merged_seasons(t: Tables) -> DataFrame:
    """Each year's part has its own sums, which are added up in any order."""
    parts = moments.state(t.cube.withColumn("part", F.floor(F.col("t") / 12)), ["part", "cell"], "t", "month", "v", t0=42.0)
    return _seasons(moments.finished(parts, "cell"))


@query(_SEASONS, digits=3, ctes=CUBE)
def a_streamed_seasons(t: Tables) -> DataFrame:
    """The same of a cube that comes as a stream of files."""
    place = shared_dir(t.spark, "cube")
    t.cube.write.parquet(place)
    out = streamed.read_once(t.spark, means.read_growing(t.spark, place), "cell", "t", "month", "v")
    files, path = file_system(t.spark, place)
    files.delete(path, True)
    return _seasons(out)


@query("SELECT cell, {r:var_pop(v)} AS variance FROM cube GROUP BY cell", digits=1, ctes=CUBE)
def a_variance_map(t: Tables) -> DataFrame:
    return stats.variance_map(t.cube, "cell", "v")


@query("SELECT l_returnflag, {r:avg((l_discount > 0)::INT)} AS d_coverage FROM lineitem GROUP BY 1")
def a_coverage(t: Tables) -> DataFrame:
    return stats.coverage(t.lineitem.withColumn("d", F.when(F.col("l_discount") > 0, F.col("l_discount"))), "l_returnflag", "d")


@query("""SELECT p_brand, arg_max(p_size, (n, -p_size)) AS mode FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1""")
def a_most_frequent(t: Tables) -> DataFrame:
    return stats.most_frequent(t.part, "p_brand", "p_size")


@query("""SELECT l_suppkey, {r:coalesce(arg_min(l_discount, (l_orderkey, l_linenumber)) FILTER (l_discount != 0), 0)} AS l_discount,
  {r:coalesce(arg_min(l_tax, (l_orderkey, l_linenumber)) FILTER (l_tax != 0), 0)} AS l_tax FROM lineitem GROUP BY 1""")
def a_first_nonzero(t: Tables) -> DataFrame:
    return stats.first_nonzero(t.lineitem, "l_suppkey", ["l_orderkey", "l_linenumber"], "l_discount", "l_tax")


@query("""SELECT n_regionkey, {r:sum(s_acctbal)} AS total, {r:avg(s_acctbal)} AS mean, {r:max(s_acctbal)} AS highest, {r:min(s_acctbal)} AS lowest,
  arg_max(s_name, (s_acctbal, s_name)) AS highest_name, arg_min(s_name, (s_acctbal, s_name)) AS lowest_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def a_regional_summary(t: Tables) -> DataFrame:
    return stats.summary(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")), "n_regionkey", "s_acctbal", "s_name")


@query("SELECT t, {r:avg(v)} AS mean, {r:min(v)} AS lowest, {r:max(v)} AS highest, {r:max(v) - min(v)} AS range, {r:stddev_pop(v)} AS std FROM runs GROUP BY t", digits=2, ctes=RUNS)
def a_ensemble_stats(t: Tables) -> DataFrame:
    return stats.ensemble_stats(t.runs, "t", "v")


_MEMBERS = """m AS (SELECT l_suppkey AS cell, l_linenumber AS member, year(l_shipdate)::INT AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"""


def _members(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("member"), F.year("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("v"))


@query("""e AS (SELECT min(t) AS t0, max(t) AS t1 FROM m),
p AS (SELECT cell, member, max(v) FILTER (t = t1) AS now, max(v) FILTER (t = t0) AS then_ FROM m, e WHERE t IN (t0, t1) GROUP BY ALL)
SELECT cell, {r:range} AS range, {r:change} AS change, {r:CASE WHEN abs(change) >= 10 THEN range / (abs(change) + 1e-6) END} AS ratio
FROM (SELECT cell, max(now) - min(now) AS range, avg(now - then_) AS change FROM p GROUP BY cell)""", ctes=_MEMBERS)
def a_spread_against_change(t: Tables) -> DataFrame:
    return stats.spread_against_change(_members(t), "cell", "member", "t", "v")


@query("""SELECT l_returnflag, {r:avg(l_extendedprice)} AS mean, {r:stddev_pop(l_extendedprice)} AS std, {r:max(l_extendedprice)} AS highest,
  {r:quantile_cont(l_extendedprice, 0.25)} AS q25, {r:quantile_cont(l_extendedprice, 0.5)} AS median, {r:quantile_cont(l_extendedprice, 0.75)} AS q75, {r:quantile_cont(l_extendedprice, 0.9)} AS q90,
  count(*) FILTER (l_extendedprice > 50000) AS n_above FROM lineitem GROUP BY 1""")
def a_field_summary(t: Tables) -> DataFrame:
    return stats.field_summary(t.lineitem, "l_returnflag", "l_extendedprice", 50000.0)


@query("""b AS (SELECT t, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM cube GROUP BY t),
k AS (SELECT t, avg(pow(v - mean, 3)) AS m3, avg(pow(v - mean, 4)) AS m4 FROM cube JOIN b USING (t) GROUP BY t)
SELECT t, n, {r:mean} AS mean, {r:std} AS std, {r:q25} AS q25, {r:median} AS median, {r:q75} AS q75,
  {r:CASE WHEN std > 1e-10 THEN m3 / pow(std, 3) ELSE 0 END} AS skewness, {r:CASE WHEN std > 1e-10 THEN m4 / pow(std, 4) - 3 ELSE 0 END} AS kurtosis FROM b JOIN k USING (t)""", ctes=CUBE)
def a_member_distribution(t: Tables) -> DataFrame:
    return stats.distribution(t.cube, "t", "v")


@query("SELECT t, count(v) AS n FROM cube GROUP BY t HAVING count(v) >= 60", ctes=CUBE)
def a_enough_members(t: Tables) -> DataFrame:
    return stats.enough_members(t.cube, "t", "v", 120)


@query("""e AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS all_ FROM lineitem GROUP BY 1),
h AS (SELECT l_returnflag, least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL)
SELECT l_returnflag, bin, {r:lo + bin * (hi - lo) / 50} AS low, n, {r:n / all_ / ((hi - lo) / 50)} AS density FROM h JOIN e USING (l_returnflag)""", digits=8)
def a_histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.lineitem, "l_returnflag", "l_extendedprice")


@query("""q AS (SELECT l_returnflag, count(*) AS n, max(l_quantity) - min(l_quantity) AS r, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1)
SELECT l_returnflag, ceil(r / least(r / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3)))::INT AS bins FROM q""")
def a_auto_bins(t: Tables) -> DataFrame:
    return stats.auto_bins(t.lineitem, "l_returnflag", "l_quantity")


@query("""q AS (SELECT l_returnflag, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sigma, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
g AS (SELECT *, lo + (hi - lo) * point / 99 AS x FROM q, (SELECT unnest(range(0, 100))::INT AS point))
SELECT l_returnflag, point, {r:mu} AS mu, {r:sigma} AS sigma, {r:x} AS x, {r:exp(-0.5 * pow((x - mu) / sigma, 2)) / (sigma * sqrt(2 * pi()))} AS density FROM g""", digits=8)
def a_normal_fit(t: Tables) -> DataFrame:
    return stats.normal_fit(t.lineitem, "l_returnflag", "l_quantity")


@query("""e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
g AS (SELECT p::INT AS point, lo - 0.1 * (hi - lo) + (hi - lo) * 1.2 * p / 299 AS x FROM e, (SELECT unnest(range(0, 300)) AS p)),
w AS (SELECT l_returnflag, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT l_returnflag, point, {r:x} AS x, {r:sum(k * exp(-0.5 * pow((x - v) / h, 2)) / (n * h * sqrt(2 * pi())))} AS density
FROM c JOIN w USING (l_returnflag), g GROUP BY l_returnflag, point, x""", digits=8)
def a_kernel_density(t: Tables) -> DataFrame:
    return stats.kernel_density(t.lineitem, "l_returnflag", "l_quantity")


@query("""SELECT l_returnflag, {r:quantile_cont(l_extendedprice, 0.01)} AS low, {r:quantile_cont(l_extendedprice, 0.99)} AS high, {r:max(abs(l_extendedprice))} AS largest FROM lineitem GROUP BY 1""")
def a_robust_limits(t: Tables) -> DataFrame:
    return stats.robust_limits(t.lineitem, "l_returnflag", "l_extendedprice")


@query("SELECT DISTINCT p_size FROM part")
def a_distinct_codes(t: Tables) -> DataFrame:
    return t.part.select("p_size").distinct()


# sums of sines and cosines over the steps of each series
@query("""a AS (SELECT member, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY member) AS n, v - avg(v) OVER (PARTITION BY member) AS a FROM runs WINDOW w AS (PARTITION BY member ORDER BY t)),
k AS (SELECT member, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT member, n FROM a))
SELECT member, {r:k / n} AS frequency, {r:(pow(sum(a * cos(2 * pi() * k * i / n)), 2) + pow(sum(a * sin(2 * pi() * k * i / n)), 2)) / n / 1e6} AS power FROM a JOIN k USING (member, n) GROUP BY member, k, n""", ctes=RUNS)
def a_power_spectrum(t: Tables) -> DataFrame:
    return stats.power_spectrum(t.runs, "member", "t", "v").withColumn("power", F.col("power") / 1e6)


@query("""p AS (SELECT member, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY member) AS n, v FROM runs WINDOW w AS (PARTITION BY member ORDER BY t)),
h AS (SELECT member, i // 32 AS piece, i % 32 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i % 32) / 31)) AS a FROM p WHERE i < n // 32 * 32 OR n < 32),
k AS (SELECT member, piece, k, pow(sum(a * cos(2 * pi() * k * j / 32)), 2) + pow(sum(a * sin(2 * pi() * k * j / 32)), 2) AS power FROM h, (SELECT unnest(range(0, 17)) AS k) GROUP BY ALL)
SELECT member, {r:k / 16.0} AS frequency, {r:avg(power) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / (2.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 31), 2)) FROM (SELECT unnest(range(0, 32)) AS j))) / 1e6} AS power FROM k GROUP BY member, k""", ctes=RUNS)
def a_mean_spectrum(t: Tables) -> DataFrame:
    return stats.mean_spectrum(t.runs, "member", "t", "v", 32).withColumn("power", F.col("power") / 1e6)


@query("""a AS (SELECT member, t, v - avg(v) OVER (PARTITION BY member) AS a FROM runs),
s AS (SELECT x.member, (y.t - x.t)::INT AS lag, sum(x.a * y.a) AS s FROM a x JOIN a y ON x.member = y.member AND y.t >= x.t GROUP BY ALL)
SELECT member, lag, {r:s / max(s) OVER (PARTITION BY member)} AS r FROM s""", digits=6, ctes=RUNS)
def a_autocorrelation(t: Tables) -> DataFrame:
    return stats.autocorrelation(t.runs, "member", "t", "v")


@query("SELECT l_linenumber, {r:avg(l_quantity)} AS l_quantity FROM lineitem GROUP BY 1")
def a_layer_mean(t: Tables) -> DataFrame:
    return stats.spatial_mean(t.lineitem, "l_linenumber", "l_quantity")


@query("SELECT member, max(t) AS t, {r:arg_max(v, t)} AS v FROM runs GROUP BY 1", digits=2, ctes=RUNS)
def o_last_value(t: Tables) -> DataFrame:
    return stats.last_value(t.runs, "member", "t", "v")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE abs(s_acctbal) > 0.1 ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 10")
def o_top_by_size(t: Tables) -> DataFrame:
    own = t.supplier.filter(F.abs("s_acctbal") > 0.1).select("s_suppkey", "s_acctbal")
    return stats.top(own, [F.abs("s_acctbal").desc(), F.col("s_suppkey")], 10)


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE (n - 1) % 3 = 0""")
def o_every_nth(t: Tables) -> DataFrame:
    return stats.every_nth(t.supplier, "s_nationkey", "s_suppkey", 3).select("s_nationkey", "s_suppkey")


@query("""SELECT region, point, {r:draft} AS draft, {r:melt} AS melt FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(point::VARCHAR)) AS k FROM points) WHERE k <= 200""", ctes=POINTS)
def o_sample_points(t: Tables) -> DataFrame:
    return stats.sample_per_key(t.points, "region", F.md5(F.col("point").cast("string")), 200)
