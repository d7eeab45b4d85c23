"""Queries of sources and sinks: tables are written to the shared folder, read again, and given back; and own functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import apply, generator
from ..sources import io
from ..sources.shared import shared_dir
from .base import CUBE, RUNS, Tables, query
from .series import WHOLE, whole


@query("SELECT cell, t, {r:CASE WHEN t % 5 <> 0 THEN v END} AS v FROM cube", ctes=CUBE)
def s_read_cube(t: Tables) -> DataFrame:
    """Columns of no interest are not read; NaN is null."""
    place = shared_dir(t.spark, "cube")
    t.cube.withColumn("v", F.when(F.col("t") % 5 == 0, float("nan")).otherwise(F.col("v"))).write.parquet(place)
    return io.read_cube(t.spark, place, "cell", "t", "v")


@query("SELECT member, t, {r:CASE WHEN t % 2 = 0 THEN v END} AS v, {r:CASE WHEN t % 2 = 1 THEN v END} AS w, (count(*) OVER (PARTITION BY t % 2))::BIGINT AS in_file FROM runs", digits=2, ctes=RUNS)
def s_read_parts(t: Tables) -> DataFrame:
    """Two files of unlike columns."""
    place = shared_dir(t.spark, "parts")
    t.runs.filter("t % 2 = 0").coalesce(1).write.parquet(f"{place}/a")
    t.runs.filter("t % 2 = 1").select("member", "t", F.col("v").alias("w")).coalesce(1).write.parquet(f"{place}/b")
    own = io.read_parts(t.spark, f"{place}/*")
    return own.join(own.groupBy("file").agg(F.count("*").alias("in_file")), "file").select("member", "t", "v", "w", "in_file")


@query("""SELECT n_nationkey AS region_id, n_name AS name, (n_nationkey % 2 + 1)::INT AS n_rings, {r:n_nationkey} AS xmin, {r:n_nationkey + 0.5} AS xmax, {r:n_regionkey} AS ymin, {r:n_regionkey + 1 + n_nationkey % 2} AS ymax FROM nation""")
def s_read_polygons(t: Tables) -> DataFrame:
    """Each nation as a square, or as two of them, in GeoJSON."""
    place = shared_dir(t.spark, "polygons")
    square = lambda up: F.format_string("[[%f,%f],[%f,%f],[%f,%f],[%f,%f]]", *(F.col(c) + d for dy in (0.0, 1.0) for c, d in (("x", 0.0 if dy == 0 else 0.5), ("y", up + dy), ("x", 0.5 if dy == 0 else 0.0), ("y", up + dy))))
    own = t.nation.select("n_nationkey", "n_name", F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    many = F.col("n_nationkey") % 2 == 1
    shape = F.when(many, F.concat(F.lit("[["), square(0.0), F.lit("],["), square(1.0), F.lit("]]"))).otherwise(F.concat(F.lit("["), square(0.0), F.lit("]")))
    feature = F.format_string('{"properties":{"name":"%s"},"geometry":{"type":"%s","coordinates":%s}}', F.col("n_name"), F.when(many, "MultiPolygon").otherwise("Polygon"), shape)
    features = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", feature.alias("f")))), lambda x: x["f"]), ",").alias("all"))  # a region each
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}"))).write.text(place)
    return io.read_polygons(t.spark, place).select("region_id", "name", F.size("rings").alias("n_rings"), "xmin", "xmax", "ymin", "ymax")


@query("SELECT cell, t, month, {r:v} AS v FROM cube WHERE month IN (2, 7)", ctes=CUBE)
def s_write_by(t: Tables) -> DataFrame:
    """A folder for each month; two of them are read again."""
    place = shared_dir(t.spark, "by-month")
    io.write_by(t.cube.select("cell", "t", "v", "month"), place, "month")
    return t.spark.read.parquet(place).filter("month IN (2, 7)").select("cell", "t", "month", "v")


@query("SELECT 'v' AS model, month AS region, cell, t, {r:v} AS value FROM cube UNION ALL SELECT 'draft', month, cell, t, {r:draft} FROM cube", ctes=CUBE)
def s_write_predictions(t: Tables) -> DataFrame:
    place = shared_dir(t.spark, "predictions")
    io.write_predictions(t.cube.select(F.col("month").alias("region"), "cell", "t", "v", "draft"), place, "region", ["cell", "t"], ["v", "draft"])
    return t.spark.read.parquet(place).select("model", "region", "cell", "t", "value")


@query("SELECT realization, cell, t, {r:v + realization} AS v, 'kg' AS units FROM cube, (SELECT unnest([0, 1, 2]) AS realization)", ctes=CUBE)
def s_write_realisations(t: Tables) -> DataFrame:
    place = shared_dir(t.spark, "realisations")
    draws = t.spark.range(3).select(F.col("id").cast("int").alias("realization"))
    io.write_realisations(t.cube.crossJoin(draws).select("cell", "t", (F.col("v") + F.col("realization")).alias("v"), "realization"), place, {"units": "kg"})
    return t.spark.read.parquet(place).select("realization", "cell", "t", "v", "units")


@query("SELECT cell, count(*) AS n, {r:avg(v)} AS v FROM cube GROUP BY 1", ctes=CUBE)
def s_write_summary(t: Tables) -> DataFrame:
    """Through a file of comma-separated values."""
    place = shared_dir(t.spark, "summary")
    io.write_summary(t.cube.groupBy("cell").agg(F.count("*").alias("n"), F.avg("v").alias("v")), place)
    return t.spark.read.csv(place, header=True, schema="cell bigint, n bigint, v double")


@query("SELECT p_brand AS set_name, {r:avg(p_size) / 100} AS min_r2, {r:avg(p_size) / 50} AS min_corr, {r:max(p_size)} AS penalty, max(p_size)::INT AS n_bins, min(p_size)::INT AS min_points FROM part GROUP BY 1")
def s_read_parameter_sets(t: Tables) -> DataFrame:
    """Through JSON; a set for each brand."""
    place = shared_dir(t.spark, "sets")
    size = F.col("p_size")
    own = t.part.groupBy(F.col("p_brand").alias("set_name")).agg((F.avg(size) / 100).alias("min_r2"), (F.avg(size) / 50).alias("min_corr"), F.max(size).cast("double").alias("penalty"), F.max(size).alias("n_bins"), F.min(size).alias("min_points"))
    io.write_json(own, place)
    return io.read_parameter_sets(t.spark, place)


@query("SELECT member, t, {r:v * 2} AS v, 2 AS n_files FROM runs", digits=2, ctes=RUNS)
def s_process_directory(t: Tables) -> DataFrame:
    """One transform over both files of a folder, which stay apart."""
    place = shared_dir(t.spark, "directory")
    for name, half in (("a", "t % 2 = 0"), ("b", "t % 2 = 1")):
        t.runs.filter(half).coalesce(1).write.parquet(f"{place}/in/{name}")
    io.process_directory(t.spark, f"{place}/in/*", lambda df: df.withColumn("v", F.col("v") * 2), f"{place}/out")
    own = t.spark.read.parquet(f"{place}/out")
    return own.crossJoin(own.agg(F.count_distinct("file").cast("int").alias("n_files"))).select("member", "t", "v", "n_files")


@query("SELECT month, cell, {r:avg(v)} AS v, CASE WHEN month < 6 THEN 'first' ELSE 'second' END AS run, 6 AS left_over FROM cube GROUP BY month, cell", ctes=CUBE)
def s_resumed(t: Tables) -> DataFrame:
    """Month means in batches of three months; the first run breaks in its third batch, the second one does what is left."""
    place = shared_dir(t.spark, "resumed")
    months = t.cube.select("month").distinct()

    def means(work: DataFrame, until: int) -> DataFrame:
        own = t.cube.join(work, "month").groupBy("month", "cell").agg(F.avg("v").alias("v"))
        return own.withColumn("v", F.when(F.col("month") >= until, F.raise_error(F.lit("broken off")).cast("double")).otherwise(F.col("v")))

    try:
        io.resume(t.spark, months, "month", lambda work: means(work, 7), place, "first", 3)
    except Exception as e:
        if "broken off" not in str(e):
            raise
    left = io.resume(t.spark, months, "month", lambda work: means(work, 12), place, "second", 3)
    return io.read_finished(t.spark, place, "month").select("month", "cell", "v", "run", F.lit(left).alias("left_over"))


@query("SELECT t, cell, {r:v - avg(v) OVER (PARTITION BY cell)} AS value FROM whole", ctes=f"{CUBE}, {WHOLE}")
def e_stored_decomposition(t: Tables) -> DataFrame:
    """Written, read again, and put together."""
    place = shared_dir(t.spark, "decomposition")
    io.write_decomposition(*generator.eof(whole(t), "cell", "t", "v"), place)
    loadings, scores, _ = io.read_decomposition(t.spark, place)
    return generator.reconstructed(loadings, scores, "cell", "t")


@query("SELECT cell, t, {r:sum(v) OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING)} AS value FROM cube", digits=2, ctes=CUBE)
def x_over_series(t: Tables) -> DataFrame:
    return apply.over_series(t.cube, "cell", "t", "v", np.cumsum)


@query("SELECT cell, t, {r:sqrt(v)} AS v, {r:sqrt(draft)} AS draft FROM cube", ctes=CUBE)
def x_over_columns(t: Tables) -> DataFrame:
    return apply.over_columns(t.cube, ["v", "draft"], F.sqrt).select("cell", "t", "v", "draft")
