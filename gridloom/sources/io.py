"""Reading and writing: cubes, polygons, run trees, parameters, per-region and per-realisation output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, require
from ..functions.scalars import polar_stereographic
from ..operators.regions import with_bounds
from ..operators.timeseries import Key, keys
from .shared import file_system


def read_cube(spark: SparkSession, path: str | Sequence[str], *columns: str) -> DataFrame:
    """A cube's chosen columns, NaN as null. Partition filters and column pruning reach the scan."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if columns:
        require(df, *columns)
        df = df.select(*columns)
    return nan_to_null(df)


def read_parts(spark: SparkSession, pattern: str, file_col: str = "file") -> DataFrame:
    """All files of a pattern, with the name of each row's file; columns that some files lack are null."""
    return nan_to_null(spark.read.option("mergeSchema", True).parquet(pattern)).withColumn(file_col, F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_polygons(spark: SparkSession, path: str, name: str = "name", project: bool = False) -> DataFrame:
    """Regions from GeoJSON polygons and multipolygons: (region_id in order of the file, name, rings, box). project: from
    longitude and latitude to the south polar plane."""
    point = "array<array<array<double>>>"
    schema = f"features array<struct<properties:struct<{name}:string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("region_id", "f"))
    one, many = F.from_json("f.geometry.coordinates", point), F.flatten(F.from_json("f.geometry.coordinates", f"array<{point}>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)

    def placed(p):
        x, y = polar_stereographic(p[0], p[1]) if project else (p[0], p[1])
        return F.struct(x.alias("x"), y.alias("y"))

    shaped = F.transform(rings, lambda ring: F.transform(ring, placed))
    return with_bounds(raw.select("region_id", F.col(f"f.properties.{name}").alias("name"), shaped.alias("rings")))


def experiments(runs: DataFrame, ensemble: str = "ensemble", experiment: str = "experiment") -> DataFrame:
    """(ensemble, experiments) of a run tree read with partition columns."""
    return runs.select(ensemble, experiment).distinct().groupBy(ensemble).agg(F.array_sort(F.collect_list(experiment)).alias("experiments"))


def select_runs(runs: DataFrame, specs: str, ensemble: str = "ensemble", experiment: str = "experiment") -> DataFrame:
    """(ensemble, experiment, display_name) of the runs that any of the specs names: ``EXP`` or ``ENS:EXP``, separated by
    commas, with * and ? as wildcards."""
    spark = runs.sparkSession
    table = spark.createDataFrame([(specs,)], "specs string").select(F.explode(F.split("specs", ",")).alias("spec")).select(F.split(F.trim("spec"), ":").alias("p"))
    glob = lambda c: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    table = table.select(F.when(F.size("p") > 1, glob(F.col("p")[0])).otherwise("^.*$").alias("e"), glob(F.element_at("p", -1)).alias("x"))
    own = runs.select(ensemble, experiment).distinct()
    hit = own.join(F.broadcast(table), F.rlike(F.col(ensemble), F.col("e")) & F.rlike(F.col(experiment), F.col("x")), "left_semi")  # a spec a row
    return hit.withColumn("display_name", F.concat_ws(":", ensemble, experiment))


def first_base(found: DataFrame, experiment: str = "experiment", rank: str = "base_rank") -> DataFrame:
    """Of each experiment the row of the first base that has it."""
    others = [c for c in found.columns if c not in (experiment, rank)]
    best = found.groupBy(experiment).agg(F.min_by(F.struct(*others, rank), F.struct(rank, *others)).alias("b"))
    return best.select(experiment, "b.*")


def write_by(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """Parquet, one folder for each value of the partition columns."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def write_predictions(df: DataFrame, path: str, region: str, cell: Key, models: Sequence[str]) -> None:
    """Long predictions (model, region, cell, value), a folder for each model and region."""
    write_by(df.unpivot([region, *keys(cell)], list(models), "model", "value"), path, "model", region)


def write_realisations(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A folder for each realisation; the metadata goes along in columns."""
    write_by(df.withColumns({k: F.lit(v) for k, v in metadata.items()}), path, "realization")


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parameter_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("set_name string, min_r2 double, min_corr double, penalty double, n_bins int, min_points int").json(path)


def remaining(work: DataFrame, done: DataFrame, key: Key) -> DataFrame:
    """The work whose output does not exist."""
    return work.join(done.select(*keys(key)).distinct(), keys(key), "left_anti")


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of the partition folders under a path."""
    files, root = file_system(spark, path)
    found = [e.getPath().getName() for e in files.listStatus(root)] if files.exists(root) else []
    return [unquote(x.partition("=")[2]) for x in found if x.startswith(f"{key}=")]


def finished(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key as string, rows, run) of the parts that ``resume`` has finished under ``path``: those in the manifest beside it whose
    folder is there, or that have no rows. A part that was being written when a run broke is in no manifest."""
    files, manifest = file_system(spark, f"{path}.manifest")
    kinds = f"{key} string, rows long, run string, number long"
    if not files.exists(manifest):
        return spark.createDataFrame([], kinds).drop("number")
    told = spark.read.schema(kinds).parquet(f"{path}.manifest")
    there = spark.createDataFrame([(x,) for x in _folders(spark, path, key)], f"{key} string").withColumn("__there", F.lit(True))
    last = told.groupBy(key).agg(F.max_by(F.struct("rows", "run"), "number").alias("m")).select(key, "m.*")
    return last.join(there, key, "left").filter((F.col("rows") == 0) | F.col("__there")).drop("__there")


def resume(spark: SparkSession, work: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], path: str, run: str, batch: int = 16) -> int:
    """Computes the parts of ``work`` (a row a part, by ``key``) that are not finished and writes each to a folder of its own;
    returns how many were left to do. ``compute`` gets some rows of work and returns rows with the key. Parts go in batches, in
    order of the key: a batch's folders are replaced (others stay as they are), then its parts enter the manifest, with their
    rows and the run's name. So a run that breaks loses a batch at most, and a restart writes only what lacks."""
    kind = work.schema[key].dataType.simpleString()
    done = finished(spark, path, key).select(F.col(key).alias("__s"))
    names = work.select(key).distinct()
    left = [r[0] for r in names.join(done, F.col(key).cast("string") == F.col("__s"), "left_anti").orderBy(key).collect()]  # a name a part
    for at in range(0, len(left), batch):
        now = left[at : at + batch]
        compute(work.filter(F.col(key).isin(now))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
        parts = spark.createDataFrame([(x,) for x in now], f"{key} {kind}").select(F.col(key).cast("string").alias(key))
        if set(_folders(spark, path, key)) & {str(x) for x in now}:
            own = spark.read.parquet(path).filter(F.col(key).isin(now))  # this batch's folders only
            parts = parts.join(own.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("rows")), key, "left")
        else:
            parts = parts.withColumn("rows", F.lit(None).cast("long"))
        told = parts.select(key, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(run).alias("run"), F.unix_micros(F.current_timestamp()).alias("number"))
        told.coalesce(1).write.mode("append").parquet(f"{path}.manifest")
    return len(left)


def read_finished(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of finished parts, without what a broken run has left; with the run that wrote them."""
    own = spark.read.parquet(path)
    return own.join(F.broadcast(finished(spark, path, key).select(F.col(key).alias("__k"), "run")), own[key].cast("string") == F.col("__k")).drop("__k")  # a row a part


def process_directory(spark: SparkSession, pattern: str, transform: Callable[[DataFrame], DataFrame], out: str, file_col: str = "file") -> None:
    """One transform over every file of a pattern; the output keeps the files apart."""
    write_by(transform(read_parts(spark, pattern, file_col)), out, file_col)


def write_decomposition(loadings: DataFrame, scores: DataFrame, variance: DataFrame, path: str) -> None:
    for name, df in (("loadings", loadings), ("scores", scores), ("variance", variance)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_decomposition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """loadings, scores and variance as write_decomposition left them."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("loadings", "scores", "variance"))
