"""The folder that all executors share, for tables between jobs and for checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, also set as the context's. Where it is unset, a folder of this machine for a session whose
    executors are all on it; else a ValueError, as executors would not see each other's files."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = getattr(spark.sparkContext, "_own_checkpoint_dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext._own_checkpoint_dir = place
    if not getattr(spark.sparkContext, "_checkpoint_dir_set", False):
        spark.sparkContext.setCheckpointDir(place)
        spark.sparkContext._checkpoint_dir_set = True
    return place


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the shared place that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder; they outlive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, place: str):
    """The file system of a folder, and the folder, for Spark's own writers may be the only ones that reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage is cut, the plan starts anew with true sizes,
    and the driver keeps nothing of the plan before. The folder goes when the application ends, or when forgotten."""
    spark, place = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(place)
    files, path = file_system(spark, place)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(place)
    out._stored_in = place
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table; itself if it is one already. For tables of a row a key that many more rows are to meet: once they
    are written Spark knows their size, and sends small ones to the others' tasks instead of dealing all rows by key."""
    return df if getattr(df, "_stored_in", None) else stored(df, name)


def forgotten(*tables: DataFrame) -> None:
    """Deletes the folders of stored tables that nothing reads any more, such as the last round's state of a loop."""
    for df in tables:
        if place := getattr(df, "_stored_in", None):
            files, path = file_system(df.sparkSession, place)
            files.delete(path, True)
