"""What the operators share: reading the tables, typed empty output, blocks of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, file_system, forgotten, shared_dir, stored  # noqa: F401


#: A table of fewer bytes may lie in one row group, which one task reads.
SMALL = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; the rows of a small one are dealt to all cores."""
    place = f"{sf_dir}/documents.parquet"
    df = spark.read.parquet(place)
    files, path = file_system(spark, place)
    small = files.getContentSummary(path).getLength() < SMALL
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def freed(df: DataFrame, names: Iterable[str], source: str) -> DataFrame:
    """df without columns that results will have the names of, so that results replace them. The column that is read must
    not be one of them."""
    taken = {n.lower() for n in names}
    if source.lower() in taken:
        raise ValueError(f"{source} is read, so no result can have its name")
    return df.drop(*(c for c in df.columns if c.lower() in taken))


def text_batches(spark: SparkSession) -> None:
    """Lets Spark hand whole texts to Python a thousand at a time, and 16 MB at most where it can tell; the usual ten thousand
    of some kilobytes each, held by Spark and Python and going both ways, take much of a small executor. What a session has
    set itself stays."""
    for name, usual, ours in (("maxRecordsPerBatch", 10_000, 1_000), ("maxBytesPerBatch", 64 << 20, 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key).upper().removesuffix("B") in (str(usual), f"{usual >> 20}M"):
            spark.conf.set(key, str(ours))


def sized(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids (a column of numbers), to be broadcast if they are at most ``most``; else Spark joins them by shuffles."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % n
