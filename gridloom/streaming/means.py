"""Time means of a folder to which parts of a cube keep being added.

A mean's state is a sum and a count for each cell, so new files only add to it: nothing is read twice, and parts may come in
any order. There is no event time in it, so no watermark either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.timeseries import Key, keys
from ..sources.shared import shared_dir


def read_growing(spark: SparkSession, pattern: str) -> DataFrame:
    """A stream of the files of a pattern, present and to come; their schema is that of those present."""
    return spark.readStream.schema(spark.read.parquet(pattern).schema).parquet(pattern)


def running_means(stream: DataFrame, key: Key, v: str) -> DataFrame:
    """(key, mean, n) over all that has arrived."""
    return stream.groupBy(*keys(key)).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def keep_up(means: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the latest means to ``out`` after each round of files; once: stops when what is there now is read."""

    def put(latest: DataFrame, _: int) -> None:
        latest.write.mode("overwrite").parquet(out)

    writer = means.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def means_now(spark: SparkSession, stream: DataFrame, key: Key, v: str) -> DataFrame:
    """The means of everything that has arrived by now, through the stream."""
    out, checkpoint = shared_dir(spark, "means"), shared_dir(spark, "means-state")
    keep_up(running_means(stream, key, v), out, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(out)
