"""Trends and seasons of a folder to which parts of a cube keep being added, through Structured Streaming.

Each round of files leaves its own sums (``operators.moments``) in a folder of its own, by the number of the round, and nothing
that was written before is touched. After every eighth round its last eight folders become one of the next level, after
every 64th eight of these, and so on: a value is rewritten once a level, and a reader meets at most seven folders a level.
A round that is run again writes the same folders again, or nothing if they are part of a higher one already. There is no
state in the stream itself and no event time, so no watermark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import moments
from ..operators.timeseries import Key
from ..sources.shared import file_system, shared_dir, stored

FAN = 8


def _folders(spark: SparkSession, place: str) -> list[tuple[int, int, str]]:
    """(first round, last round, folder) of each finished folder that no other one covers."""
    files, path = file_system(spark, place)
    if not files.exists(path):
        return []
    found = []
    for entry in files.listStatus(path):
        if m := re.fullmatch(r"rounds-(\d+)-(\d+)", entry.getPath().getName()):
            folder = f"{place}/{m[0]}"
            if file_system(spark, f"{folder}/_SUCCESS")[0].exists(file_system(spark, f"{folder}/_SUCCESS")[1]):
                found.append((int(m[1]), int(m[2]), folder))
    return sorted(x for x in found if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] for y in found))


def _compacted(spark: SparkSession, place: str, last: int, key: Key, fan: int) -> None:
    """Makes one folder of the last ``fan`` of a level, level by level, where the number of rounds says so."""
    size = fan
    while (last + 1) % size == 0:
        first = last + 1 - size
        target = f"{place}/rounds-{first}-{last}"
        inside = [x for x in _folders(spark, place) if first <= x[0] and x[1] <= last]
        if inside and inside[0][:2] != (first, last):
            moments.merged(spark.read.parquet(*(x[2] for x in inside)), key=key).write.mode("overwrite").parquet(target)
        for a, b, folder in [x for x in inside if x[:2] != (first, last)]:
            files, path = file_system(spark, folder)
            files.delete(path, True)
        size *= fan


def follow(stream: DataFrame, key: Key, t: str | Column, month: str | Column, v: str, place: str, checkpoint: str, once: bool = False, t0: float = 0.0, v0: float = 0.0, fan: int = FAN) -> StreamingQuery:
    """Keeps the sums of all that arrives under ``place``; once: stops when what is there now is read."""

    def put(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if not any(a <= number <= b and a < b for a, b, _ in _folders(spark, place)):
            moments.state(rows, key, t, month, v, t0, v0).write.mode("overwrite").parquet(f"{place}/rounds-{number}-{number}")
        _compacted(spark, place, number, key, fan)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def now(spark: SparkSession, place: str, key: Key, v0: float = 0.0) -> DataFrame:
    """What ``moments.finished`` tells of all rounds so far."""
    found = _folders(spark, place)
    if not found:
        raise ValueError(f"no round has finished under {place}")
    return moments.finished(spark.read.parquet(*(x[2] for x in found)), key, v0)


def read_once(spark: SparkSession, stream: DataFrame, key: Key, t: str | Column, month: str | Column, v: str) -> DataFrame:
    """Trends and seasons of all that has arrived by now, through the stream; its folders are removed."""
    place, checkpoint = shared_dir(spark, "moments"), shared_dir(spark, "moments-state")
    follow(stream, key, t, month, v, place, checkpoint, once=True).awaitTermination()
    out = stored(now(spark, place, key), "moments-now")
    for folder in (place, checkpoint):
        files, path = file_system(spark, folder)
        files.delete(path, True)
    return out
