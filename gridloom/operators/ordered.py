"""Ordered scans over series of any length: running sums and the neighbours of target times.

A series of more than ``most`` rows is cut by Spark's ranges of time into blocks of about that size, all others are one block.
Windows then run over (key, block), so no task holds more of a key than a block; what a block needs of the blocks before and
after it (a sum, a first and a last point) goes through a table of a row a block. Windows have running frames only, so a scan
is linear in the length of a series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a key from which on it is cut.
MOST = 1_000_000
Key = str | Sequence[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equal keys, where null equals null."""
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[f"__{n}"]) for n in names), F.lit(True))


def blocked(df: DataFrame, key: Key, t: str, most: int | None = MOST) -> tuple[DataFrame, bool]:
    """df with ``__block``, and whether any key has more than one. Blocks of a key are in order of t, rows of one time are in
    one block. Long keys are at most one in ``most`` rows, and their rows are written once, so that their blocks stay as they
    are. ``most=None`` is for series that can't be long (the levels of a cell): their rows are not counted."""
    names = _names(key)
    if most is None:
        return df.withColumn("__block", F.lit(0)), False
    counts = df.groupBy(*names).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    long = counts.select(*(F.col(n).alias(f"__{n}") for n in names), "__n")
    parts = long.agg(F.sum(F.ceil(F.col("__n") / most))).first()[0]
    if not parts:
        return df.withColumn("__block", F.lit(0)), False
    own = df.join(long, _same(df, long, names), "left_semi")
    cut = stored(own.repartitionByRange(int(parts), *names, t).withColumn("__block", F.spark_partition_id()), "ordered-blocks")
    return cut.unionByName(df.join(long, _same(df, long, names), "left_anti").withColumn("__block", F.lit(0))), True


def _joined(df: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """df with a block's own columns; blocks have a row for each (key, block)."""
    told = blocks.select(*(F.col(n).alias(f"__{n}") for n in names), F.col("__block").alias("__of"), *(c for c in blocks.columns if c not in (*names, "__block")))
    return df.join(told, _same(df, told, names) & (df["__block"] == told["__of"]), "left").drop("__of", *(f"__{n}" for n in names))


def running_sums(df: DataFrame, key: Key, t: str, steps: dict[str, Column], most: int | None = MOST) -> DataFrame:
    """df with the sums of each step from a key's first row on, in order of t: {name: step}. Null steps add nothing; before the
    first step that is not null a sum is null. Rows of one time are added one after the other, in any order."""
    names = _names(key)
    own, many = blocked(df, key, t, most)
    own = own.withColumns({f"__step_{n}": c for n, c in steps.items()})
    before = Window.partitionBy(*names, "__block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(f"__step_{n}").over(before) for n in steps}
    if many:
        per_block = own.groupBy(*names, "__block").agg(*(F.sum(f"__step_{n}").alias(f"__sum_{n}") for n in steps))
        earlier = Window.partitionBy(*names).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(*names, "__block", *(F.sum(f"__sum_{n}").over(earlier).alias(f"__carry_{n}") for n in steps))
        out = _joined(own.withColumns(sums), carried, names)
        both = lambda n: F.when(F.col(n).isNull(), F.col(f"__carry_{n}")).otherwise(F.col(n) + F.coalesce(f"__carry_{n}", F.lit(0)))
        out = out.withColumns({n: both(n) for n in steps}).drop(*(f"__carry_{n}" for n in steps))
    else:
        out = own.withColumns(sums)
    return out.drop("__block", *(f"__step_{n}" for n in steps))


def between(df: DataFrame, key: Key, t: str, v: str, targets: DataFrame, target: str, inside: bool, most: int | None = MOST) -> DataFrame:
    """(key, target, __a, __b): for every distinct target of a key the point (t, v) at or before it, and the one after it. With
    ``inside`` only targets from the key's first to its last time. Points without a value are left out; of points at one time
    the largest value counts. targets may have the key's columns, or some of them; else they are every key's.

    Points and targets are put in one order; a target's neighbours are the last points that a scan upwards and a scan
    downwards have met. Points never carry targets, and no target meets a point that is not its neighbour."""
    names = _names(key)
    point = F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"))
    own = df.filter(F.col(v).isNotNull() & F.col(t).isNotNull()).select(*names, F.col(t).cast("double").alias("__t"), point.alias("__p"))
    points, many = blocked(own, key, "__t", most)
    if not many:
        points = points.repartition(*names)  # the ends of series, the targets and the scans all use this one exchange
    ends = points.groupBy(*names).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    goals = targets.select(*(n for n in names if n in targets.columns), target).distinct()
    shared = [n for n in names if n in goals.columns]
    met = ends.join(goals, shared) if shared else ends.crossJoin(goals)
    at = F.col(target).cast("double")
    asked = met.filter(at.between(F.col("__lo"), F.col("__hi")) if inside else F.lit(True)).select(*names, at.alias("__t"), target)
    if many:
        asked = _placed(points, asked, names)
    else:
        asked = asked.withColumn("__block", F.lit(0))
    rows = points.withColumn(target, F.lit(None).cast(targets.schema[target].dataType)).unionByName(asked, allowMissingColumns=True)
    none = F.col("__p").isNull()
    scan = Window.partitionBy(*names, "__block")
    up, down = scan.orderBy("__t", none, "__p"), scan.orderBy(F.desc("__t"), none.desc(), F.desc("__p"))
    last = lambda w: F.last("__p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("__a", last(up)).withColumn("__b", last(down)).filter(none)
    if many:
        near = near.withColumns({"__a": F.coalesce("__a", "__before"), "__b": F.coalesce("__b", "__after")})
    return near.select(*names, target, "__a", "__b")


def _placed(points: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """Targets with the block that they lie in (the last one that starts at or before the target, or the first), the last point
    before that block and the first one after it. A key's blocks are an array of a few entries, in which each target looks."""
    ends = points.groupBy(*names, "__block").agg(F.min("__p").alias("first"), F.max("__p").alias("last"))
    cuts = ends.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("__block", "first", "last"))).alias("__cuts"))
    told = cuts.select(*(F.col(n).alias(f"__{n}") for n in names), "__cuts")
    at = F.greatest(F.size(F.filter("__cuts", lambda c: c["first"]["t"] <= F.col("__t"))) - 1, F.lit(0))
    own = asked.join(told, _same(asked, told, names)).drop(*(f"__{n}" for n in names)).withColumn("__i", at)
    of = lambda i: F.get("__cuts", F.col("__i") + i)
    placed = {"__block": of(0)["__block"], "__before": of(-1)["last"], "__after": of(1)["first"]}
    return own.withColumns(placed).drop("__cuts", "__i")
