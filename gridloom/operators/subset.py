"""Projections, filters and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, require, with_step
from .timeseries import Key, keys


def by_range(df: DataFrame, dim: str, start, end) -> DataFrame:
    """Rows with start <= dim <= end; ValueError for an unknown column."""
    require(df, dim)
    return df.filter(F.col(dim).between(start, end))


def by_years(df: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Rows with start < year <= end; time is a timestamp or date, or a whole year."""
    require(df, time)
    year = F.col(time) if dict(df.dtypes)[time] in ("int", "bigint", "smallint") else F.year(time)
    return df.filter((year > start) & (year <= end))


def by_steps(df: DataFrame, time: str, start: int, stop: int) -> DataFrame:
    """Rows of the distinct times number start to stop - 1."""
    return with_step(df, time).filter((F.col("t_idx") >= start) & (F.col("t_idx") < stop))


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames those columns that exist."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def rename_and_fill(df: DataFrame, names: dict[str, str] | None = None, fill: float = 0.0) -> DataFrame:
    """Renames (x and y to x1 and y1 unless told otherwise) and puts ``fill`` for NaN and null numbers."""
    return rename_present(nan_to_null(df), {"x": "x1", "y": "y1"} if names is None else names).fillna(fill)


def where(df: DataFrame, v: str, mask, fill=None) -> DataFrame:
    """v where the mask holds, else fill."""
    return df.withColumn(v, F.when(mask, F.col(v)).otherwise(F.lit(fill)))


def regions_named(regions: DataFrame, name: str, text: str, exact: bool = False) -> DataFrame:
    """Regions of a name, or whose name contains a text whatever the case."""
    return regions.filter(F.col(name) == text if exact else F.lower(name).contains(text.lower()))


def regions_between(regions: DataFrame, id_: str, low: int = 33, high: int = 132) -> DataFrame:
    return regions.filter(F.col(id_).between(low, high))


def active_cells(df: DataFrame, cell: Key, v: str) -> DataFrame:
    """The rows of cells that have any non-zero value."""
    live = df.groupBy(*keys(cell)).agg(F.max(F.coalesce((F.col(v) != 0), F.lit(False))).alias("__any")).filter("__any")
    return df.join(live.select(*keys(cell)), keys(cell), "left_semi")


def chosen_cells(df: DataFrame, points: DataFrame, cell: Key) -> DataFrame:
    return df.join(points.select(*keys(cell)).distinct(), keys(cell), "left_semi")


def newly_floating(early: DataFrame, late: DataFrame, cell: str, mask: str, bit: int = 4) -> DataFrame:
    """(cell, grounded_now, floating_now, newly_floating) from two dates' bit masks."""
    now, then = F.col(mask).bitwiseAND(bit) == bit, F.col("__m").bitwiseAND(bit) == bit
    both = late.select(cell, mask).join(early.select(cell, F.col(mask).alias("__m")), cell)
    return both.select(cell, (~now).alias("grounded_now"), now.alias("floating_now"), (now & ~then).alias("newly_floating"))


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unknown_names(requested: DataFrame, known: DataFrame, name: str) -> DataFrame:
    return requested.select(name).distinct().join(known.select(name), name, "left_anti")


def require_known(requested: DataFrame, known: DataFrame, name: str) -> None:
    if found := [r[0] for r in unknown_names(requested, known, name).limit(10).collect()]:
        raise ValueError(f"unknown: {', '.join(map(str, found))}")


def common_names(*tables: DataFrame) -> DataFrame:
    """Names (first column) that all tables have."""
    return reduce(lambda a, b: a.intersect(b), (t.select(F.col(t.columns[0]).alias("name")) for t in tables))
