"""Transforms of series: trends, seasons, changes, cumulative sums, normalising.

All work on a long table with a key (one or more columns), a numeric time and a value. Windows are partitioned by the key
alone or by the key and one more column, so a chain of these shuffles once, by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require
from . import ordered

Key = str | Sequence[str]


def keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def trend_line(key: Key, t: str, v: str) -> Column:
    """The fitted line, less the mean of the values: slope * (t - mean t of rows with a value)."""
    w = Window.partitionBy(*keys(key))
    return F.regr_slope(v, t).over(w) * (F.col(t) - F.regr_avgx(v, t).over(w))


def detrend(df: DataFrame, key: Key, t: str, v: str, out: str | None = None, deg: int = 1, keep_mean: bool = True) -> DataFrame:
    """Removes each key's polynomial trend; the mean stays unless keep_mean is false. A series of fewer than two times keeps
    its values (or loses its mean)."""
    require(df, *keys(key), t, v)
    out = out or v
    if deg == 1:
        flat = F.col(v) - F.coalesce(trend_line(key, t, v), F.lit(0.0))
        return df.withColumn(out, flat if keep_mean else flat - F.avg(v).over(Window.partitionBy(*keys(key))))
    return _polynomial(df, key, t, v, out, deg, keep_mean)


def _polynomial(df: DataFrame, key: Key, t: str, v: str, out: str, deg: int, keep_mean: bool) -> DataFrame:
    """Power sums of the scaled time per key, a small solve per key, and the fit joined back."""
    names = keys(key)
    w = Window.partitionBy(*names)
    half = F.greatest((F.max(t).over(w) - F.min(t).over(w)) / 2, F.lit(1e-9))
    scaled = df.withColumn("__u", (F.col(t) - (F.max(t).over(w) + F.min(t).over(w)) / 2) / half)
    power = lambda k: F.pow("__u", F.lit(k))
    has = F.col(v).isNotNull()
    sums = scaled.groupBy(*names).agg(
        F.array(*(F.sum(F.when(has, power(k))) for k in range(2 * deg + 1))).alias("__s"),
        F.array(*(F.sum(F.col(v) * power(k)) for k in range(deg + 1))).alias("__r"),
        F.avg(v).alias("__mean"),
    )

    @F.pandas_udf("array<double>")
    def solved(s: pd.Series, r: pd.Series) -> pd.Series:
        found = []
        for a, b in zip(s, r, strict=True):
            m = np.array([[a[i + j] if a[i + j] is not None else 0.0 for j in range(deg + 1)] for i in range(deg + 1)], float)
            found.append(np.linalg.lstsq(m, np.array([x if x is not None else 0.0 for x in b], float), rcond=None)[0].tolist())
        return pd.Series(found)

    fitted = sums.select(*names, "__mean", solved("__s", "__r").alias("__c"))
    line = sum((F.col("__c")[k] * power(k) for k in range(deg + 1)), F.lit(0.0))
    flat = F.col(v) - line + (F.col("__mean") if keep_mean else F.lit(0.0))
    return scaled.join(fitted, names).withColumn(out, flat).drop("__u", "__c", "__mean")


def deseasonalise(df: DataFrame, key: Key, month: str | Column, v: str, out: str | None = None, keep_mean: bool = True) -> DataFrame:
    """Removes each key's mean of the month; the overall mean stays unless keep_mean is false."""
    names = keys(key)
    of_month = F.avg(v).over(Window.partitionBy(*names, month))
    level = F.avg(v).over(Window.partitionBy(*names)) if keep_mean else F.lit(0.0)
    return df.withColumn(out or v, F.col(v) - of_month + level)


def fitted_trend(df: DataFrame, key: Key, t: str, v: str, out: str = "trend") -> DataFrame:
    """The fitted line of the mean-removed series."""
    return df.withColumn(out, trend_line(key, t, v))


def residual(df: DataFrame, key: Key, t: str, month: str | Column, v: str, out: str = "residual") -> DataFrame:
    """What trend and month means leave."""
    return deseasonalise(detrend(df, key, t, v, out, keep_mean=False), key, month, out, keep_mean=False)


def _uniform(df: DataFrame, t: str, v: str, out: str, part) -> DataFrame:
    """Subtracts from every cell what ``part`` takes from the spatial mean series."""
    mean = df.groupBy(t).agg(F.avg(v).alias("__m")).withColumn("__one", F.lit(0))
    taken = part(mean).select(t, (F.col("__m") - F.col("__f")).alias("__d"))
    return df.join(taken, t).withColumn(out, F.col(v) - F.col("__d")).drop("__d")


def detrend_uniform(df: DataFrame, t: str, v: str, out: str | None = None) -> DataFrame:
    """The trend of the spatial mean series is taken from every cell."""
    return _uniform(df, t, v, out or v, lambda mean: detrend(mean, "__one", t, "__m", "__f"))


def deseasonalise_uniform(df: DataFrame, t: str, v: str, month: Column, out: str | None = None) -> DataFrame:
    """The season of the spatial mean series is taken from every cell; month is an expression of t."""
    return _uniform(df, t, v, out or v, lambda mean: deseasonalise(mean.withColumn("__month", month), "__one", "__month", "__m", "__f"))


def whole_series(key: Key, t: str):
    return Window.partitionBy(*keys(key)).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def change_from_start(df: DataFrame, key: Key, t: str, v: str, out: str = "change", percent: bool = False, base: str = "initial", flip: bool = False) -> DataFrame:
    """v less the first v, in percent of the first (base='initial') or of itself (base='current'); flip gives first less v."""
    if base not in ("initial", "current"):
        raise ValueError(f"base is {base}; known are initial and current")
    first = F.first(v).over(whole_series(key, t))
    change = first - F.col(v) if flip else F.col(v) - first
    under = first if base == "initial" else F.col(v)
    return df.withColumn(out, F.when(under != 0, change / under * 100.0) if percent else change)


def elapsed_years(df: DataFrame, key: Key, days: str, out: str = "years", year_days: float = 365.0) -> DataFrame:
    """Years since each run's start."""
    return df.withColumn(out, (F.col(days) - F.min(days).over(Window.partitionBy(*keys(key)))) / year_days)


def cumulative(df: DataFrame, key: Key, t: str, rate: str | Column, dt: str | Column, out: str = "total") -> DataFrame:
    """The running sum of rate * dt."""
    step = (F.col(rate) if isinstance(rate, str) else rate) * (F.col(dt) if isinstance(dt, str) else dt)
    return ordered.running_sums(df, key, t, {out: step})


def budget(df: DataFrame, key: Key, t: str, dt: str, surface: str, line: str, migration: str, floating_surface: str, calving: str, basal: str) -> DataFrame:
    """Cumulative closure of the mass budget of grounded and floating parts, each with and without line migration."""
    c = F.col
    rates = {
        "grounded": c(surface) - c(line) - c(migration),
        "grounded_no_migration": c(surface) - c(line),
        "floating": c(floating_surface) + c(line) + c(migration) - c(calving) + c(basal),
        "floating_no_migration": c(floating_surface) + c(line) - c(calving) + c(basal),
    }
    return ordered.running_sums(df, key, t, {name: rate * c(dt) for name, rate in rates.items()})


def totals_without(df: DataFrame, run: Key, t: str, region: str, v: str, left_out: str) -> DataFrame:
    """Sums over regions, of all and of all but one."""
    return df.groupBy(*keys(run), t).agg(F.sum(v).alias("total"), F.sum(F.when(~F.col(region).eqNullSafe(left_out), F.col(v))).alias("total_without"))


def normalise(df: DataFrame, key: Key, v: str, out: str | None = None, guard: float = 1e-10) -> DataFrame:
    """(v - mean) / deviation of the key (population); constant series are divided by guard. Adds mean and deviation."""
    w = Window.partitionBy(*keys(key))
    df = df.withColumns({f"{v}_mean": F.avg(v).over(w), f"{v}_std": F.stddev_pop(v).over(w)})
    return df.withColumn(out or v, (F.col(v) - F.col(f"{v}_mean")) / F.when(F.col(f"{v}_std") == 0, F.lit(guard)).otherwise(F.col(f"{v}_std")))


def unnormalise(df: DataFrame, v: str, mean: str, std: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or v, F.col(v) * F.col(std) + F.col(mean))


def rate_between(df: DataFrame, key: Key, t: str, v: str, first: tuple, last: tuple, years: float, out: str = "rate") -> DataFrame:
    """(mean over the last time range - mean over the first) / years for each key; both ranges are closed."""
    within = lambda r: F.avg(F.when(F.col(t).between(*r), F.col(v)))
    return df.groupBy(*keys(key)).agg(((within(last) - within(first)) / years).alias(out))


def _on_line(target: str) -> Column:
    return F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * ((F.col(target) - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t")))


def interpolate(df: DataFrame, key: Key, t: str, v: str, targets: DataFrame, target: str = "target") -> DataFrame:
    """Linear values at the target times inside each series' own range: (key, target, v)."""
    near = ordered.between(df, key, t, v, targets, target, inside=True)
    last = F.col("__b").isNull()
    return near.select(*keys(key), target, F.when(last, F.col("__a.v")).otherwise(_on_line(target)).alias(v))


def interpolate_clamped(df: DataFrame, key: Key, t: str, v: str, targets: DataFrame, target: str = "target", most: int | None = ordered.MOST) -> DataFrame:
    """As interpolate, but beyond a series' ends its end values hold. targets may carry the key columns. most: see ``blocked``."""
    value = F.when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a").isNull(), F.col("__b.v")).otherwise(_on_line(target))
    return ordered.between(df, key, t, v, targets, target, inside=False, most=most).select(*keys(key), target, value.alias(v))


def climatology_repeated(df: DataFrame, key: Key, t: str, v: str, steps: DataFrame, step: str = "t_idx") -> DataFrame:
    """Each key's month means, repeated over the steps (month = step mod 12): (key, step, v)."""
    names = keys(key)
    mean = df.groupBy(*names, F.pmod(F.col(t), F.lit(12)).alias("__month")).agg(F.avg(v).alias(v))
    return steps.select(step, F.pmod(F.col(step), F.lit(12)).alias("__month")).join(mean, "__month").select(*names, step, v)


def add_over_window(base: DataFrame, extra: DataFrame, key: Key, t: str, v: str, base_start: int, extra_start: int = 0, length: int | None = None, only_window: bool = False) -> DataFrame:
    """base plus extra, where base's step base_start meets extra's extra_start; outside the window base stays, or is left out
    when only_window. Raises ValueError if the two do not cover the same steps of the window."""
    names = keys(key)
    moved = extra.filter(F.col(t) >= extra_start).select(*names, (F.col(t) - extra_start + base_start).alias(t), F.col(v).alias("__x"))
    inside = F.col(t) >= base_start
    if length is not None:
        inside = inside & (F.col(t) < base_start + length)
        moved = moved.filter(F.col(t) < base_start + length)
    steps = base.filter(inside).select(F.lit(0).alias("__of"), t).union(moved.select(F.lit(1), t)).groupBy("__of").agg(F.count_distinct(t).alias("n"))
    n = {r["__of"]: r.n for r in steps.collect()}  # two rows
    if n.get(0, 0) != n.get(1, 0):
        raise ValueError(f"the window has {n.get(0, 0)} steps in one series and {n.get(1, 0)} in the other")
    joined = base.join(moved, [*names, t], "left")
    out = joined.withColumn(v, F.when(inside, F.col(v) + F.col("__x")).otherwise(F.col(v))).drop("__x")
    return out.filter(inside) if only_window else out


def apply_to_members(base: DataFrame, trends: DataFrame, member: str, cell: str, t: str, v: str, start: int) -> tuple[DataFrame, DataFrame]:
    """Every member's forcing with its trend added from ``start`` on, and (member, ok): whether both have the same steps from
    there. Members that do not are left out."""
    a = base.filter(F.col(t) >= start).groupBy(member).agg(F.count_distinct(t).alias("a"))
    b = trends.groupBy(member).agg(F.count_distinct(t).alias("b"))
    state = a.join(b, member, "full").select(member, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))
    good = state.filter("ok").select(member)
    moved = trends.join(good, member, "left_semi").select(member, cell, (F.col(t) + start).alias(t), F.col(v).alias("__x"))
    joined = base.join(good, member, "left_semi").join(moved, [member, cell, t], "left")
    return joined.withColumn(v, F.when(F.col(t) >= start, F.col(v) + F.col("__x")).otherwise(F.col(v))).drop("__x"), state
