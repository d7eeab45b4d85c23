"""Means, distributions and summaries of gridded fields, ensembles and regions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import selection
from .timeseries import Key, keys


def time_mean(df: DataFrame, key: Key, *values: str) -> DataFrame:
    return df.groupBy(*keys(key)).agg(*(F.avg(v).alias(v) for v in values))


def spatial_mean(df: DataFrame, t: Key, *values: str) -> DataFrame:
    """The mean over cells for each time (and region, when t names it too)."""
    return df.groupBy(*keys(t)).agg(*(F.avg(v).alias(v) for v in values))


def spatial_sum(df: DataFrame, t: Key, *values: str) -> DataFrame:
    return df.groupBy(*keys(t)).agg(*(F.sum(v).alias(v) for v in values))


def minus_grand_mean(df: DataFrame, v: str, out: str | None = None) -> DataFrame:
    mean = df.agg(F.avg(v).alias("__mean"))  # one row
    return df.crossJoin(mean).withColumn(out or v, F.col(v) - F.col("__mean")).drop("__mean")


def annual_mean(df: DataFrame, key: Key, year: str | Column, v: str) -> DataFrame:
    return df.groupBy(*keys(key), year).agg(F.avg(v).alias(v))


def coarsen_time(df: DataFrame, key: Key, t: str, v: str, size: int = 12) -> DataFrame:
    """Means of ``size`` steps; raises ValueError unless the steps divide evenly."""
    n = df.select(t).distinct().count()
    if n % size:
        raise ValueError(f"{n} steps do not divide into groups of {size}")
    return df.groupBy(*keys(key), F.floor(F.col(t) / size).cast("int").alias(t)).agg(F.avg(v).alias(v))


def coarsen_space(df: DataFrame, t: Key, ix: str, iy: str, x: str, y: str, factor: int, *values: str) -> DataFrame:
    """Means of factor x factor blocks counted from index 0; the columns and rows that do not fill a block are trimmed."""
    size = df.agg((F.max(ix) + 1).alias("nx"), (F.max(iy) + 1).alias("ny"))  # one row
    cut = lambda c, n: F.col(c) < F.floor(F.col(n) / factor) * factor
    kept = df.crossJoin(size).filter(cut(ix, "nx") & cut(iy, "ny"))
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in (ix, iy)]
    return kept.groupBy(*keys(t), *block).agg(*(F.avg(c).alias(c) for c in (x, y, *values)))


def climatology(df: DataFrame, key: Key, month: str | Column, v: str) -> DataFrame:
    return df.groupBy(*keys(key), month).agg(F.avg(v).alias(v))


def partial_means(df: DataFrame, part: str, key: Key, v: str) -> DataFrame:
    """(part, key, mean, n): what a part of the series knows; merged_mean adds parts up in any order."""
    return df.groupBy(part, *keys(key)).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def merged_mean(parts: DataFrame, key: Key, out: str = "mean") -> DataFrame:
    """The mean over all parts, weighted by their counts."""
    return parts.groupBy(*keys(key)).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias(out), F.sum("n").alias("n"))


def variance_map(df: DataFrame, key: Key, v: str) -> DataFrame:
    return df.groupBy(*keys(key)).agg(F.var_pop(v).alias("variance"))


def coverage(df: DataFrame, key: Key, *values: str) -> DataFrame:
    """The share of rows with a value, for each field."""
    return df.groupBy(*keys(key)).agg(*((F.count(v) / F.count("*")).alias(f"{v}_coverage") for v in values))


def most_frequent(df: DataFrame, key: Key, v: str, out: str = "mode") -> DataFrame:
    """Each key's most frequent value; among equals the smallest. Counts first, so a key's rows never meet in one task."""
    n = df.filter(F.col(v).isNotNull()).groupBy(*keys(key), v).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys(key)).agg(F.max_by(v, F.struct("__n", -F.col(v))).alias(out))


def first_nonzero(df: DataFrame, key: Key, order: Sequence[str], *values: str) -> DataFrame:
    """The first value that is neither missing nor 0, in the given order of rows; 0 where there is none."""
    at = F.struct(*order)
    pick = lambda v: F.min_by(v, F.when(F.col(v).isNotNull() & (F.col(v) != 0), at))
    return df.groupBy(*keys(key)).agg(*(F.coalesce(pick(v), F.lit(0.0)).alias(v) for v in values))


def summary(df: DataFrame, key: Key, v: str, name: str | None = None) -> DataFrame:
    """total, mean, max and min of v for each key; with name also which row's name has the max and the min."""
    own = [F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("highest"), F.min(v).alias("lowest")]
    if name:
        own += [F.max_by(name, F.struct(v, name)).alias("highest_name"), F.min_by(name, F.struct(v, name)).alias("lowest_name")]
    return df.groupBy(*keys(key)).agg(*own)


def ensemble_stats(df: DataFrame, key: Key, v: str) -> DataFrame:
    """mean, min, max, range and deviation (population) over members."""
    return df.groupBy(*keys(key)).agg(F.avg(v).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"), (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("std"))


def spread_against_change(df: DataFrame, cell: Key, member: str, t: str, v: str, step: int = -1, least: float = 10.0, guard: float = 1e-6) -> DataFrame:
    """Per cell: the members' range at a step (-1: the last of all), their mean change since the first step, and the ratio
    range / (|change| + guard), null where |change| < least."""
    ends = df.agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"))  # one row
    now = F.col("__t1") if step == -1 else F.lit(step)
    own = df.crossJoin(ends).filter((F.col(t) == F.col("__t0")) | (F.col(t) == now))
    per_member = own.groupBy(*keys(cell), member).agg(F.max(F.when(F.col(t) == now, F.col(v))).alias("__now"), F.max(F.when(F.col(t) == F.col("__t0"), F.col(v))).alias("__then"))
    out = per_member.groupBy(*keys(cell)).agg((F.max("__now") - F.min("__now")).alias("range"), F.avg(F.col("__now") - F.col("__then")).alias("change"))
    return out.withColumn("ratio", F.when(F.abs("change") >= least, F.col("range") / (F.abs("change") + guard)))


def with_quantiles(df: DataFrame, key: Key, v: str, shares: Sequence[float], own: Sequence[Column], exact: bool) -> DataFrame:
    """(key, own aggregates, __q: an array of quantiles). Exact ones take a second pass over df, in which no task holds more than
    some thousandths of a key (``selection``); exact=False keeps to mergeable sketches."""
    if exact:
        return selection.exact(df, df.groupBy(*keys(key)).agg(*own, selection.sketch(v, shares).alias("__sketch")), keys(key), v, shares)
    return df.groupBy(*keys(key)).agg(*own, F.percentile_approx(v, F.array(*map(F.lit, shares)), selection.ACCURACY).alias("__q"))


def field_summary(df: DataFrame, key: Key, v: str, threshold: float, exact: bool = True) -> DataFrame:
    """Mean, median, deviation, maximum, quartiles, 90th percentile and how many values lie above threshold."""
    own = (F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("highest"), F.sum(F.when(F.col(v) > threshold, 1).otherwise(0)).alias("n_above"))
    out = with_quantiles(df, key, v, (0.25, 0.5, 0.75, 0.9), own, exact)
    return out.select(*keys(key), "mean", "std", "highest", *(F.col("__q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75", "q90"))), "n_above")


def distribution(df: DataFrame, key: Key, v: str, flat: float = 1e-10, exact: bool = True) -> DataFrame:
    """Members' mean, deviation, median, quartiles, skewness and excess kurtosis (0 for a deviation of up to flat)."""
    moments = (F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("__s"), F.kurtosis(v).alias("__k"))
    own = with_quantiles(df, key, v, (0.25, 0.5, 0.75), moments, exact)
    shape = [F.when(F.col("std") > flat, F.col(c)).otherwise(0.0).alias(n) for c, n in (("__s", "skewness"), ("__k", "kurtosis"))]
    return own.select(*keys(key), "n", "mean", "std", *(F.col("__q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))), *shape)


def enough_members(df: DataFrame, key: Key, v: str, members: int) -> DataFrame:
    """The keys with values of at least max(3, half of the members)."""
    return df.groupBy(*keys(key)).agg(F.count(v).alias("n")).filter(F.col("n") >= max(3, int(0.5 * members)))


def histogram(df: DataFrame, key: Key, v: str, bins: int = 50) -> DataFrame:
    """(key, bin, low, n, density) of equal bins between each key's extremes; the maximum lies in the last bin."""
    names = keys(key)
    ends = df.groupBy(*names).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(v).alias("__n"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(v) - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = df.filter(F.col(v).isNotNull()).join(ends, names).groupBy(*names, at.alias("bin")).agg(F.count("*").alias("n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"), F.first("__n").alias("__n"))
    return counted.select(*names, "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), "n", F.when(width > 0, F.col("n") / F.col("__n") / width).alias("density"))


def auto_bins(df: DataFrame, key: Key, v: str, exact: bool = True) -> DataFrame:
    """How many equal bins the finer of Sturges' and Freedman-Diaconis' widths gives."""
    own = with_quantiles(df, key, v, (0.25, 0.75), (F.count(v).alias("__n"), (F.max(v) - F.min(v)).alias("__r")), exact)
    sturges = F.col("__r") / (F.log2("__n") + 1)
    fd = 2 * (F.col("__q")[1] - F.col("__q")[0]) / F.pow("__n", F.lit(1 / 3))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    return own.select(*keys(key), F.when(F.col("__r") > 0, F.ceil(F.col("__r") / width)).otherwise(1).cast("int").alias("bins"))


def normal_fit(df: DataFrame, key: Key, v: str, points: int = 100) -> DataFrame:
    """(key, point, x, density): the fitted normal density on equal steps between the extremes."""
    import math

    own = df.groupBy(*keys(key)).agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sigma"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    out = own.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("point") / (points - 1)
    density = F.exp(-0.5 * F.pow((F.col("x") - F.col("mu")) / F.col("sigma"), F.lit(2))) / (F.col("sigma") * math.sqrt(2 * math.pi))
    return out.withColumn("x", x).withColumn("density", density).select(*keys(key), "point", "mu", "sigma", "x", "density")


#: Bandwidths beyond which a kernel is less than 1e-16 of its middle.
REACH = 8.7


def kernel_density(df: DataFrame, key: Key, v: str, points: int = 300, margin: float = 0.1) -> DataFrame:
    """(key, point, x, density): Gaussian kernels on points that all keys share, over the whole range and a margin; the
    bandwidth is the sample deviation times n**(-1/5). Values are counted first, so repeats cost nothing, and a value meets
    only the points within ``REACH`` bandwidths, whose numbers follow from its own place. Keys of one value, or of equal ones,
    have no density (null)."""
    import math

    names = keys(key)
    ends = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))  # one row
    span = F.col("__hi") - F.col("__lo")
    place = lambda i: F.col("__lo") - margin * span + span * (1 + 2 * margin) * i / (points - 1)
    deviation = F.stddev_samp(v)
    width = df.groupBy(*names).agg(F.when(deviation > 0, deviation * F.pow(F.count(v), F.lit(-0.2))).alias("__h"), F.count(v).alias("__n")).filter("__n > 0").crossJoin(ends)
    counted = df.filter(F.col(v).isNotNull()).groupBy(*names, v).agg(F.count("*").alias("__k")).join(width, names).filter("__h is not null")
    number = lambda x: (x - place(F.lit(0))) / (span * (1 + 2 * margin) / (points - 1))
    low = F.greatest(F.ceil(number(F.col(v) - REACH * F.col("__h"))), F.lit(0)).cast("int")
    high = F.least(F.floor(number(F.col(v) + REACH * F.col("__h"))), F.lit(points - 1)).cast("int")
    near = counted.withColumns({"__a": low, "__b": high}).filter("__a <= __b").withColumn("point", F.explode(F.sequence("__a", "__b")))
    kernel = F.col("__k") * F.exp(-0.5 * F.pow((place(F.col("point")) - F.col(v)) / F.col("__h"), F.lit(2))) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    found = near.groupBy(*names, "point").agg(F.sum(kernel).alias("__d"))
    grid = width.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*names, "point", place(F.col("point")).alias("x"), "__h")
    out = grid.join(found, [*names, "point"], "left")
    return out.select(*names, "point", "x", F.when(F.col("__h").isNotNull(), F.coalesce("__d", F.lit(0.0))).alias("density"))


def robust_limits(df: DataFrame, key: Key, v: str, low: float = 0.01, high: float = 0.99, exact: bool = True) -> DataFrame:
    """Percentiles and the largest magnitude of v, for symmetric scales."""
    own = with_quantiles(df, key, v, (low, high), (F.max(F.abs(v)).alias("largest"),), exact)
    return own.select(*keys(key), F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"), "largest")


def last_value(df: DataFrame, key: Key, t: str, v: str) -> DataFrame:
    return df.groupBy(*keys(key)).agg(F.max(t).alias(t), F.max_by(v, t).alias(v))


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in an order."""
    return df.orderBy(*order).limit(k)


def every_nth(df: DataFrame, key: Key, order: str, step: int) -> DataFrame:
    """Every step-th row of each key, from the first. Rows are put in order by ranges of (key, order), so a large key lies in
    many tasks; each task numbers its own rows, and starts where the tasks before it have ended."""
    names = keys(key)
    ranged = df.repartitionByRange(*names, order).withColumn("__nth_task", F.spark_partition_id())
    own = stored(ranged, "every-nth")  # the ranges are drawn from samples, so they must not be drawn again
    copies = {c: f"__nth_key{i}" for i, c in enumerate(names)}
    before = Window.partitionBy(*copies.values()).orderBy("__nth_of").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.groupBy(*(F.col(c).alias(x) for c, x in copies.items()), F.col("__nth_task").alias("__nth_of")).agg(F.count("*").alias("__nth_rows"))
    ahead = rows.withColumn("__nth_ahead", F.coalesce(F.sum("__nth_rows").over(before), F.lit(0)))
    numbered = own.withColumn("__nth_row", F.row_number().over(Window.partitionBy(*names, "__nth_task").orderBy(order)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(x)) for c, x in copies.items()), F.col("__nth_task") == F.col("__nth_of"))
    return numbered.join(ahead, same).filter(F.pmod(F.col("__nth_row") + F.col("__nth_ahead") - 1, F.lit(step)) == 0).select(*df.columns)


def sample_per_key(df: DataFrame, key: Key, order: Column, most: int = 2000) -> DataFrame:
    """At most ``most`` rows of each key, the first by ``order`` (rand(seed), or a hash for a sample that stays). A key's rows
    are first thinned out in 64 parts, so no task holds a large key."""
    part = F.row_number().over(Window.partitionBy(*keys(key), "__part").orderBy("__o"))
    thin = df.withColumn("__o", order).withColumn("__part", F.pmod(F.xxhash64("__o"), F.lit(64))).withColumn("__n", part).filter(F.col("__n") <= most)
    n = F.row_number().over(Window.partitionBy(*keys(key)).orderBy("__o"))
    return thin.withColumn("__n", n).filter(F.col("__n") <= most).drop("__o", "__n", "__part")


def autocorrelation(df: DataFrame, key: Key, t: str, v: str, lags: int | None = None) -> DataFrame:
    """(key, lag, r): sums of products of the mean-removed series at each lag up to ``lags`` (all), over their maximum. t counts
    steps; missing ones add nothing. A series of T steps goes to one task as a whole, which takes T log T (a product of
    Fourier transforms), so it must be a regional mean or a mode, not a cube."""
    names = keys(key)

    def of_key(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[t].to_numpy(np.int64)
        a = np.zeros(at.max() - at.min() + 1)
        seen = np.zeros(len(a))
        np.add.at(a, at - at.min(), pdf[v].to_numpy(float) - pdf[v].mean())
        np.add.at(seen, at - at.min(), 1)
        size = 1 << (2 * len(a) - 1).bit_length()
        product = lambda x: np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(a)]
        s, pairs = product(a), np.rint(product(seen))
        lag = np.flatnonzero(pairs > 0)
        s = s[lag] / s[lag].max() if s[lag].max() > 0 else np.full(len(lag), np.nan)
        keep = slice(None) if lags is None else lag <= lags
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] * len(lag[keep]) for n in names}, "lag": lag[keep].astype(np.int32), "r": s[keep]})

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return df.filter(F.col(v).isNotNull() & F.col(t).isNotNull()).groupBy(*names).applyInPandas(of_key, f"{kinds}, lag int, r double")


def power_spectrum(df: DataFrame, key: Key, t: str, v: str) -> DataFrame:
    """(key, frequency, power): the periodogram |rfft|^2 / n of the mean-removed series, cycles a step. A series goes to one
    task as a whole, so it must be a regional mean or a mode, not a cube."""

    def spectrum(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.fft.rfftfreq(len(y)), np.abs(np.fft.rfft(y - y.mean())) ** 2 / len(y)

    return _spectra(df, key, t, v, spectrum)


def mean_spectrum(df: DataFrame, key: Key, t: str, v: str, size: int = 256, rate: float = 2.0) -> DataFrame:
    """(key, frequency, power): the density averaged over pieces of ``size`` steps without overlap (Welch's method), each under
    a Hann window; a shorter series is filled up with zeros, a rest shorter than a piece is left out. One-sided: all but the
    first and last frequency count twice. ``rate``: steps a unit of time. A series goes to one task, as in power_spectrum."""

    def spectrum(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.pad(y, (0, max(0, size - len(y))))
        window = np.hanning(size)
        pieces = y[: len(y) // size * size].reshape(-1, size) * window
        power = (np.abs(np.fft.rfft(pieces, axis=1)) ** 2).mean(0) / (rate * (window**2).sum())
        power[1 : -1 if size % 2 == 0 else None] *= 2
        return np.fft.rfftfreq(size, 1 / rate), power

    return _spectra(df, key, t, v, spectrum)


def _spectra(df: DataFrame, key: Key, t: str, v: str, spectrum: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    names = keys(key)

    def of_key(pdf: pd.DataFrame) -> pd.DataFrame:
        frequency, power = spectrum(pdf.sort_values(t)[v].to_numpy(float))
        out = pd.DataFrame({"frequency": frequency, "power": power})
        for n in reversed(names):
            out.insert(0, n, pdf[n].iloc[0])
        return out

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return df.filter(F.col(v).isNotNull()).groupBy(*names).applyInPandas(of_key, f"{kinds}, frequency double, power double")
