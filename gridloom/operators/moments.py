"""What parts of a growing cube know of its cells' trends and seasons, as sums that add up in any order.

A part's state has a row for each cell and month: how many values, and the sums of t, t * t, v, t * v and v * v, with t and v
taken from an origin that all parts share. Sums of states are states, so parts may come in any order, as files or as a
stream, and be added up in any tree. ``finished`` gives what a fit over all values in one go would give: mean, slope, the
season that is left when the trend is out, and the variance that is left when both are out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import Key, keys

SUMS = ("n", "s_t", "s_tt", "s_v", "s_tv", "s_vv")


def state(df: DataFrame, key: Key, t: str | Column, month: str | Column, v: str, t0: float = 0.0, v0: float = 0.0) -> DataFrame:
    """(key, month, sums) of the rows that have both t and v."""
    x = (F.col(t) if isinstance(t, str) else t).cast("double") - t0
    own = df.select(*keys(key), (F.col(month) if isinstance(month, str) else month).cast("int").alias("month"), x.alias("__x"), (F.col(v).cast("double") - v0).alias("__y"))
    own = own.filter(F.col("__x").isNotNull() & F.col("__y").isNotNull())
    x, y = F.col("__x"), F.col("__y")
    return own.groupBy(*keys(key), "month").agg(F.count("*").alias("n"), *(F.sum(c).alias(s) for s, c in zip(SUMS[1:], (x, x * x, y, x * y, y * y), strict=True)))


def merged(*parts: DataFrame, key: Key) -> DataFrame:
    """The state of all parts."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys(key), "month").agg(*(F.sum(s).alias(s) for s in SUMS))


def finished(parts: DataFrame, key: Key, v0: float = 0.0) -> DataFrame:
    """(key, n, mean, slope, seasons, left) of a state, which may have several rows for a cell and month. seasons: an array of
    (month, n, season), the month's mean after detrending, less the mean, and the count that it has. left: the population
    variance of what trend and season leave. A cell with one time only has no trend."""
    months = merged(parts, key=key)
    entry = F.struct("month", *SUMS)
    own = months.groupBy(*keys(key)).agg(*(F.sum(s).alias(s) for s in SUMS), F.sort_array(F.collect_list(entry)).alias("__m"))  # twelve entries a cell
    spread = F.col("s_tt") - F.col("s_t") * F.col("s_t") / F.col("n")
    joint = F.col("s_tv") - F.col("s_t") * F.col("s_v") / F.col("n")
    flat = spread <= F.col("s_tt") * 1e-14
    own = own.withColumn("slope", F.when(flat, F.lit(0.0)).otherwise(joint / spread)).withColumns({"__t": F.col("s_t") / F.col("n"), "__v": F.col("s_v") / F.col("n")})

    def season(m: Column) -> Column:
        return (m["s_v"] - F.col("slope") * (m["s_t"] - m["n"] * F.col("__t"))) / m["n"] - F.col("__v")

    def rest(m: Column) -> Column:
        """The squares that are left around a month's own mean, once the trend is out."""
        st, sv = m["s_t"], m["s_v"]
        tt, tv, vv = m["s_tt"] - st * st / m["n"], m["s_tv"] - st * sv / m["n"], m["s_vv"] - sv * sv / m["n"]
        return vv - 2 * F.col("slope") * tv + F.col("slope") * F.col("slope") * tt

    seasons = F.transform("__m", lambda m: F.struct(m["month"].alias("month"), m["n"].alias("n"), season(m).alias("season")))
    left = F.greatest(F.aggregate("__m", F.lit(0.0), lambda a, m: a + rest(m)) / F.col("n"), F.lit(0.0))
    return own.select(*keys(key), "n", (F.col("__v") + v0).alias("mean"), "slope", seasons.alias("seasons"), left.alias("left"))
