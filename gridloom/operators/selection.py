"""Exact quantiles of few keys with very many values.

Spark's own exact percentile gathers all distinct values of a key in one task. Here a key's values are narrowed first: the
grouping that the caller makes anyway also keeps a mergeable sketch, which gives a band around each wanted rank that surely
holds it. A second pass counts what lies below each band and, by value, what lies in it; only these counts, some 6 in
``ACCURACY`` of a key's rows, meet in one task, which finds the ranks by a running sum. Keys of up to ``ACCURACY`` values have
one band, all of them. Results are those of exact percentiles, to the last bit: between two ranks they are interpolated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

ACCURACY = 10_000
#: How far from a rank its band begins and ends, as a share of the rows: the sketch may be off by one ``ACCURACY``-th.
MARGIN = 3 / ACCURACY


def sketch(v: str, shares: Sequence[float]) -> Column:
    """What ``exact`` needs of a key, to be kept by the caller's own grouping: an aggregate, mergeable map-side."""
    ends = [min(max(p + s * MARGIN, 0.0), 1.0) for p in shares for s in (-1, 1)]
    return F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, F.array(*(F.lit(e) for e in ends)), ACCURACY).alias("ends"))


def exact(df: DataFrame, grouped: DataFrame, names: Sequence[str], v: str, shares: Sequence[float], sketched: str = "__sketch", out: str = "__q") -> DataFrame:
    """grouped with an array of the quantiles of v as ``out`` instead of its column ``sketched``. df: the rows that were grouped
    by ``names``. A key without values has null quantiles."""
    grouped = stored(grouped, "selection")
    s = F.col(sketched)
    wide = F.struct(F.lit(-1).alias("i"), s["lo"].cast("double").alias("lo"), s["hi"].cast("double").alias("hi"))
    band = lambda i: F.struct(F.lit(i).alias("i"), s["ends"][2 * i].cast("double").alias("lo"), s["ends"][2 * i + 1].cast("double").alias("hi"))
    bands = F.when(s["n"] <= ACCURACY, F.array(wide)).otherwise(F.array(*map(band, range(len(shares)))))
    told = grouped.select(*(F.col(n).alias(f"__{n}") for n in names), bands.alias("__bands"))
    rows = df.filter(F.col(v).isNotNull()).select(*names, F.col(v).cast("double").alias("__v"))
    same = lambda x, y: reduce(lambda a, b: a & b, (x[n].eqNullSafe(y[f"__{n}"]) for n in names), F.lit(True))
    met = rows.join(told, same(rows, told)).select(*names, "__v", F.explode("__bands").alias("__band")).filter(F.col("__v") <= F.col("__band.hi"))
    counts = met.groupBy(*names, F.col("__band.i").alias("__i"), F.when(F.col("__v") >= F.col("__band.lo"), F.col("__v")).alias("__value")).agg(F.count("*").alias("__c"))
    # what lies below the band is one null value, which comes first
    upto = F.sum("__c").over(Window.partitionBy(*names, "__i").orderBy(F.asc_nulls_first("__value")).rowsBetween(Window.unboundedPreceding, 0))
    n = grouped.select(*(F.col(x).alias(f"__{x}") for x in names), s["n"].alias("__n"))
    ranked = counts.withColumn("__upto", upto)
    ranked = ranked.join(n, same(ranked, n))
    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in shares]
    first_over = lambda j, rank: F.min(F.when(F.col("__i").isin(-1, j) & (F.col("__upto") > rank), F.col("__value")))
    found = ranked.groupBy(*names).agg(F.first("__n").alias("__n"), *(x for j, p in enumerate(at) for x in (first_over(j, F.floor(p)).alias(f"__lo{j}"), first_over(j, F.ceil(p)).alias(f"__hi{j}"))))

    def value(j: int) -> Column:
        lo, hi, p = F.col(f"__lo{j}"), F.col(f"__hi{j}"), at[j]
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    listed = found.select(*(F.col(x).alias(f"__{x}") for x in names), F.array(*map(value, range(len(shares)))).alias(out))
    return grouped.join(listed, same(grouped, listed), "left").drop(sketched, *(f"__{x}" for x in names))


def quantiles_of(df: DataFrame, names: Sequence[str], v: str, *shares: float, out: str = "__q") -> DataFrame:
    """(key, out): exact quantiles alone."""
    return exact(df, df.groupBy(*names).agg(sketch(v, shares).alias("__sketch")), names, v, shares, out=out)
