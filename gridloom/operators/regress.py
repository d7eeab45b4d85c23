"""Regression of melt on draft per region: quality gate, bins, thresholds, piecewise fits, choice of a model, skill.

Every step is one grouped job over all regions (and parameter sets); only the change point of a binned curve, at most
``n_bins`` values a region, is found in numpy. What points need to know of their region is a row a region. It is written
before points meet it (``kept``), so that Spark sees how small it is and points stay where they are: an exchange of the points
by region would put all points of a region into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import piecewise_three, threshold_weight
from ..sources.shared import kept, stored
from . import changepoint, selection
from .stats import with_quantiles
from .timeseries import Key, keys


def valid_points(df: DataFrame, draft: str, melt: str) -> DataFrame:
    """Rows with both values, a positive draft and no negative melt."""
    return df.filter(F.col(draft).isNotNull() & F.col(melt).isNotNull() & (F.col(draft) > 0) & (F.col(melt) >= 0))


def clip_quantiles(df: DataFrame, key: Key, draft: str, low: float = 0.01, high: float = 0.99, exact: bool = True) -> DataFrame:
    """Rows within each key's quantile band of draft."""
    band = kept(with_quantiles(df, key, draft, (low, high), (), exact), "regress")
    return df.join(band, keys(key)).filter(F.col(draft).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def draft_regression(df: DataFrame, key: Key, draft: str, melt: str, weight: str | None = None, missing: str = "drop") -> DataFrame:
    """(key, slope, intercept, n): melt = slope * draft + intercept. missing='zero' counts missing values as 0, as points of
    the fit (of weight 0 in a weighted one); 'drop' leaves them out."""
    if missing not in ("drop", "zero"):
        raise ValueError(f"missing is {missing}; known are drop and zero")
    x, y = F.col(draft), F.col(melt)
    both = x.isNotNull() & y.isNotNull()
    if missing == "zero":
        x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    else:
        x, y = F.when(both, x), F.when(both, y)
    names = keys(key)
    if weight is None:
        return df.groupBy(*names).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))
    w = F.when(both, F.coalesce(F.col(weight), F.lit(0.0))).otherwise(0.0)
    # centred on the group's mean draft, so that large drafts do not cancel digits
    mid = kept(df.groupBy(*names).agg((F.sum(w * F.coalesce(x, F.lit(0.0))) / F.sum(w)).alias("__mid")), "regress")
    u = F.coalesce(x, F.lit(0.0)) - F.col("__mid")
    v = F.coalesce(y, F.lit(0.0))
    s = df.join(mid, names).groupBy(*names).agg(F.first("__mid").alias("__mid"), F.sum(w).alias("__w"), F.sum(w * u).alias("__x"), F.sum(w * v).alias("__y"), F.sum(w * u * u).alias("__xx"), F.sum(w * u * v).alias("__xy"), F.sum(F.when(w > 0, 1).otherwise(0)).alias("n"))
    slope = (F.col("__w") * F.col("__xy") - F.col("__x") * F.col("__y")) / (F.col("__w") * F.col("__xx") - F.col("__x") * F.col("__x"))
    s = s.withColumn("slope", slope)
    return s.select(*names, "slope", ((F.col("__y") - F.col("slope") * F.col("__x")) / F.col("__w") - F.col("slope") * F.col("__mid")).alias("intercept"), "n")


def with_fit(df: DataFrame, fits: DataFrame, key: Key, draft: str, out: str = "fit") -> DataFrame:
    """Adds the fitted value of each row."""
    return df.join(kept(fits.select(*keys(key), "slope", "intercept"), "regress"), keys(key)).withColumn(out, F.col("slope") * F.col(draft) + F.col("intercept")).drop("slope", "intercept")


def quality(df: DataFrame, key: Key, draft: str, melt: str, min_r2: float | Column = 0.1, min_corr: float | Column = 0.3, min_points: int = 20, alpha: float = 0.05) -> DataFrame:
    """(key, n, correlation, r2, p_value, melt_mean, draft_range, is_meaningful)."""
    own = df.groupBy(*keys(key)).agg(
        F.count(F.when(F.col(draft).isNotNull() & F.col(melt).isNotNull(), 1)).alias("n"),
        F.corr(draft, melt).alias("correlation"),
        F.regr_r2(melt, draft).alias("r2"),
        F.avg(melt).alias("melt_mean"),
        (F.max(draft) - F.min(draft)).alias("draft_range"),
    )

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([changepoint.t_two_sided(a, int(b)) for a, b in zip(r, n, strict=True)], dtype=float)

    own = own.withColumn("p_value", F.when((F.col("n") > 2) & F.col("correlation").isNotNull() & ~F.isnan("correlation"), p_value("correlation", "n")))
    good = (F.col("n") >= min_points) & (F.abs("correlation") >= min_corr) & (F.col("r2") >= min_r2) & (F.col("p_value") < alpha)
    return own.withColumn("is_meaningful", F.coalesce(good, F.lit(False)))


def binned(df: DataFrame, key: Key, draft: str, melt: str, n_bins: int | Column = 50, min_points: int | Column = 5, median: bool = False) -> DataFrame:
    """(key, bin, centre, draft, melt, n): equal-width bins of draft, with their middle and means (or medians of melt). The
    largest draft lies beyond the last bin and is left out; bins with fewer points are too."""
    names = keys(key)
    n_bins, min_points = (F.lit(x) if isinstance(x, int) else x for x in (n_bins, min_points))
    ends = kept(df.groupBy(*names).agg(F.min(draft).alias("__lo"), F.max(draft).alias("__hi")), "regress")
    at = F.floor((F.col(draft) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / n_bins)).cast("int")
    own = df.filter(F.col(draft).isNotNull() & F.col(melt).isNotNull()).join(ends, names).filter(F.col("__hi") > F.col("__lo")).withColumns({"bin": at, "__least": min_points, "__width": (F.col("__hi") - F.col("__lo")) / n_bins}).filter(F.col("bin") < n_bins)
    centre = F.first("__lo") + (F.col("bin") + 0.5) * F.first("__width")
    level = selection.sketch(melt, (0.5,)).alias("__sketch") if median else F.avg(melt).alias("melt")
    out = own.groupBy(*names, "bin").agg(centre.alias("centre"), F.avg(draft).alias("draft"), level, F.count("*").alias("n"), F.first("__least").alias("__least")).filter(F.col("n") >= F.col("__least")).drop("__least")
    if median:
        out = selection.exact(own, out, [*names, "bin"], melt, (0.5,))
        return out.select(*names, "bin", "centre", "draft", F.col("__q")[0].alias("melt"), "n")
    return out


def thresholds(bins: DataFrame, key: Key, method: str = "pelt", penalty: str | float = 1.0, min_bins: int = 10, min_size: int = 2, width: int = 5) -> DataFrame:
    """(key, threshold): the mean draft of the last bin before the first change point of each binned curve; the bins' median
    draft without one; null for fewer than min_bins bins. 'pelt' searches in a Gaussian kernel's space with a penalty (a
    number, or a column that is the same within a key); 'binseg' and 'window' (of ``width`` bins) look for one break by least
    squares. Breaks lie at multiples of five bins."""
    names = keys(key)
    if method not in changepoint.METHODS:
        raise ValueError(f"method is {method}; known are {', '.join(changepoint.METHODS)}")
    if not isinstance(penalty, str):
        bins, penalty = bins.withColumn("__penalty", F.lit(float(penalty))), "__penalty"

    def first_break(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        out = None
        if len(pdf) >= min_bins:
            y = pdf["melt"].to_numpy()
            if method == "pelt":
                ends = changepoint.pelt(y, "rbf", float(pdf[penalty].iloc[0]), min_size)
            elif method == "binseg":
                ends = changepoint.binary_segmentation(y, "l2", min_size=min_size, breaks=1)
            else:
                ends = changepoint.sliding_window(y, "l2", width=width, min_size=min_size, breaks=1)
            out = float(pdf["draft"].iloc[ends[0] - 1] if len(ends) > 1 else np.median(pdf["draft"]))
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in names}, "threshold": [out]})

    kinds = ", ".join(f"{n} {bins.schema[n].dataType.simpleString()}" for n in names)
    return bins.groupBy(*names).applyInPandas(first_break, f"{kinds}, threshold double")


def knees(df: DataFrame, key: Key, draft: str, melt: str, window: int = 15, poly: int = 2, smooth: bool = False, low: float | None = None, high: float | None = None, clip: tuple[float, float] = (0.01, 0.99), fallback: float = 1000.0) -> DataFrame:
    """(key, knee): the middle of the bin where the curve of the melt's medians over 99 equal bins of draft bends most; the
    fallback for fewer than 10 points. Bins without points are left out. smooth: drafts clipped to their quantiles, bins of
    more than 3 points only (the fallback for fewer than 5 such bins), a running median first, the knee bounded."""
    names = keys(key)
    own = df.filter(F.col(draft).isNotNull() & F.col(melt).isNotNull()).select(*names, draft, melt)
    n = own.groupBy(*names).agg(F.count("*").alias("points"))
    bins = binned(clip_quantiles(own, key, draft, *clip) if smooth else own, key, draft, melt, 99, 4 if smooth else 1, median=True)

    def bend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        at = fallback
        if pdf["bin"].notna().all() and pdf["points"].iloc[0] >= 10 and len(pdf) >= (5 if smooth else 2):
            at = changepoint.knee(pdf["centre"].to_numpy(), pdf["melt"].to_numpy(), window, poly, smooth)
            if smooth and low is not None:
                at = max(at, low)
            if smooth and high is not None:
                at = min(at, high)
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in names}, "knee": [at]})

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return n.join(bins, names, "left").groupBy(*names).applyInPandas(bend, f"{kinds}, knee double")


def with_moments(df: DataFrame, key: Key, *values: str) -> DataFrame:
    """Adds <value>_mean and <value>_std (of the population), the key's own, of each value; rows without a key are one."""
    names = keys(key)
    own = kept(df.groupBy(*(F.col(n).alias(f"__{n}") for n in names)).agg(*(f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("std", F.stddev_pop)))), "regress")
    return df.join(own, reduce(lambda a, b: a & b, (df[n].eqNullSafe(own[f"__{n}"]) for n in names))).drop(*(f"__{n}" for n in names))


def with_dynamic_threshold(df: DataFrame, key: Key, draft: str, melt: str, out: str = "w", smooth: bool = False, **bounds) -> DataFrame:
    """Adds the threshold weight of each row by its key's own knee."""
    at = kept(knees(df, key, draft, melt, smooth=smooth, **bounds).withColumnRenamed("knee", "__at"), "regress")
    return df.join(at, keys(key), "left").withColumn(out, threshold_weight(draft, F.col("__at"))).drop("__at")


def piecewise_fit(df: DataFrame, at: DataFrame, key: Key, draft: str, melt: str, least: int = 5, weight: str | None = None) -> DataFrame:
    """(key, threshold, shallow_mean, slope, intercept, n): the mean below each key's threshold (of all points for fewer than
    ``least``), and the line from it on (likewise). weight: of the means and lines (a missing one counts 0)."""
    names = keys(key)
    x, y = F.col(draft), F.col(melt)
    own = df.filter(x.isNotNull() & y.isNotNull()).join(kept(at.select(*names, "threshold"), "regress"), names)
    low, deep = x < F.col("threshold"), x >= F.col("threshold")
    counts = [F.first("threshold").alias("threshold"), F.count(F.when(low, 1)).alias("__nl"), F.count(F.when(deep, 1)).alias("__nd"), F.count("*").alias("n")]
    if weight is None:
        s = own.groupBy(*names).agg(
            *counts,
            F.avg(F.when(low, y)).alias("__low"), F.avg(y).alias("__all"),
            F.regr_slope(F.when(deep, y), F.when(deep, x)).alias("__ds"), F.regr_intercept(F.when(deep, y), F.when(deep, x)).alias("__di"),
            F.regr_slope(y, x).alias("__as"), F.regr_intercept(y, x).alias("__ai"),
        )
    else:
        own = own.withColumn("__w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
        mean = lambda v, on: F.sum(F.when(on, F.col("__w") * v)) / F.sum(F.when(on, F.col("__w")))
        every = F.lit(True)
        first = kept(own.groupBy(*names).agg(*counts, mean(y, low).alias("__low"), mean(y, every).alias("__all"), mean(x, deep).alias("__dx"), mean(y, deep).alias("__dy"), mean(x, every).alias("__ax"), mean(y, every).alias("__ay")), "regress")
        # centred on the weighted means, so that large drafts do not cancel digits
        both = own.drop("threshold").join(first, names)
        slope = lambda on, c: F.sum(F.when(on, F.col("__w") * (x - F.col(f"__{c}x")) * (y - F.col(f"__{c}y")))) / F.sum(F.when(on, F.col("__w") * F.pow(x - F.col(f"__{c}x"), F.lit(2))))
        s = both.groupBy(*names).agg(*(F.first(c).alias(c) for c in first.columns if c not in names), slope(deep, "d").alias("__ds"), slope(every, "a").alias("__as"))
        s = s.withColumns({f"__{c}i": F.col(f"__{c}y") - F.col(f"__{c}s") * F.col(f"__{c}x") for c in "da"})
    pick = lambda n, own_, all_: F.when(F.col(n) >= least, F.col(own_)).otherwise(F.col(all_))
    return s.select(*names, "threshold", pick("__nl", "__low", "__all").alias("shallow_mean"), pick("__nd", "__ds", "__as").alias("slope"), pick("__nd", "__di", "__ai").alias("intercept"), "n")


#: The three shallow behaviours by their usual names.
MODELS = {"zero_shallow": "zero", "mean_shallow": "mean", "threshold_intercept": "threshold"}


def chosen(df: DataFrame, fits: DataFrame, key: Key, draft: str, melt: str, selection: str = "best") -> DataFrame:
    """(key, minDraft, constantValue, paramType, alpha0, alpha1, model, r2): of the three shallow behaviours the selected one,
    or (best) the one whose predictions have the best R2; among equals the first of zero, mean, threshold."""
    names = keys(key)
    if selection != "best" and selection not in MODELS:
        raise ValueError(f"selection is {selection}; known are best, {', '.join(MODELS)}")
    own = df.filter(F.col(draft).isNotNull() & F.col(melt).isNotNull()).join(kept(fits.select(*names, "threshold", "shallow_mean", "slope", "intercept"), "regress"), names)
    models = piecewise_three(draft, "threshold", "slope", "intercept", "shallow_mean")
    first = [F.first(c).alias(c) for c in ("threshold", "shallow_mean", "slope", "intercept")]
    sums = own.groupBy(*names).agg(*first, (F.var_pop(melt) * F.count("*")).alias("__tot"), *(F.sum(F.pow(F.col(melt) - p, F.lit(2))).alias(f"__{m}") for m, p in models.items()))
    r2 = {m: 1 - F.col(f"__{m}") / F.col("__tot") for m in models}
    best = F.greatest(*r2.values()) if selection == "best" else r2[MODELS[selection]]
    model = F.when(r2["zero"] == best, "zero").when(r2["mean"] == best, "mean").otherwise("threshold") if selection == "best" else F.lit(MODELS[selection])
    at = F.col("slope") * F.col("threshold") + F.col("intercept")
    constant = F.when(F.col("model") == "zero", 0.0).when(F.col("model") == "mean", F.col("shallow_mean")).otherwise(at)
    return sums.withColumn("model", model).select(*names, F.col("threshold").alias("minDraft"), constant.alias("constantValue"), F.lit(0).alias("paramType"), F.col("intercept").alias("alpha0"), F.col("slope").alias("alpha1"), "model", best.alias("r2"))


def with_fallback(gate: DataFrame, params: DataFrame, key: Key, noisy: str = "zero") -> DataFrame:
    """The five parameters of every region: the fitted ones where the relationship is meaningful, else a constant (zero, or
    the mean melt)."""
    if noisy not in ("zero", "mean"):
        raise ValueError(f"noisy is {noisy}; known are zero and mean")
    names = keys(key)
    own = gate.join(params.select(*names, "minDraft", "constantValue", "paramType", "alpha0", "alpha1"), names, "left")
    ok = F.col("is_meaningful") & F.col("alpha1").isNotNull()
    constant = F.lit(0.0) if noisy == "zero" else F.col("melt_mean")
    pick = lambda c, other: F.when(ok, F.col(c)).otherwise(other).alias(c)
    return own.select(*names, "n", "correlation", "r2", "is_meaningful", pick("minDraft", F.lit(0.0)), pick("constantValue", constant), pick("paramType", F.lit(1)), pick("alpha0", F.lit(0.0)), pick("alpha1", F.lit(0.0)))


def shelf_parameters(df: DataFrame, key: Key, draft: str, melt: str, *, min_r2: float = 0.1, min_corr: float = 0.3, n_bins: int = 50, min_points: int = 5, method: str = "pelt", penalty: float = 1.0, noisy: str = "zero", selection: str = "best", weight: str | None = None) -> DataFrame:
    """The whole chain for all regions: gate, bins, threshold, piecewise fit, choice, fallback."""
    gate = quality(df, key, draft, melt, min_r2, min_corr)
    at = thresholds(binned(df, key, draft, melt, n_bins, min_points), key, method, penalty).filter("threshold is not null")
    return with_fallback(gate, chosen(df, piecewise_fit(df, at, key, draft, melt, weight=weight), key, draft, melt, selection), key, noisy)


def sweep(df: DataFrame, sets: DataFrame, key: Key, draft: str, melt: str) -> DataFrame:
    """shelf_parameters for every region and parameter set (set_name, min_r2, min_corr, penalty, n_bins, min_points). Points
    are read twice, whatever the sets: once into sums for each bin of any set's width, once into sums for each piece between
    the thresholds of all sets. The sets meet these sums."""
    names = keys(key)
    sets = F.broadcast(sets)  # a parameter set is written by hand: tens of rows
    gate = quality(df, key, draft, melt, 0.0, 0.0).crossJoin(sets)
    meaningful = F.col("is_meaningful") & (F.abs("correlation") >= F.col("min_corr")) & (F.col("r2") >= F.col("min_r2"))
    gate = gate.withColumn("is_meaningful", F.coalesce(meaningful, F.lit(False)))
    own = ["set_name", *names]
    both = df.filter(F.col(draft).isNotNull() & F.col(melt).isNotNull()).select(*names, F.col(draft).alias("x"), F.col(melt).alias("y"))
    ends = kept(both.groupBy(*names).agg(F.min("x").alias("__lo"), F.max("x").alias("__hi")), "sweep")
    widths = F.broadcast(sets.select(F.col("n_bins").alias("__of")).distinct())
    at = F.floor((F.col("x") - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / F.col("__of"))).cast("int")
    sums = both.join(ends, names).filter("__hi > __lo").crossJoin(widths).groupBy(*names, "__of", at.alias("bin")).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    bins = sums.filter("bin < __of").join(sets.select("set_name", F.col("n_bins").alias("__of"), "min_points", "penalty"), "__of").filter("n >= min_points")
    bins = bins.select(*own, "bin", (F.col("sx") / F.col("n")).alias("draft"), (F.col("sy") / F.col("n")).alias("melt"), "penalty")
    cuts = stored(thresholds(bins, own, "pelt", "penalty").filter("threshold is not null"), "sweep")
    # pieces of each region between the thresholds of all sets, with sums centred on the region's means
    marks = cuts.groupBy(*names).agg(F.array_sort(F.collect_set("threshold")).alias("__cuts"))  # one a set at most
    known = kept(both.groupBy(*names).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my")).join(marks, names), "sweep")
    u, v = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    piece = F.size(F.filter("__cuts", lambda c: c <= F.col("x")))
    moments = {"n": F.count("*"), "u": F.sum(u), "v": F.sum(v), "uu": F.sum(u * u), "uv": F.sum(u * v), "vv": F.sum(v * v)}
    pieces = both.join(known, names).groupBy(*names, piece.alias("piece")).agg(*(m.alias(k) for k, m in moments.items()), F.first("__cuts").alias("__cuts"), F.first("__mx").alias("__mx"), F.first("__my").alias("__my"))
    met = cuts.join(pieces, names).withColumn("deep", F.col("piece") >= F.array_position("__cuts", F.col("threshold")))
    part = lambda k, on: F.coalesce(F.sum(F.when(on, F.col(k))), F.lit(0)).alias
    s = met.groupBy(*own).agg(F.first("threshold").alias("threshold"), F.first("__mx").alias("__mx"), F.first("__my").alias("__my"), *(part(k, on)(f"{side}{k}") for k in moments for side, on in (("s", ~F.col("deep")), ("d", F.col("deep")))))
    return with_fallback(gate, _chosen_of_sums(s, own), own)


def _chosen_of_sums(s: DataFrame, names: list[str], least: int = 5) -> DataFrame:
    """What piecewise_fit and chosen give, from the centred sums of the shallow (s..) and deep (d..) points."""
    c = F.col
    s = s.withColumns({f"a{k}": c(f"s{k}") + c(f"d{k}") for k in ("n", "u", "v", "uu", "uv", "vv")})
    slope = lambda p: F.when((c(f"{p}n") > 1) & (c(f"{p}n") * c(f"{p}uu") - c(f"{p}u") * c(f"{p}u") > 0), (c(f"{p}n") * c(f"{p}uv") - c(f"{p}u") * c(f"{p}v")) / (c(f"{p}n") * c(f"{p}uu") - c(f"{p}u") * c(f"{p}u")))
    s = s.withColumn("slope", F.when(c("dn") >= least, slope("d")).otherwise(slope("a")))
    s = s.withColumn("__i", F.when(c("dn") >= least, (c("dv") - c("slope") * c("du")) / c("dn")).otherwise((c("av") - c("slope") * c("au")) / c("an")))  # of the centred line
    s = s.withColumn("__low", F.when(c("sn") >= least, c("sv") / c("sn")).otherwise(c("av") / c("an")))
    line = c("dvv") - 2 * c("slope") * c("duv") - 2 * c("__i") * c("dv") + c("slope") * c("slope") * c("duu") + 2 * c("slope") * c("__i") * c("du") + c("__i") * c("__i") * c("dn")
    flat = lambda level: c("svv") - 2 * level * c("sv") + level * level * c("sn")
    levels = {"zero": -c("__my"), "mean": c("__low"), "threshold": c("slope") * (c("threshold") - c("__mx")) + c("__i")}
    total = c("avv") - c("av") * c("av") / c("an")
    r2 = {m: 1 - (flat(x) + line) / total for m, x in levels.items()}
    s = s.withColumns({"r2": F.greatest(*r2.values()), **{f"__{m}": x for m, x in r2.items()}})
    s = s.withColumn("model", F.when(c("__zero") == c("r2"), "zero").when(c("__mean") == c("r2"), "mean").otherwise("threshold"))
    intercept = c("__i") + c("__my") - c("slope") * c("__mx")
    constant = F.when(c("model") == "zero", 0.0).when(c("model") == "mean", c("__low") + c("__my")).otherwise(c("slope") * c("threshold") + intercept)
    return s.select(*names, c("threshold").alias("minDraft"), constant.alias("constantValue"), F.lit(0).alias("paramType"), intercept.alias("alpha0"), c("slope").alias("alpha1"), "model", "r2")


def skill(df: DataFrame, key: Key, observed: str, predicted: str) -> DataFrame:
    """(key, n, r2, rmse, mae, bias, correlation) of predictions."""
    err = F.col(predicted) - F.col(observed)
    own = df.filter(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    s = own.groupBy(*keys(key)).agg(F.count("*").alias("n"), F.sum(err * err).alias("__res"), (F.var_pop(observed) * F.count("*")).alias("__tot"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"), F.corr(observed, predicted).alias("correlation"))
    return s.select(*keys(key), "n", F.when(F.col("__tot") > 0, 1 - F.col("__res") / F.col("__tot")).alias("r2"), F.sqrt(F.col("__res") / F.col("n")).alias("rmse"), "mae", "bias", "correlation")


def classify(gate: DataFrame, min_points: int = 200, min_range: float = 100.0, min_r2: float = 0.05, min_corr: float = 0.05, low_melt: float = 0.5) -> DataFrame:
    """Adds category: insufficient_data, insufficient_range, meaningful, noisy_low_melt or noisy_significant_melt. A mean melt
    below ``low_melt`` is low, so freezing is."""
    good = (F.abs("correlation") >= min_corr) & (F.col("r2") >= min_r2)
    return gate.withColumn(
        "category",
        F.when(F.col("n") < min_points, "insufficient_data")
        .when(F.col("draft_range") < min_range, "insufficient_range")
        .when(good, "meaningful")
        .when(F.col("melt_mean") < low_melt, "noisy_low_melt")
        .otherwise("noisy_significant_melt"),
    )


@dataclass(frozen=True)
class Assessment:
    """Which metrics count, their limits, and how they combine: strict_and (all checks), relaxed_or (any), hybrid (correlation
    or R2, and a reasonable error where errors count) or weighted (a score)."""

    use_correlation: bool = False
    use_r2: bool = True
    use_mse: bool = False
    use_sufficiency: bool = True
    absolute: bool = True
    min_corr: float = 0.05
    min_r2: float = 0.05
    max_mse: float = 2.0
    max_nmse: float = 0.7
    max_relative_rmse: float = 0.5
    min_points: int = 50
    min_range: float = 25.0
    low_melt: float = 0.5
    priority: tuple[str, ...] = ()
    relax: float = 0.7
    logic: str = "hybrid"
    weights: dict[str, float] = field(default_factory=lambda: {"correlation": 0.25, "r2": 0.35, "nmse": 0.25, "data_sufficiency": 0.15})
    min_score: float = 0.6


# The named sets of limits.
PRESETS = {
    "conservative": Assessment(logic="strict_and", min_corr=0.4, min_r2=0.4, max_nmse=0.6, relax=1.0),
    "balanced": Assessment(),
    "permissive": Assessment(logic="relaxed_or", min_corr=0.2, min_r2=0.2, max_nmse=0.8, relax=0.5),
    "correlation_focus": Assessment(use_r2=False, use_mse=False, min_corr=0.35, logic="relaxed_or"),
    "prediction_focus": Assessment(use_correlation=False, logic="strict_and", min_r2=0.35, max_nmse=0.65),
    "simple": Assessment(use_mse=False, logic="hybrid"),
}


def assess(df: DataFrame, key: Key, draft: str, melt: str, rule: str | Assessment = "balanced") -> DataFrame:
    """(key, n, draft_range, melt_mean, correlation, r2, mse, rmse, nmse, relative_rmse, is_meaningful, category, confidence)
    by a preset or a rule of one's own. Keys on the priority list get limits relaxed by a factor. Metrics that do not count
    are null; a missing correlation or R2 is 0; errors relative to a mean or variance that is not positive are infinite.
    Categories: insufficient_data, poor_low_melt, poor_significant_melt, moderate, good (confidence 0.6) and excellent (0.8)."""
    if isinstance(rule, str):
        if rule not in PRESETS:
            raise ValueError(f"preset is {rule}; known are {', '.join(PRESETS)}")
        rule = PRESETS[rule]
    names, c = keys(key), F.col
    both = df.filter(c(draft).isNotNull() & c(melt).isNotNull())
    zero = lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)
    own = both.groupBy(*names).agg(
        F.count("*").alias("n"), (F.max(draft) - F.min(draft)).alias("draft_range"), F.avg(melt).alias("melt_mean"), F.var_pop(melt).alias("__var"),
        zero(F.corr(draft, melt)).alias("correlation"), zero(F.regr_r2(melt, draft)).alias("r2"),
    )
    infinite = F.lit(float("inf"))
    own = own.withColumn("mse", F.greatest(c("__var") * (1 - c("r2")), F.lit(0.0))).withColumn("rmse", F.sqrt("mse"))
    own = own.withColumns({"nmse": F.when(c("__var") > 0, c("mse") / c("__var")).otherwise(infinite), "relative_rmse": F.when(c("melt_mean") > 0, c("rmse") / c("melt_mean")).otherwise(infinite)})
    ease = F.when(c(names[-1]).isin(list(rule.priority)), rule.relax).otherwise(1.0) if rule.priority else F.lit(1.0)
    checks, errors = {}, rule.use_mse and rule.use_r2  # errors are those of R2's fit, so without it there are none
    if rule.use_correlation:
        checks["correlation"] = (F.abs("correlation") if rule.absolute else c("correlation")) >= rule.min_corr * ease
    if rule.use_r2:
        checks["r2"] = c("r2") >= rule.min_r2 * ease
    if errors:
        checks |= {"mse": c("mse") <= rule.max_mse, "nmse": c("nmse") <= rule.max_nmse / ease, "relative_rmse": c("relative_rmse") <= rule.max_relative_rmse / ease}
    passed = sum((x.cast("double") for x in checks.values()), F.lit(0.0))
    confidence = passed / max(1, len(checks))
    never = F.lit(False)
    if rule.logic == "strict_and":
        good = passed == len(checks) if checks else never
    elif rule.logic == "relaxed_or":
        good = passed > 0
    elif rule.logic == "hybrid":
        good = (checks.get("correlation", never) | checks.get("r2", never)) & ((checks["nmse"] | checks["relative_rmse"]) if errors else F.lit(True))
    elif rule.logic == "weighted":
        scores = {}
        if rule.use_correlation:
            scores["correlation"] = F.abs("correlation")
        if rule.use_r2:
            scores["r2"] = F.greatest("r2", F.lit(0.0))
        if errors:
            scores["nmse"] = F.greatest(1 - c("nmse"), F.lit(0.0))
        if rule.use_sufficiency:
            scores["data_sufficiency"] = F.least(F.lit(1.0), c("n") / rule.min_points * c("draft_range") / rule.min_range)
        total = sum(rule.weights[k] for k in scores)
        confidence = sum((rule.weights[k] * x for k, x in scores.items()), F.lit(0.0)) / total if total > 0 else F.lit(0.0)
        good = confidence >= rule.min_score
    else:
        raise ValueError(f"logic is {rule.logic}; known are strict_and, relaxed_or, hybrid and weighted")
    enough = (c("n") >= rule.min_points) & (c("draft_range") >= rule.min_range) if rule.use_sufficiency else F.lit(True)
    own = own.withColumns({"is_meaningful": enough & good, "confidence": F.when(enough, confidence).otherwise(0.0)})
    poor = F.when(c("melt_mean") < rule.low_melt, "poor_low_melt").otherwise("poor_significant_melt")
    fine = F.when(c("confidence") >= 0.8, "excellent").when(c("confidence") >= 0.6, "good").otherwise("moderate")
    own = own.withColumn("category", F.when(~enough, "insufficient_data").when(c("is_meaningful"), fine).otherwise(poor))
    counts = {"correlation": rule.use_correlation, "r2": rule.use_r2, "mse": errors, "rmse": errors, "nmse": errors, "relative_rmse": errors}
    return own.select(*names, "n", "draft_range", "melt_mean", *(F.when(F.lit(x), c(k)).alias(k) for k, x in counts.items()), "is_meaningful", "category", "confidence")


def strategy_fit(gate: DataFrame, fits: DataFrame, key: Key, nonnegative: bool = False, steep: float = 0.1) -> DataFrame:
    """(key, model_type, threshold, slope, intercept, is_steep): constant_zero for noisy regions of low melt, constant_mean for
    other noisy ones, piecewise_linear for all others, those with too little data too. Without a slope or an intercept the mean
    melt, 0 at least, stands in (fallback_mean). gate: from classify or assess."""
    names, c = keys(key), F.col
    own = gate.join(fits.select(*names, "threshold", "slope", "intercept"), names, "left")
    kind = F.when(c("category").isin("noisy_low_melt", "poor_low_melt"), "constant_zero").when(c("category").isin("noisy_significant_melt", "poor_significant_melt"), "constant_mean").otherwise("piecewise_linear")
    own = own.withColumn("__kind", kind)
    own = own.withColumns({
        "slope": F.when(c("__kind") == "piecewise_linear", c("slope")).otherwise(0.0),
        "intercept": F.when(c("__kind") == "constant_zero", 0.0).when(c("__kind") == "constant_mean", c("melt_mean")).otherwise(c("intercept")),
    })
    if nonnegative:
        own = own.withColumn("intercept", F.when(c("intercept") < 0, 0.0).otherwise(c("intercept")))
    gone = c("slope").isNull() | F.isnan("slope") | c("intercept").isNull() | F.isnan("intercept")
    return own.select(
        *names, F.when(gone, "fallback_mean").otherwise(c("__kind")).alias("model_type"), "threshold",
        F.when(gone, 0.0).otherwise(c("slope")).alias("slope"), F.when(gone, F.greatest(F.lit(0.0), F.coalesce("melt_mean", F.lit(0.0)))).otherwise(c("intercept")).alias("intercept"),
        F.coalesce(F.abs("slope") > steep, F.lit(False)).alias("is_steep"),
    )


def tiers(df: DataFrame, key: Key, draft: str, melt: str, min_points: int = 100, r2_threshold: float = 0.1) -> DataFrame:
    """A simple fit per region over its valid points (positive draft, no negative melt), with moments, is_meaningful (R2 at
    its threshold, correlation of 0.2) and a tier: high (R2 0.3, 500 points), medium (0.15, 200) or low. Regions of fewer
    than ``min_points`` valid points are left out."""
    x, y = draft, melt
    own = valid_points(df, draft, melt).groupBy(*keys(key)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(x, y).alias("correlation"), F.count("*").alias("n"),
        F.avg(x).alias("draft_mean"), F.stddev_pop(x).alias("draft_std"), F.avg(y).alias("melt_mean"), F.stddev_pop(y).alias("melt_std"),
    )
    own = own.withColumn("rmse", F.col("melt_std") * F.sqrt(F.greatest(1 - F.col("r2"), F.lit(0.0))))
    tier = F.when((F.col("r2") >= 0.3) & (F.col("n") >= 500), "high").when((F.col("r2") >= 0.15) & (F.col("n") >= 200), "medium").otherwise("low")
    good = F.coalesce((F.col("r2") >= r2_threshold) & (F.abs("correlation") >= 0.2), F.lit(False))
    return own.filter(F.col("n") >= min_points).withColumns({"is_meaningful": good, "tier": tier})


def best_of(tiered: DataFrame, most: int, tier: str = "high") -> DataFrame:
    """At most ``most`` regions of a tier, the best R2 first."""
    return tiered.filter(F.col("tier") == tier).orderBy(F.desc("r2"), *(c for c in tiered.columns[:1])).limit(most)


def counts_by(df: DataFrame, *categories: str) -> DataFrame:
    """How many rows each category has and its share."""
    n = df.groupBy(*categories).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("__all"))).select(*categories, "n", (F.col("n") / F.col("__all")).alias("share"))


def compare_sets(params: DataFrame, order: str = "set_name") -> DataFrame:
    """Per set: linear, constant and meaningful counts, percent linear, and the gain over the set before."""
    own = params.groupBy("set_name").agg(F.count("*").alias("total"), F.sum(F.when(F.col("paramType") == 0, 1).otherwise(0)).alias("n_linear"), F.sum(F.when(F.col("paramType") == 1, 1).otherwise(0)).alias("n_constant"), F.sum(F.col("is_meaningful").cast("int")).alias("n_meaningful"))
    own = own.withColumn("pct_linear", F.col("n_linear") * 100.0 / F.col("total"))
    return own.withColumn("gain", F.col("n_linear") - F.lag("n_linear").over(Window.orderBy(order)))  # a row a set


def sensitivity(gate: DataFrame, r2s: Sequence[float], corrs: Sequence[float]) -> DataFrame:
    """(min_r2, min_corr, pct): the share of regions that pass each pair of limits; a missing metric passes. A region's
    metrics are counted by the number of limits they reach, so the grid meets counts, not regions."""
    spark = gate.sparkSession
    reach = lambda c, limits: F.aggregate(F.array(*(F.lit(float(x)) for x in sorted(limits))), F.lit(0), lambda acc, x: acc + F.when(c.isNull() | F.isnan(c) | (c >= x), 1).otherwise(0))
    counts = gate.groupBy(reach(F.col("r2"), r2s).alias("a"), reach(F.abs(F.col("correlation")), corrs).alias("b")).agg(F.count("*").alias("k"))
    grid = spark.createDataFrame([(i + 1, float(x), j + 1, float(y)) for i, x in enumerate(sorted(r2s)) for j, y in enumerate(sorted(corrs))], "i int, min_r2 double, j int, min_corr double")
    total = counts.agg(F.sum("k").alias("n"))
    passed = F.sum(F.when((F.col("a") >= F.col("i")) & (F.col("b") >= F.col("j")), F.col("k")).otherwise(0))
    return grid.crossJoin(counts).groupBy("min_r2", "min_corr").agg(passed.alias("k")).crossJoin(total).select("min_r2", "min_corr", (F.col("k") * 100.0 / F.col("n")).alias("pct"))


def borderline(gate: DataFrame, **limits: float) -> DataFrame:
    """Rows of which any metric lies in [t, 2t), as in ``borderline(gate, r2=0.1, correlation=0.3)``."""
    near = [F.coalesce((_size(k) >= t) & (_size(k) < 2 * t), F.lit(False)) for k, t in limits.items()]
    return gate.filter(reduce(lambda a, b: a | b, near))


def failing(gate: DataFrame, metric: str, limit: float) -> DataFrame:
    """Rows whose metric is below its limit; rows without the metric are not."""
    return gate.filter(F.col(metric).isNotNull() & (_size(metric) < limit))


def failing_counts(gate: DataFrame, **limits: float) -> DataFrame:
    """(metric, n_failing, n_borderline), a row for each limit."""
    counts = [F.count_if(F.coalesce(test, F.lit(False))).alias(f"{k}_{name}") for k, t in limits.items() for name, test in (("failing", _size(k) < t), ("borderline", (_size(k) >= t) & (_size(k) < 2 * t)))]
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}_failing").alias("n_failing"), F.col(f"{k}_borderline").alias("n_borderline")) for k in limits))
    return gate.agg(*counts).select(F.inline(rows))


def _size(metric: str) -> Column:
    return F.abs(metric) if metric == "correlation" else F.col(metric)


def to_convert(gate: DataFrame, target_pct: float) -> DataFrame:
    """The best noisy regions that would lift the meaningful share to the target: by R2, then correlation, descending."""
    n = gate.agg(F.count("*").alias("n"), F.sum(F.col("is_meaningful").cast("int")).alias("k")).first()
    k = max(0, int((target_pct - 100.0 * (n.k or 0) / max(n.n, 1)) / 100.0 * n.n))
    return gate.filter(~F.col("is_meaningful")).orderBy(F.desc_nulls_last("r2"), F.desc_nulls_last("correlation")).limit(k)


def limits_to_convert(gate: DataFrame, target_pct: float) -> DataFrame:
    """(n, min_r2, min_corr): how many regions to_convert gives, and the limits that all of them reach (0 where none has the
    metric)."""
    return to_convert(gate, target_pct).agg(F.count("*").alias("n"), F.coalesce(F.min("r2"), F.lit(0.0)).alias("min_r2"), F.coalesce(F.min(F.abs("correlation")), F.lit(0.0)).alias("min_corr"))
