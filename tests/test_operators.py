"""Series with a known answer, invariants and edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.functions.columns import nan_to_null, require, with_step
from gridloom.operators import changepoint, fill, generator, regions, regrid, regress, stats, subset
from gridloom.operators import mesh as meshes
from gridloom.operators import timeseries as ts
from gridloom.plans import registry
from gridloom.sources import io


@pytest.fixture(scope="module")
def synthetic(spark):
    """y = a + b t + season + noise-free parts, for 6 cells and 48 months."""
    rows = [(c, t, t % 12, 10.0 * c + 0.5 * t + math.sin(2 * math.pi * t / 12)) for c in range(6) for t in range(48)]
    return spark.createDataFrame(rows, "cell int, t int, month int, v double")


def test_detrended_series_has_no_slope_and_the_same_mean(synthetic):
    flat = ts.detrend(synthetic, "cell", "t", "v", "w")
    got = flat.groupBy("cell").agg(F.regr_slope("w", "t").alias("s"), F.avg("v").alias("a"), F.avg("w").alias("b")).collect()
    assert all(abs(r.s) < 1e-9 and abs(r.a - r.b) < 1e-9 for r in got)


@pytest.mark.parametrize("deg", [2, 3])
def test_higher_degrees_match_numpy(spark, deg):
    x = np.arange(20.0)
    y = 3 + x - 0.2 * x**2 + 0.01 * x**3 + np.cos(x)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "cell int, t double, v double")
    got = [r.w for r in ts.detrend(df, "cell", "t", "v", "w", deg=deg, keep_mean=False).orderBy("t").collect()]
    assert np.allclose(got, y - np.polyval(np.polyfit(x, y, deg), x), atol=1e-8)


def test_month_means_are_equal_after_deseasonalising(synthetic):
    flat = ts.deseasonalise(synthetic, "cell", "month", "v", "w")
    spread = flat.groupBy("cell", "month").agg(F.avg("w").alias("m")).groupBy("cell").agg((F.max("m") - F.min("m")).alias("d"))
    assert all(r.d < 1e-9 for r in spread.collect())


def test_seasonality_and_deseasonalised_add_up(synthetic):
    flat = ts.deseasonalise(synthetic, "cell", "month", "v", "w").withColumn("season", F.col("v") - F.col("w"))
    assert flat.filter(F.abs(F.col("season") + F.col("w") - F.col("v")) > 1e-12).count() == 0


def test_constant_series_missing_values_and_single_values(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, None), (2, 1, 3.0), (3, 0, None), (3, 1, None)], "cell int, t int, v double")
    got = {(r.cell, r.t): r for r in ts.normalise(ts.detrend(df, "cell", "t", "v"), "cell", "v", "z").collect()}
    assert got[1, 0].z == 0.0 and got[2, 0].v is None and got[2, 1].v == 3.0 and got[3, 0].z is None


def test_percent_change_needs_a_known_base(synthetic):
    with pytest.raises(ValueError):
        ts.change_from_start(synthetic, "cell", "t", "v", base="last")


def test_interpolation_stays_inside_and_clamps(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 5.0), ("b", 4.0, 1.0)], "k string, t double, v double")
    goal = spark.createDataFrame([(-1.0,), (4.0,), (10.0,), (12.0,)], "target double")
    inside = {(r.k, r.target): r.v for r in ts.interpolate(df, "k", "t", "v", goal).collect()}
    assert inside == {("a", 4.0): 2.0, ("a", 10.0): 5.0, ("b", 4.0): 1.0}
    held = {(r.k, r.target): r.v for r in ts.interpolate_clamped(df, "k", "t", "v", goal).collect()}
    assert held["a", -1.0] == 0.0 and held["a", 12.0] == 5.0 and held["b", 12.0] == 1.0 and len(held) == 8


def test_window_lengths_must_match(synthetic):
    with pytest.raises(ValueError):
        ts.add_over_window(synthetic, synthetic.filter("t < 5"), "cell", "t", "v", 40)


def test_range_subset_is_closed_and_checks_its_column(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "time int")
    assert [r.time for r in subset.by_range(df, "time", 2, 5).orderBy("time").collect()] == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        subset.by_range(df, "depth", 0, 1)


def test_years_are_cut_open_below(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2005)], "year int")
    assert [r.year for r in subset.by_years(df, "year", 2000, 2002).orderBy("year").collect()] == [2001, 2002]


def test_rename_and_fill_leaves_nothing_missing(spark):
    df = spark.createDataFrame([(0.0, 1.0, float("nan")), (1.0, 2.0, 3.0)], "x double, y double, v double")
    got = subset.rename_and_fill(df)
    assert got.columns == ["x1", "y1", "v"] and [r.v for r in got.orderBy("x1").collect()] == [0.0, 3.0]


def test_nan_is_null_and_columns_are_required(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),)], "v double"))
    assert df.first().v is None
    with pytest.raises(ValueError):
        require(df, "w")
    assert [r.t_idx for r in with_step(spark.createDataFrame([(5,), (9,), (5,)], "t int"), "t").orderBy("t").collect()] == [0, 0, 1]


def test_coarsening_trims_and_refuses(spark):
    cells = spark.createDataFrame([(0, i, j, float(i), float(j), float(i * j)) for i in range(5) for j in range(4)], "t int, ix int, iy int, x double, y double, v double")
    got = stats.coarsen_space(cells, "t", "ix", "iy", "x", "y", 2, "v")
    assert got.count() == 4 and got.filter("ix = 1 AND iy = 1").first().v == 6.25
    with pytest.raises(ValueError):
        stats.coarsen_time(cells.withColumn("t", F.col("ix")), "iy", "t", "v", 2)


def test_merged_means_do_not_depend_on_the_parts(synthetic):
    whole = {r.cell: r.v for r in stats.time_mean(synthetic, "cell", "v").collect()}
    parts = stats.partial_means(synthetic.withColumn("p", F.col("t") % 5), "p", "cell", "v")
    assert all(abs(whole[r.cell] - r.mean) < 1e-9 for r in stats.merged_mean(parts, "cell").collect())


def test_histogram_counts_everything_and_density_integrates(synthetic):
    h = stats.histogram(synthetic, "cell", "v", 7)
    assert all(r.n == 48 for r in h.groupBy("cell").agg(F.sum("n").alias("n")).collect())
    k = stats.kernel_density(synthetic.filter("cell = 0"), "cell", "v", margin=1.0).orderBy("point").collect()
    assert abs(sum(r.density for r in k) * (k[1].x - k[0].x) - 1) < 0.02


def test_autocorrelation_and_spectrum(spark):
    rows = [(1, t, math.sin(2 * math.pi * t / 8)) for t in range(64)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    r = {x.lag: x.r for x in stats.autocorrelation(df, "k", "t", "v").collect()}
    assert r[0] == 1.0 and r[8] > 0.8 > 0 > r[4]
    top = stats.power_spectrum(df, "k", "t", "v").orderBy(F.desc("power")).first()
    assert abs(top.frequency - 1 / 8) < 1e-9


def test_change_points_of_steps():
    y = np.array([0.0] * 20 + [5.0] * 20 + [1.0] * 20) + np.sin(np.arange(60)) * 0.01
    for found in (changepoint.pelt(y, "l2", 1.0), changepoint.binary_segmentation(y, "l2", 1.0), changepoint.pelt(y, "rbf", 1.0), changepoint.pelt(y, "l1", 1.0), changepoint.sliding_window(y, "l2", 1.0)):
        assert found == [20, 40, 60]
    assert changepoint.pelt(np.zeros(3), "l2") == [3]
    with pytest.raises(ValueError):
        changepoint.segment_cost(y, "other")


def test_pelt_is_exact():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=30))
    cost = changepoint.segment_cost(y, "l2")
    best, back = {0: 0.0}, {0: None}
    for e in range(2, 31):
        best[e], back[e] = min((best[a] + cost(a, e) + 2.0, a) for a in best if e - a >= 2)
    ends, at = [], 30
    while at:
        ends.append(at)
        at = back[at]
    assert changepoint.pelt(y, "l2", 2.0, 2, 1) == ends[::-1]


def test_p_value_of_a_correlation():
    # two-sided Student t: r = 0.5, n = 20 gives t = 2.4495 on 18 degrees, p = 0.02480
    assert abs(changepoint.t_two_sided(0.5, 20) - 0.0248) < 2e-4
    assert changepoint.t_two_sided(1.0, 20) == 0.0 and math.isnan(changepoint.t_two_sided(0.5, 2))


def test_smoothing_keeps_polynomials():
    x = np.arange(40.0)
    assert np.allclose(changepoint.savgol(2 + x - 0.1 * x**2, 15, 2), 2 + x - 0.1 * x**2)
    assert list(changepoint.median_filter(np.array([1.0, 9.0, 2.0]), 3)) == [1.0, 2.0, 2.0]


def test_shelf_parameters_find_the_planted_law(spark):
    rng = np.random.default_rng(1)
    d = rng.uniform(0, 800, 4000)
    m = np.where(d < 300, 1.0, 1.0 + 0.05 * (d - 300)) + rng.normal(0, 0.2, 4000)
    noise = pd.DataFrame({"region": "noise", "draft": d[:500], "melt": rng.normal(2, 1, 500)})
    few = pd.DataFrame({"region": "few", "draft": d[:10], "melt": m[:10]})
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"region": "law", "draft": d, "melt": m}), noise, few]))
    got = {r.region: r for r in regress.shelf_parameters(df, "region", "draft", "melt", noisy="mean").collect()}
    law = got["law"]
    # the curve's level first differs a little beyond the bend; the slope and what lies below it are the planted ones
    assert law.is_meaningful and 300 <= law.minDraft < 480 and abs(law.alpha1 - 0.05) < 0.005 and 1.0 <= law.constantValue < 2.5
    assert not got["noise"].is_meaningful and got["noise"].paramType == 1 and abs(got["noise"].constantValue - 2) < 0.3
    assert not got["few"].is_meaningful


def brute_curve(d, m, n_bins, least):
    edges = np.linspace(d.min(), d.max(), n_bins + 1)
    at = np.digitize(d, edges) - 1
    own = [i for i in range(n_bins) if (at == i).sum() >= least]
    return np.array([d[at == i].mean() for i in own]), np.array([m[at == i].mean() for i in own])


def brute_break(draft, melt, method):
    """The draft before the one break by least squares, at multiples of five bins; the median without one."""
    n, sse = len(melt), lambda a, b: ((melt[a:b] - melt[a:b].mean()) ** 2).sum()
    if method == "binseg":
        found = [(sse(0, n) - sse(0, k) - sse(k, n), k) for k in range(0, n, 5) if k >= 2 and n - k >= 2]
    else:
        gain = [(sse(k - 2, k + 2) - sse(k - 2, k) - sse(k, k + 2), k) for k in range(0, n, 5) if 2 <= k < n - 2]
        found = [g for i, g in enumerate(gain) if g[0] > gain[i - 1][0] and g[0] > gain[(i + 1) % len(gain)][0]]
    return draft[max(found)[1] - 1] if found else np.median(draft)


def test_thresholds_match_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(8):
        d = rng.uniform(0, 100, 600)
        m = np.where(d < 20 + 8 * k, 1.0, 4.0 if k % 2 else 1 + 0.1 * (d - 20 - 8 * k)) + rng.normal(0, 0.3, 600)
        rows += [(k, float(a), float(b)) for a, b in zip(d, m)]
        for method in ("binseg", "window"):
            want[k, method] = brute_break(*brute_curve(d, m, 30, 5), method)
    rows += [(99, float(i), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "region int, draft double, melt double")
    bins = regress.binned(df, "region", "draft", "melt", 30, 5)
    for method in ("binseg", "window"):
        got = {r.region: r.threshold for r in regress.thresholds(bins.unionByName(bins.filter("region = 0 AND bin < 9").withColumn("region", F.lit(50))), "region", method).collect()}
        assert got.pop(50) is None  # fewer than ten bins
        assert all(abs(got[k] - want[k, method]) < 1e-9 for k in range(8)) and len(got) == 8
    step = spark.createDataFrame([(1, i, float(i), 0.0 if i < 20 else 5.0) for i in range(40)], "region int, bin int, draft double, melt double")
    flat = step.withColumn("melt", F.lit(1.0))
    for method in ("pelt", "binseg", "window"):
        assert regress.thresholds(step, "region", method).first().threshold == 19.0  # the last bin before the break
    assert regress.thresholds(flat, "region", "window").first().threshold == 19.5  # no peak: the median
    with pytest.raises(ValueError):
        regress.thresholds(flat, "region", "other")


def test_knees_of_known_curves(spark):
    rows = [("bend", x / 10, max(x / 10 - 60, 0.0) ** 2) for x in range(1000)] + [("few", float(i), 1.0) for i in range(9)] + [("steep", x / 10, 0.0 if x < 300 else 50.0 * (x / 10 - 30)) for x in range(1000)]
    df = spark.createDataFrame(rows, "region string, draft double, melt double")
    plain = {r.region: r.knee for r in regress.knees(df, "region", "draft", "melt").collect()}
    assert plain["few"] == 1000.0 and abs(plain["steep"] - 30) < 3 and plain["bend"] > 60
    smooth = {r.region: r.knee for r in regress.knees(df, "region", "draft", "melt", smooth=True, low=35.0, high=70.0).collect()}
    assert smooth["few"] == 1000.0 and smooth["steep"] == 35.0 and 60 < smooth["bend"] <= 70
    some = df.filter("region = 'bend' AND draft IN (0.0, 30.0, 60.0, 99.9)").unionByName(df.filter("region = 'bend' AND draft < 1"))
    assert regress.knees(some, "region", "draft", "melt", smooth=True).first().knee == 1000.0  # fewer than five bins of over three points
    w = {(r.region, r.draft): r.w for r in regress.with_dynamic_threshold(df.unionByName(spark.createDataFrame([("steep", None, 1.0)], df.schema)), "region", "draft", "melt").collect()}
    assert w["steep", 20.0] == 0.0 and w["steep", 40.0] == 1.0 and w["few", 8.0] == 0.0 and w["steep", None] is None


def test_a_sweep_is_the_chain_of_every_set(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(4):
        d = rng.uniform(0, 500, 900)
        rows += [(f"r{k}", float(a), float(b)) for a, b in zip(d, np.where(d < 150 + 50 * k, 2.0, 2 + 0.03 * (d - 150 - 50 * k)) + rng.normal(0, 0.5 + 3 * (k == 3), 900))]
    rows += [("few", float(i), float(i)) for i in range(12)] + [("r0", None, 1.0), ("r1", 3.0, None)]
    df = spark.createDataFrame(rows, "region string, draft double, melt double")
    sets = [("a", 0.1, 0.2, 1.0, 50, 5), ("b", 0.3, 0.5, 0.5, 30, 3), ("c", 0.9, 0.9, 2.0, 40, 5)]
    got = {(r.set_name, r.region): r for r in regress.sweep(df, spark.createDataFrame(sets, "set_name string, min_r2 double, min_corr double, penalty double, n_bins int, min_points int"), "region", "draft", "melt").collect()}
    assert len(got) == 15
    for name, r2, corr, penalty, n_bins, least in sets:
        for r in regress.shelf_parameters(df, "region", "draft", "melt", min_r2=r2, min_corr=corr, penalty=penalty, n_bins=n_bins, min_points=least).collect():
            own = got[name, r.region]
            assert own.is_meaningful == r.is_meaningful and own.paramType == r.paramType
            assert all(abs(own[c] - r[c]) < 1e-7 * max(1, abs(r[c])) for c in ("minDraft", "constantValue", "alpha0", "alpha1"))


def test_weights_of_a_piecewise_fit_are_repeats(spark):
    rng = np.random.default_rng(9)
    rows = [("a", float(x), float(y), int(k)) for x, y, k in zip(rng.uniform(0, 50, 200), rng.normal(3, 1, 200), rng.integers(0, 4, 200))]
    df = spark.createDataFrame(rows, "region string, draft double, melt double, k int")
    at = spark.createDataFrame([("a", 20.0)], "region string, threshold double")
    weighted = regress.piecewise_fit(df, at, "region", "draft", "melt", weight="k").first()
    plain = regress.piecewise_fit(df.filter("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k")))), at, "region", "draft", "melt").first()
    assert all(abs(weighted[c] - plain[c]) < 1e-9 for c in ("shallow_mean", "slope", "intercept"))
    with pytest.raises(ValueError):
        regress.chosen(df, at, "region", "draft", "melt", "other")


def test_presets_and_logics_are_known(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i) for i in range(60)], "region string, draft double, melt double")
    best = regress.assess(df, "region", "draft", "melt", regress.Assessment(use_correlation=True, use_mse=True, logic="weighted")).first()
    assert best.category == "excellent" and best.is_meaningful and best.nmse == 0.0
    assert regress.assess(df.limit(10), "region", "draft", "melt").first().category == "insufficient_data"
    with pytest.raises(ValueError):
        regress.assess(df, "region", "draft", "melt", "other")
    with pytest.raises(ValueError):
        regress.assess(df, "region", "draft", "melt", regress.Assessment(logic="other"))


def test_missing_policies_differ(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 7.0), ("a", 3.0, None)], "region string, draft double, melt double")
    assert regress.draft_regression(df, "region", "draft", "melt").first().n == 2
    assert regress.draft_regression(df, "region", "draft", "melt", missing="zero").first().n == 4
    with pytest.raises(ValueError):
        regress.draft_regression(df, "region", "draft", "melt", missing="mean")


def test_points_on_edges_and_overlaps(spark):
    ring = lambda *p: [[{"x": float(a), "y": float(b)} for a, b in p]]
    polygons = regions.with_bounds(spark.createDataFrame([(1, "a", ring((0, 0), (2, 0), (2, 2), (0, 2))), (2, "b", ring((2, 0), (4, 0), (4, 2), (2, 2), (2, 0)))], "region_id int, name string, rings array<array<struct<x:double,y:double>>>"))
    cells = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 0.0), (4, 3.0, 2.0), (5, 5.0, 1.0)], "cell_id int, x double, y double")
    got = {(r.cell_id, r.region_id) for r in regions.cell_region(cells, polygons).collect()}
    assert got == {(1, 1), (2, 2), (3, 2)}  # a shared edge belongs to one of the two
    near = {(r.cell_id, r.region_id) for r in regions.cell_region(cells, polygons, buffer=1.0).collect()}
    assert (5, 2) in near and (4, 2) in near and (5, 1) not in near
    area = {r.region_id: (r.area, r.cx, r.cy) for r in regions.areas(polygons).collect()}
    assert area == {1: (4.0, 1.0, 1.0), 2: (4.0, 3.0, 1.0)}


def test_merging(spark):
    equal = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, None), (2, 3.0)], "cell int, v double")
    assert {r.cell: r.v for r in regions.merge_no_conflicts(equal, "cell", "v").collect()} == {1: 5.0, 2: 3.0}
    with pytest.raises(ValueError):
        regions.merge_no_conflicts(equal.unionByName(spark.createDataFrame([(1, 6.0)], "cell int, v double")), "cell", "v")
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert [r.name for r in regions.listed_then_alphabetical(names, ["c"]).orderBy("priority").collect()] == ["c", "a", "b"]


def test_filling_keeps_valid_cells_and_takes_the_nearest(spark):
    rng = np.random.default_rng(2)
    cells = [(0, i * 100 + j, i, j) for i in range(20) for j in range(20)]
    keep = {c[1] for c in cells if rng.random() < 0.05} | {0}
    grid = spark.createDataFrame(cells, "region int, cell int, ix int, iy int")
    valid = grid.filter(F.col("cell").isin(sorted(keep)))
    at = {c[1]: (c[2], c[3]) for c in cells}
    got = {r.cell: r.source for r in fill.fill_map(grid, valid, "region", "cell", "ix", "iy").collect()}
    assert set(got) == set(at) - keep
    for cell, source in got.items():
        d = lambda s: (at[cell][0] - at[s][0]) ** 2 + (at[cell][1] - at[s][1]) ** 2
        assert (d(source), at[source][1], at[source][0]) == min((d(s), at[s][1], at[s][0]) for s in keep)


def test_regions_without_values_stay_empty(spark):
    grid = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (2, 3, 5, 5)], "region int, cell int, ix int, iy int")
    assert fill.fill_map(grid, grid.filter("cell = 1"), "region", "cell", "ix", "iy").count() == 1


def test_weights_reproduce_linear_fields(spark):
    grid = spark.createDataFrame([(j * 6 + i, 2.0 * i - 3.0 * j + 1) for i in range(6) for j in range(5)], "cell_id long, value double")
    rng = np.random.default_rng(3)
    goal = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(0, 5, 50), rng.uniform(0, 4, 50)))], "dst int, x double, y double")
    for weights in (regrid.bilinear_weights(goal, "dst", "x", "y", 0, 0, 1, 1, 6, 5), regrid.triangle_weights(goal, "dst", "x", "y", 0, 0, 1, 1, 6, 5)):
        assert all(abs(r.w - 1) < 1e-9 for r in weights.groupBy("dst").agg(F.sum("w").alias("w")).collect())
        got = regrid.apply_weights(grid, weights, "cell_id", "value").join(goal, "dst")
        assert got.filter(F.abs(F.col("value") - (2 * F.col("x") - 3 * F.col("y") + 1)) > 1e-9).count() == 0


def test_triangulated_meshes(spark):
    rng = np.random.default_rng(4)
    nodes = pd.DataFrame({"node": np.arange(60), "x": rng.uniform(0, 10, 60), "y": rng.uniform(0, 10, 60)})
    src = spark.createDataFrame(nodes)
    mesh = meshes.delaunay(src, tile=20)
    goal = spark.createDataFrame(pd.DataFrame({"dst": np.arange(100, 140), "x": rng.uniform(3, 7, 40), "y": rng.uniform(3, 7, 40)}))
    weights = regrid.mesh_weights(goal, mesh, src, "dst", "node", "x", "y", 2.0)
    field = src.select("node", (1 + 2 * F.col("x") - F.col("y")).alias("value"))
    got = regrid.apply_weights(field, weights, "node", "value").join(goal, "dst")
    assert got.count() == 40 and got.filter(F.abs(F.col("value") - (1 + 2 * F.col("x") - F.col("y"))) > 1e-6).count() == 0


def test_randomised_scores_keep_their_spectrum(spark):
    for n in (24, 25):
        rng = np.random.default_rng(n)
        y = rng.normal(size=n)
        scores = spark.createDataFrame([(t, 1, float(v)) for t, v in enumerate(y)], "t int, mode int, score double")
        drawn = generator.phase_randomised(scores, "t", 3, seed=1)
        rows = drawn.orderBy("realization", "t").collect()
        first = [r.score for r in rows if r.realization == 0]
        assert np.allclose(np.abs(np.fft.rfft(first)), np.abs(np.fft.rfft(y))) and not np.allclose(first, y)
        again = [r.score for r in generator.phase_randomised(scores, "t", 3, seed=1).orderBy("realization", "t").collect()]
        assert again == [r.score for r in rows]


def test_loadings_are_orthonormal(spark):
    rng = np.random.default_rng(5)
    cube = spark.createDataFrame([(c, t, float(v)) for (c, t), v in np.ndenumerate(rng.normal(size=(30, 10)))], "cell int, t int, v double")
    loadings, scores, variance = generator.eof(cube, "cell", "t", "v")
    l = loadings.toPandas().pivot(index="cell", columns="mode", values="loading").to_numpy()
    assert np.allclose(l.T @ l, np.eye(l.shape[1]), atol=1e-8)
    ratio = [r.ratio for r in variance.orderBy("mode").collect()]
    assert abs(sum(ratio) - 1) < 1e-9 and ratio == sorted(ratio, reverse=True)


def test_gaps_are_told(spark):
    cube = spark.createDataFrame([(c, t, float(c * t + t * t)) for c in range(4) for t in range(5) if (c, t) != (2, 3)], "cell int, t int, v double")
    with pytest.raises(ValueError, match="1 of 4 cells"):
        generator.eof(cube, "cell", "t", "v")
    assert generator.eof(cube, "cell", "t", "v", drop_gaps=True)[0].select("cell").distinct().count() == 3


def test_realisations_add_moments_and_season(spark):
    rng = np.random.default_rng(10)
    cells, steps = 700, 9  # more cells than a block has
    cube = spark.createDataFrame([(c, t, float(v)) for (c, t), v in np.ndenumerate(rng.normal(size=(cells, steps)))], "cell int, t int, v double")
    z = ts.normalise(cube, "cell", "v", "z")
    loadings, scores, _ = generator.eof(z.select("cell", "t", "z"), "cell", "t", "z")
    season = cube.filter("NOT (cell = 3 AND t = 2)").select("cell", "t", (F.col("t") * 100.0).alias("s"))
    own = scores.withColumn("realization", F.lit(0))
    got = generator.realisations(loadings, own, z.select("cell", "v_mean", "v_std").distinct(), season, "cell", "t", "v_mean", "v_std", "s")
    both = got.join(cube, ["cell", "t"])
    assert got.count() == cells * steps - 1 and both.filter(F.abs(F.col("value") - F.col("v") - F.col("t") * 100) > 1e-8).count() == 0


def test_every_nth_of_a_large_key(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END k", "id", "1 __n")
    got = {(r.k, r.id) for r in stats.every_nth(df, "k", "id", 7).collect()}
    order = {k: sorted(i for i in range(5000) if (i % 10 == 0) == (k == "b")) for k in "ab"}
    assert got == {(k, i) for k, v in order.items() for i in v[::7]}


def test_a_cluster_needs_a_shared_folder():
    from gridloom.sources import shared

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077", "getConf": staticmethod(lambda: Cluster.conf)})

    with pytest.raises(ValueError):
        shared.checkpoint_dir(Cluster)


def test_stored_tables_can_be_forgotten(spark, synthetic):
    import os

    from gridloom.sources import shared

    held = shared.stored(synthetic, "test")
    assert held.count() == 288 and os.path.isdir(held._stored_in)
    shared.forgotten(held, synthetic)
    assert not os.path.isdir(held._stored_in)


def test_unknown_names_are_refused(spark):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    subset.require_known(names.limit(1), names, "name")
    with pytest.raises(ValueError):
        subset.require_known(spark.createDataFrame([("c",)], "name string"), names, "name")


def test_polygons_and_run_specs(spark, tmp_path):
    path = tmp_path / "r.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"name":"B"},"geometry":{"type":"MultiPolygon","coordinates":[[[[2,2],[3,2],[3,3],[2,2]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}')
    got = {r.name: (r.xmin, r.xmax, len(r.rings)) for r in io.read_polygons(spark, str(path)).collect()}
    assert got == {"A": (0.0, 1.0, 1), "B": (2.0, 6.0, 2)}
    runs = spark.createDataFrame([("E1", "EM1"), ("E1", "EM10"), ("E2", "CTRL")], "ensemble string, experiment string")
    assert {r.display_name for r in io.select_runs(runs, "EM?, E2:*").collect()} == {"E1:EM1", "E2:CTRL"}


def test_sinks_round_trip(spark, tmp_path, synthetic):
    io.write_by(synthetic, str(tmp_path / "a"), "cell")
    assert io.read_cube(spark, str(tmp_path / "a"), "cell", "v").count() == 288
    io.write_realisations(synthetic.withColumn("realization", F.col("cell")), str(tmp_path / "b"), {"units": "kg"})
    assert spark.read.parquet(str(tmp_path / "b")).filter("realization = 2 AND units = 'kg'").count() == 48
    sets = spark.createDataFrame([("s", 0.1, 0.2, 1.0, 50, 5)], "set_name string, min_r2 double, min_corr double, penalty double, n_bins int, min_points int")
    io.write_json(sets, str(tmp_path / "c"))
    assert io.read_parameter_sets(spark, str(tmp_path / "c")).collect() == sets.collect()
    io.write_summary(sets, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).first().set_name == "s"
    synthetic.select("cell", "t", "v").coalesce(2).write.parquet(str(tmp_path / "e"))
    io.process_directory(spark, str(tmp_path / "e"), lambda df: df.withColumn("v", F.col("v") * 2), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 288
    io.write_predictions(synthetic.withColumn("w", F.col("v")), str(tmp_path / "g"), "month", "cell", ["v", "w"])
    assert spark.read.parquet(str(tmp_path / "g")).count() == 576


def test_projection_of_the_pole_and_true_scale(spark):
    x, y = scalars.polar_stereographic("lon", "lat")
    df = spark.createDataFrame([(0.0, -90.0), (90.0, -71.0), (0.0, -71.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert abs(df[0].x) < 1e-6 and abs(df[0].y) < 1e-6
    assert abs(df[1].x - 2082760.1) < 1 and abs(df[2].y - 2082760.1) < 1


def test_gaps_that_change_with_time_are_filled_from_that_time(spark):
    grid = spark.createDataFrame([(c, c, 0) for c in range(4)], "cell int, ix int, iy int")
    bridge = spark.createDataFrame([(c, 1) for c in range(4)], "cell int, region_id int")
    cube = spark.createDataFrame([(0, 0, 10.0), (1, 0, 11.0), (2, 0, None), (0, 1, 20.0), (3, 1, 23.0)], "cell int, t int, v double")
    got = {(r.t, r.cell): r.v for r in fill.extrapolate(cube, bridge, grid, "cell", "t", "v").collect()}
    assert got == {(0, 0): 10.0, (0, 1): 11.0, (0, 2): 11.0, (0, 3): 11.0, (1, 0): 20.0, (1, 1): 20.0, (1, 2): 23.0, (1, 3): 23.0}


def test_own_functions_over_series_and_columns(synthetic):
    from gridloom.operators import apply

    got = apply.over_series(synthetic, "cell", "t", "v", lambda y: np.cumsum(y)).filter("t = 47 AND cell = 0").first()
    assert abs(got.value - sum(0.5 * t + math.sin(2 * math.pi * t / 12) for t in range(48))) < 1e-9
    assert apply.over_columns(synthetic, ["v"], lambda c: c * 0).agg(F.sum("v")).first()[0] == 0


def test_a_stored_decomposition_is_read_back(spark, tmp_path):
    rng = np.random.default_rng(6)
    cube = spark.createDataFrame([(c, t, float(v)) for (c, t), v in np.ndenumerate(rng.normal(size=(8, 6)))], "cell int, t int, v double")
    io.write_decomposition(*generator.eof(cube, "cell", "t", "v"), str(tmp_path))
    loadings, scores, _ = io.read_decomposition(spark, str(tmp_path))
    back = generator.reconstructed(loadings, scores, "cell", "t").join(cube, ["cell", "t"])
    mean = cube.groupBy("cell").agg(F.avg("v").alias("m"))
    assert back.join(mean, "cell").filter(F.abs(F.col("value") + F.col("m") - F.col("v")) > 1e-9).count() == 0


def test_means_follow_new_files(spark, tmp_path):
    from gridloom.streaming import means

    place, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, 2.0), (2, 4.0)], "cell int, v double").write.parquet(place)
    for _ in range(2):
        means.keep_up(means.running_means(means.read_growing(spark, place), "cell", "v"), out, state, once=True).awaitTermination()
        got = {r.cell: (r.mean, r.n) for r in spark.read.parquet(out).collect()}
        spark.createDataFrame([(1, 4.0)], "cell int, v double").write.mode("append").parquet(place)
    means.keep_up(means.running_means(means.read_growing(spark, place), "cell", "v"), out, state, once=True).awaitTermination()
    assert got[1] == (3.0, 2) and {r.cell: r.mean for r in spark.read.parquet(out).collect()} == {1: 10.0 / 3, 2: 4.0}


def test_members_with_other_lengths_are_left_out(spark):
    base = spark.createDataFrame([(m, 0, t, 1.0) for m in (0, 1) for t in range(6)], "member int, cell int, t int, v double")
    trend = spark.createDataFrame([(0, 0, t, 2.0) for t in range(4)] + [(1, 0, t, 2.0) for t in range(3)], "member int, cell int, t int, v double")
    done, state = ts.apply_to_members(base, trend, "member", "cell", "t", "v", 2)
    assert {r.member: r.ok for r in state.collect()} == {0: True, 1: False}
    assert [r.v for r in done.orderBy("t").collect()] == [1.0, 1.0, 3.0, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("most", [3, 40, 10**6])
def test_ordered_scans_by_brute_force(spark, most):
    """Long keys, null keys, repeated times, missing values; cut into blocks or not."""
    import random

    from gridloom.operators import ordered

    rng = random.Random(7)
    rows = [(k, rng.randint(0, 60) / 2, rng.choice([None, rng.random()])) for k in ("a", "b", None) for _ in range({"a": 200, "b": 12}.get(k, 30))]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    goals = [x / 4 - 3 for x in range(140)]
    near = {(r.k, r.g): (r["__a"] and tuple(r["__a"]), r["__b"] and tuple(r["__b"])) for r in ordered.between(df, "k", "t", "v", spark.createDataFrame([(g,) for g in goals], "g double"), "g", False, most).collect()}
    for k in ("a", "b", None):
        own = sorted((t, v) for x, t, v in rows if x == k and v is not None)
        for g in goals:
            if k is not None:
                a, b = [p for p in own if p[0] <= g], [p for p in own if p[0] > g]
                assert near[k, g] == (a[-1] if a else None, min(b) if b else None)
    steps = spark.createDataFrame([(k, i, v) for i, (k, t, v) in enumerate(rows)], "k string, i long, v double")
    got = {(r.k, r.i): r.s for r in ordered.running_sums(steps, "k", "i", {"s": F.col("v") * 2}, most).collect()}
    for k in ("a", "b", None):
        total = None
        for i, (x, _, v) in enumerate(rows):
            if x == k:
                total = total if v is None else (total or 0.0) + 2 * v
                assert got[k, i] == (total if total is None else pytest.approx(total))


def test_long_series_stay_in_blocks(spark):
    """No window holds more of a key than a block, and targets do not travel with points."""
    from gridloom.operators import ordered

    df = spark.range(50_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    own, many = ordered.blocked(df, "k", "t", 10_000)
    sizes = [r["count"] for r in own.groupBy("__block").count().collect()]
    assert many and len(sizes) == 5 and max(sizes) < 20_000
    goals = spark.range(0, 50_000, 700).select((F.col("id") + 0.5).alias("target"))
    near = ordered.between(df, "k", "t", "v", goals, "target", True, 10_000)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
    got = near.collect()
    assert len(got) == 72 and all(r["__a"].t == r.target - 0.5 and r["__b"].t == r.target + 0.5 for r in got)


@pytest.fixture(scope="module")
def monthly(spark):
    """Three cells with a trend, a season and gaps; one cell with a single time, one without values."""
    import random

    rng = random.Random(4)
    rows = [(c, t, t % 12, None if rng.random() < 0.1 else 1e4 + 3 * c * t + 50 * ((t % 12) - 5) + rng.random()) for c in (1, 2, 3) for t in range(7, 90)]
    return spark.createDataFrame([*rows, (4, 30, 6, 8.0), (5, 30, 6, None)], "cell int, t int, month int, v double").cache()


def by_one_go(df):
    """The same by detrending and deseasonalising the whole series."""
    flat = ts.detrend(df.filter("v is not null"), "cell", "t", "v", "y")
    left = ts.deseasonalise(flat, "cell", "month", "y", "z")
    means = {r.cell: (r.n, r.mean, r.left) for r in left.groupBy("cell").agg(F.count("v").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("left")).collect()}
    season = {(r.cell, r.month): r.s for r in flat.groupBy("cell", "month").agg(F.avg("y").alias("s")).collect()}
    return means, season


def agrees(done, want):
    means, season = want
    got = {r.cell: r for r in done.collect()}
    assert got.keys() == means.keys()
    for c, (n, mean, left) in means.items():
        assert got[c].n == n and (got[c].mean, got[c].left) == (pytest.approx(mean), pytest.approx(left, abs=1e-6))
        assert {m.month: m.season + mean for m in got[c].seasons} == pytest.approx({m: s for (k, m), s in season.items() if k == c})


@pytest.mark.parametrize("seed", range(3))
def test_moments_of_any_parts_in_any_order(spark, monthly, seed):
    from gridloom.operators import moments

    parts = [moments.state(monthly.filter((F.hash("cell", "t") + seed) % 5 == i), "cell", "t", "month", "v", 40.0, 1e4) for i in range(-4, 5)]
    left, right = moments.merged(*parts[::2], key="cell"), moments.merged(*reversed(parts[1::2]), key="cell")
    agrees(moments.finished(moments.merged(right, left, key="cell"), "cell", 1e4), by_one_go(monthly))


def test_moments_follow_new_files(spark, monthly, tmp_path):
    """Rounds of files, compacted level by level; a round that is run again changes nothing."""
    import os

    from gridloom.streaming import means
    from gridloom.streaming import moments as streamed

    place, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(9):
        monthly.filter(f"abs(hash(cell, t)) % 9 = {i}").coalesce(1).write.mode("append").parquet(place)
        stream = means.read_growing(spark, place)
        streamed.follow(stream, "cell", "t", "month", "v", out, state, once=True, t0=40.0, v0=1e4, fan=3).awaitTermination()
        folders = sorted(x for x in os.listdir(out) if x.startswith("rounds"))
        assert len(folders) <= 4
    assert folders == ["rounds-0-8"]
    agrees(streamed.now(spark, out, "cell", 1e4), by_one_go(monthly))
    streamed._compacted(spark, out, 8, "cell", 3)
    monthly.limit(0).write.mode("append").parquet(place)
    streamed.follow(means.read_growing(spark, place), "cell", "t", "month", "v", out, state, once=True, t0=40.0, v0=1e4, fan=3).awaitTermination()
    agrees(streamed.now(spark, out, "cell", 1e4), by_one_go(monthly))
    with pytest.raises(ValueError, match="round"):
        streamed.now(spark, str(tmp_path / "none"), "cell")


def empty_circles(tri, x, y):
    """Whether no point lies in the circle of any triangle."""
    for t in tri:
        p, q, r = sorted(t), x, y
        a, b, c = ((q[i], r[i]) for i in p)
        m = np.array([[b[0] - a[0], b[1] - a[1]], [c[0] - a[0], c[1] - a[1]]])
        centre = np.linalg.solve(2 * m, (m**2).sum(axis=1))
        inside = np.hypot(x - a[0] - centre[0], y - a[1] - centre[1]) < np.hypot(*centre) * (1 - 1e-7)
        if inside.any():
            return False
    return True


@pytest.mark.parametrize("kind", ["scattered", "clustered", "grid"])
def test_tiled_triangles(spark, kind):
    """Every circle is empty over all nodes, and triangles cover the hull once, however nodes are dealt."""
    rng = np.random.default_rng(6)
    if kind == "grid":
        p = np.array([(i, j) for i in range(14) for j in range(9)], float)
    else:
        p = rng.random((260, 2)) * [10, 3]
        if kind == "clustered":
            p[:180] = [4, 1] + 0.03 * rng.standard_normal((180, 2))
    rows = [(i + 7, float(a), float(b), "k") for i, (a, b) in enumerate(p)]
    extra = [(10_000, *rows[5][1:]), (10_001, None, 2.0, "k"), (10_002, 1.0, float("nan"), "k")]  # a second node at one place, two without a place
    df = spark.createDataFrame(rows + extra, "node long, x double, y double, a string").repartition(3)
    got = meshes.delaunay(df, tile=40).toPandas()
    tri = got[["a", "b", "c"]].to_numpy() - 7
    assert tri.max() < len(p) and (np.diff(tri, axis=1) > 0).all() and len({tuple(t) for t in tri}) == len(tri)
    assert (got[["ax", "ay"]].to_numpy() == p[tri[:, 0]]).all()
    assert empty_circles(tri, p[:, 0], p[:, 1])
    whole = meshes.triangulated(p[:, 0] + 1e-9 * rng.random(len(p)), p[:, 1] + 1e-9 * rng.random(len(p)))
    hull = whole[whole[:, 2] < 0]
    area = lambda t: abs(np.linalg.det(np.stack([p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]], axis=1))).sum() / 2
    assert area(tri) == pytest.approx(area(whole[whole[:, 2] >= 0]))
    if kind != "grid":
        assert len(tri) == 2 * len(p) - 2 - len(hull)


def test_no_triangles_on_a_line(spark):
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(30)], "node int, x double, y double")
    assert meshes.delaunay(line, tile=5).collect() == []
    assert meshes.delaunay(line.limit(0)).collect() == []
    assert meshes.delaunay(line.limit(2)).collect() == []


def test_selected_quantiles_are_exact(spark, monkeypatch):
    """As Spark's own percentile, to the last bit: small and large keys, ties, nulls, null keys, two key columns."""
    from gridloom.operators import selection

    monkeypatch.setattr(selection, "ACCURACY", 200)
    monkeypatch.setattr(selection, "MARGIN", 3 / 200)
    rng = np.random.default_rng(8)
    rows = [("hot", i % 2, float(v)) for i, v in enumerate(rng.normal(size=6000))] + [("ties", 0, float(v)) for v in rng.integers(0, 3, 900)]
    rows += [(None, 1, float(v)) for v in rng.random(7)] + [("one", 0, 2.5), ("none", 0, None), ("two", None, 1.0), ("two", None, None), ("two", None, 4.0)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.7, 0.999, 1.0)
    got = {(r.k, r.j): r["__q"] for r in selection.quantiles_of(df, ["k", "j"], "v", *shares).collect()}
    want = {(r.k, r.j): r.q for r in df.groupBy("k", "j").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert {k: v or [None] * 7 for k, v in want.items()} == {k: v or [None] * 7 for k, v in got.items()}


def test_a_hot_key_is_not_gathered(spark):
    """Nine tenths of all rows are one key; what is counted by value is some thousandths of them."""
    from gridloom.operators import selection

    df = spark.range(400_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("k"), F.rand(3).alias("v")).repartition(8)
    grouped = df.groupBy("k").agg(selection.sketch("v", (0.25, 0.75)).alias("s"))
    ends = grouped.filter("k = -1").first().s
    inside = sum(df.filter((F.col("k") == -1) & F.col("v").between(ends.ends[i], ends.ends[i + 1])).count() for i in (0, 2))
    assert ends.n == 360_000 and inside < 2 * 10 * ends.n / selection.ACCURACY
    got = {r.k: r["__q"] for r in selection.quantiles_of(df, ["k"], "v", 0.25, 0.75).collect()}
    assert got == {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).collect()}


def test_leading_modes_without_a_gram_matrix(spark, monkeypatch):
    """Subspace iteration gives the modes, scores and shares of the exact decomposition."""
    rng = np.random.default_rng(11)
    field = rng.normal(size=(60, 4)) @ (np.array([8.0, 4.0, 2.0, 1.0])[:, None] * rng.normal(size=(4, 90))) + 0.05 * rng.normal(size=(60, 90))
    cube = spark.createDataFrame([(c, t, float(x)) for (c, t), x in np.ndenumerate(field)], "cell int, t int, v double").repartition(5)
    want = [x.toPandas() for x in generator.eof(cube, "cell", "t", "v", modes=4)]
    monkeypatch.setattr(generator, "MOST_STEPS", 50)
    got = [x.toPandas() for x in generator.eof(cube, "cell", "t", "v", modes=4)]
    for a, b, own, value in zip(want, got, (["cell", "mode"], ["t", "mode"], ["mode"]), ("loading", "score", "ratio")):
        a, b = (x.sort_values(own)[value].to_numpy() for x in (a, b))
        assert np.allclose(a, b, atol=1e-4 * np.abs(a).max())
    with pytest.raises(ValueError, match="modes"):
        generator.eof(cube, "cell", "t", "v")
    monkeypatch.setattr(generator, "LONGEST", 80)
    with pytest.raises(ValueError, match="80"):
        generator.eof(cube, "cell", "t", "v", modes=4)


def test_resume_writes_only_what_lacks(spark, tmp_path):
    """A part lost, a part without rows, a part of a broken run, odd names; finished parts are not touched."""
    import os
    import shutil

    path = str(tmp_path / "out")
    work = spark.createDataFrame([("a b/c",), ("none",), ("x",), ("y",)], "name string")
    rows = spark.createDataFrame([("a b/c", 1), ("x", 2), ("x", 3), ("y", 4)], "name string, v int")
    seen = []

    def compute(some, broken=False):
        seen.append(sorted(r[0] for r in some.collect()))
        if broken and "y" in seen[-1]:
            rows.withColumn("v", F.lit(-1)).join(some, "name").write.mode("append").partitionBy("name").parquet(path)
            raise RuntimeError("broken")
        return rows.join(some, "name")

    with pytest.raises(RuntimeError):
        io.resume(spark, work, "name", lambda some: compute(some, True), path, "one", 3)
    assert {(r.name, r.v, r.run) for r in io.read_finished(spark, path, "name").collect()} == {("a b/c", 1, "one"), ("x", 2, "one"), ("x", 3, "one")}
    seen.clear()
    assert io.resume(spark, work, "name", compute, path, "two", 3) == 1 and seen == [["y"]]
    assert io.resume(spark, work, "name", compute, path, "three", 3) == 0
    kept = os.stat(f"{path}/name=y").st_mtime_ns
    shutil.rmtree(f"{path}/name=x")
    seen.clear()
    assert io.resume(spark, work, "name", compute, path, "four", 3) == 1 and seen == [["x"]]
    assert os.stat(f"{path}/name=y").st_mtime_ns == kept
    assert {(r.name, r.v, r.run) for r in io.read_finished(spark, path, "name").collect()} == {("a b/c", 1, "one"), ("x", 2, "four"), ("x", 3, "four"), ("y", 4, "two")}


@pytest.mark.parametrize("buffer", [0.0, 0.3])
def test_coverings_agree_with_edges(spark, buffer):
    """Inside and outside squares hold no point that the edges say otherwise of; long edges, holes, slivers, a far-off region."""
    from gridloom.operators import regions

    rng = np.random.default_rng(12)
    star = [(5 + (4 if i % 2 else 1.2) * np.cos(i * np.pi / 9), 5 + (4 if i % 2 else 1.2) * np.sin(i * np.pi / 9)) for i in range(18)]
    shapes = [[star], [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)]], [[(0, 0), (10, 9.9), (10, 10)]], [[(1, 1), (1, 9), (1.0001, 9), (1.0001, 1)]], [[(1000, 1000), (1001, 1000), (1001, 1001)]]]
    rows = [(i, str(i), [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    own = regions.with_bounds(spark.createDataFrame(rows, "region_id int, name string, rings array<array<struct<x:double,y:double>>>"))
    points = np.vstack([rng.random((1500, 2)) * 11 - 0.5, np.array(star), [(0, 0), (10, 10), (2, 5), (5, 2), (1, 5)]])
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "cell_id int, x double, y double")
    got = {(r.cell_id, r.region_id) for r in regions.cell_region(cells, own, buffer=buffer).collect()}
    want, settled = set(), 0
    for k, rings in enumerate(shapes):
        ends = [(a, ring[(i + 1) % len(ring)]) for ring in rings for i, a in enumerate(ring)]
        box = [f(p[c] for ring in rings for p in ring) + s * buffer for c in (0, 1) for f, s in ((min, -1), (max, 1))]
        cover = regions.covering(rows[k][2], box, buffer)
        settled += (cover != regions.EDGE).sum()
        for i, (x, y) in enumerate(points):
            inside = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in ends) % 2
            away = np.inf
            for a, b in ends:
                d = np.subtract(b, a)
                f = min(max(np.dot(np.subtract((x, y), a), d) / np.dot(d, d), 0), 1)
                away = min(away, np.hypot(x - a[0] - f * d[0], y - a[1] - f * d[1]))
            if inside or (buffer and away <= buffer):
                want.add((i, k))
    assert got == want and settled > 3000


def test_far_targets_meet_few_sources(spark, monkeypatch):
    """Targets far from all sources: as brute force, ties included, and with few pairs."""
    from gridloom.operators import fill

    rng = np.random.default_rng(13)
    src = np.vstack([rng.random((4000, 2)) * [30, 2], np.floor(rng.random((300, 2)) * 10) + [0, -40]])
    goal = np.vstack([rng.random((150, 2)) * 400 - 200, np.floor(rng.random((60, 2)) * 10) + [0, -60], [(1e6, 1e6), (5.5, -40.5)]])
    sources = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(src)], "sid int, x double, y double")
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(goal)], "tid int, x double, y double")
    met = []
    best = fill._best
    monkeypatch.setattr(fill, "_best", lambda x, y: met.append(1) or best(x, y))
    got = {r.tid: (r.sid, r.dist) for r in fill.nearest(targets, sources, "tid", "x", "y", "sid", 0.5).collect()}
    for i, (x, y) in enumerate(goal):
        d2 = (src[:, 0] - x) * (src[:, 0] - x) + (src[:, 1] - y) * (src[:, 1] - y)
        k = min(range(len(src)), key=lambda j: (d2[j], src[j, 1], src[j, 0], j))
        assert got[i] == (k, pytest.approx(np.sqrt(d2[k])))
    assert len(met) == fill.ROUNDS + 1
    far = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((200, 2)) * 50 + [300, 300])], "tid int, x double, y double")
    src_ = fill.stored(sources.select(F.col("x").alias("__sx"), F.col("y").alias("__sy"), F.col("sid").alias("__id")), "t")
    monkeypatch.setattr(fill, "_best", lambda x, y: F.count("*").alias("__b"))
    pairs = fill._far(far, src_, ["tid", "x", "y"], [], "x", "y", 0.5).agg(F.sum("__b")).first()[0]
    assert pairs < 200 * 60  # of 200 * 4300


def test_fill_map_of_deep_gaps(spark):
    """One region's values lie in a corner of a wide grid; another has a single value."""
    from gridloom.operators import fill

    cells = [(r, x * 1000 + y, x, y) for r in ("a", "b") for x in range(0, 60) for y in range(0, 40)]
    valid = [("a", x * 1000 + y) for x in range(4) for y in range(3)] + [("b", 30 * 1000 + 20)]
    df = spark.createDataFrame(cells, "region string, cell int, ix int, iy int")
    got = {(r.region, r.cell): r.source for r in fill.fill_map(df, spark.createDataFrame(valid, "region string, cell int"), "region", "cell", "ix", "iy").collect()}
    for r, c, x, y in cells:
        own = [v for q, v in valid if q == r]
        if c not in own:
            assert got[r, c] == min(own, key=lambda v: ((v // 1000 - x) ** 2 + (v % 1000 - y) ** 2, v % 1000, v // 1000))
    assert len(got) == len(cells) - len(valid)


def test_kernels_are_cut_where_nothing_is_left(spark):
    """Equal to all kernels at all points to twelve digits, with few pairs; keys of one value have no density."""
    rng = np.random.default_rng(14)
    own = {"a": rng.normal(size=900), "b": np.append(rng.normal(40, 2, 300), 55.0), "one": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [("a", None), ("none", None)], "k string, v double")
    got = stats.kernel_density(df, "k", "v").toPandas()
    lo, hi = min(v.min() for v in own.values()), max(v.max() for v in own.values())
    x = lo - 0.1 * (hi - lo) + (hi - lo) * 1.2 * np.arange(300) / 299
    assert set(got["k"]) == set(own) and len(got) == 3 * 300
    for k, v in own.items():
        d = got[got["k"] == k].sort_values("point")
        assert np.allclose(d["x"], x)
        if len(v) == 1:
            assert d["density"].isna().all()
            continue
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose(d["density"], want, rtol=1e-12, atol=1e-16)


def test_weights_over_times_as_one_by_one(spark):
    """Blocked products give what a join and a sum give: gaps, missing times, repeated weights, ids that are text, negative times."""
    rng = np.random.default_rng(15)
    rows = [(s, int(t), None if rng.random() < 0.2 else float(rng.normal())) for s in range(40) for t in rng.choice(np.arange(-700, 900), 30, replace=False)]
    field = spark.createDataFrame(rows, "cell int, t int, v double")
    weights = spark.createDataFrame([(f"d{d}", int(s), float(w)) for d in range(30) for s, w in zip(rng.integers(0, 45, 4), rng.random(4))], "dst string, src int, w double")
    for limit in (None, 0.3):
        got = {(r.t, r.dst): r.v for r in regrid.apply_weights_over(field, weights, "cell", "t", "v", limit).collect()}
        want = {(r.t, r.dst): r.v for r in regrid.apply_weights(field, weights, "cell", "v", "t", limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] is None if x is None else got[k] == pytest.approx(x, abs=1e-9) for k, x in want.items())


def test_weights_over_times_add_up_once_for_all_results(spark):
    """Results with several thresholds come from one product a block; none is made again or joined to another."""
    rows = [(s, t, None if (s + t) % 3 == 0 else float(s * t)) for s in range(20) for t in (-513, -1, 0, 5, 1300)]
    field = spark.createDataFrame(rows, "cell int, t int, v double")
    weights = spark.createDataFrame([(d, (d * 7 + k) % 23, 0.25 * (k + 1)) for d in range(600) for k in range(3)], "dst long, src int, w double")
    got = regrid.apply_weights_over(field, weights, "cell", "t", "v", more={"mean": 0.5, "any": 0.0})
    assert got.columns == ["t", "dst", "v", "mean", "any"]
    found = {(r.t, r.dst): r for r in got.collect()}
    for name, limit in (("v", None), ("mean", 0.5), ("any", 0.0)):
        want = {(r.t, r.dst): r.v for r in regrid.apply_weights(field, weights, "cell", "v", "t", limit).collect()}
        assert found.keys() == want.keys()
        assert all(found[k][name] is None if x is None else found[k][name] == pytest.approx(x, abs=1e-9) for k, x in want.items())
    plan = registry.QUERIES["j_weights_over_times"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
