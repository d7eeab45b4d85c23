"""Queries of the regression of melt on draft."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import regress, stats
from ..sources.shared import kept
from .base import BENT, CELL_REGION, CUBE, NOISE, POINTS, Tables, query


@query("""SELECT region, {r:regr_slope(melt, draft)} AS slope, {r:regr_intercept(melt, draft)} AS intercept, regr_count(melt, draft)::BIGINT AS n FROM points GROUP BY 1""", ctes=POINTS)
def r_draft_regression(t: Tables) -> DataFrame:
    return regress.draft_regression(t.points, "region", "draft", "melt")


_GAPS = "gaps AS (SELECT region, CASE WHEN point % 7 = 0 THEN NULL ELSE draft END AS draft, CASE WHEN point % 5 = 0 THEN NULL ELSE melt END AS melt, point FROM points)"


def _gaps(t: Tables) -> DataFrame:
    return t.points.withColumns({"draft": F.when(F.col("point") % 7 != 0, F.col("draft")), "melt": F.when(F.col("point") % 5 != 0, F.col("melt"))})


@query("""SELECT region, {r:regr_slope(coalesce(melt, 0), coalesce(draft, 0))} AS slope, {r:regr_intercept(coalesce(melt, 0), coalesce(draft, 0))} AS intercept, count(*) AS n FROM gaps GROUP BY 1""", ctes=f"{POINTS}, {_GAPS}")
def r_draft_regression_zero(t: Tables) -> DataFrame:
    return regress.draft_regression(_gaps(t), "region", "draft", "melt", missing="zero")


@query("""SELECT region, {r:slope} AS slope, {r:(sy - slope * sx) / sw} AS intercept, n FROM (
  SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM (
    SELECT region, sum(w) AS sw, sum(w * draft) AS sx, sum(w * melt) AS sy, sum(w * draft * draft) AS sxx, sum(w * draft * melt) AS sxy, count(*) AS n
    FROM (SELECT *, pow(draft, 0.25) AS w FROM gaps WHERE draft IS NOT NULL AND melt IS NOT NULL) GROUP BY 1))""", ctes=f"{POINTS}, {_GAPS}")
def r_draft_regression_weighted(t: Tables) -> DataFrame:
    own = _gaps(t).withColumn("w", scalars.draft_weight("melt", "draft", 0.25))
    return regress.draft_regression(own, "region", "draft", "melt", weight="w")


@query("""f AS (SELECT region, regr_slope(melt, draft) AS s, regr_intercept(melt, draft) AS i FROM points GROUP BY 1)
SELECT region, point, {r:s * draft + i} AS fit FROM points JOIN f USING (region)""", ctes=POINTS)
def r_fitted_field(t: Tables) -> DataFrame:
    return regress.with_fit(t.points, regress.draft_regression(t.points, "region", "draft", "melt"), "region", "draft").select("region", "point", "fit")


@query("SELECT cell, {r:regr_slope(v, draft)} AS slope, {r:regr_intercept(v, draft)} AS intercept, regr_count(v, draft)::BIGINT AS n FROM cube GROUP BY 1", ctes=CUBE)
def r_cell_regression(t: Tables) -> DataFrame:
    return regress.draft_regression(t.cube, "cell", "draft", "v")


def _bins(n: int, of: str = "bent") -> str:
    return f"""ends AS (SELECT region, min(draft) AS lo, max(draft) AS hi FROM {of} GROUP BY 1),
bins AS (SELECT region, floor((draft - lo) / ((hi - lo) / {n}))::INT AS bin, lo, hi, draft, melt FROM {of} JOIN ends USING (region))"""


_BINS = _bins(20)


@query("""SELECT region, bin, {r:first(lo) + (bin + 0.5) * (first(hi) - first(lo)) / 20} AS centre, {r:avg(draft)} AS draft, {r:avg(melt)} AS melt, count(*) AS n FROM bins WHERE bin < 20 GROUP BY region, bin HAVING count(*) >= 5""", ctes=f"{BENT}, {_BINS}")
def r_binned(t: Tables) -> DataFrame:
    return regress.binned(t.bent, "region", "draft", "melt", 20, 5)


@query("""SELECT region, bin, {r:first(lo) + (bin + 0.5) * (first(hi) - first(lo)) / 20} AS centre, {r:avg(draft)} AS draft, {r:median(melt)} AS melt, count(*) AS n FROM bins WHERE bin < 20 GROUP BY region, bin HAVING count(*) >= 5""", ctes=f"{BENT}, {_BINS}")
def r_binned_median(t: Tables) -> DataFrame:
    return regress.binned(t.bent, "region", "draft", "melt", 20, 5, median=True)


_GATE = """gate AS (SELECT region, count(*) AS n, corr(draft, melt) AS correlation, regr_r2(melt, draft) AS r2, avg(melt) AS melt_mean, max(draft) - min(draft) AS draft_range FROM {} GROUP BY 1)"""


@query("""SELECT region, n, {r:correlation} AS correlation, {r:r2} AS r2, {r:melt_mean} AS melt_mean, {r:draft_range} AS draft_range,
  n >= 20 AND abs(correlation) >= 0.3 AND r2 >= 0.1 AS is_meaningful FROM gate""", ctes=f"{POINTS}, {_GATE.format('points')}")
def r_quality_gate(t: Tables) -> DataFrame:
    return regress.quality(t.points, "region", "draft", "melt").drop("p_value")


#: Two-sided p-values by the incomplete beta function's sum for an even number of degrees n - 2 = 2 m: with x = 1 - r * r, and
#: for an odd one by the angle's sum.
_P_VALUE = """p AS (SELECT region, n, r, (n - 2)::INT AS df, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS angle FROM (SELECT region, count(*) AS n, corr(draft, melt) AS r FROM few GROUP BY 1)),
terms AS (
  SELECT region, df, angle, list_transform(range(0, greatest((df + df % 2) // 2 - df % 2, 0)), lambda i: pow(cos(angle), 2 * i + df % 2) * coalesce(list_product(list_transform(range(1, i + 1), lambda j: CASE WHEN df % 2 = 0 THEN (2 * j - 1) / (2 * j) ELSE (2 * j) / (2 * j + 1) END)), 1)) AS term FROM p)"""


@query("""SELECT region, {r:1 - CASE WHEN df % 2 = 0 THEN sin(angle) * list_sum(term) WHEN df = 1 THEN 2 * angle / pi() ELSE 2 / pi() * (angle + sin(angle) * list_sum(term)) END} AS p_value FROM terms""", digits=6,
       ctes=f"few AS (SELECT p_brand AS region, p_size AS draft, p_retailprice AS melt FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 4)), {_P_VALUE}")
def r_quality_p_values(t: Tables) -> DataFrame:
    own = t.part.select(F.col("p_brand").alias("region"), F.col("p_size").alias("draft"), F.col("p_retailprice").alias("melt"))
    return regress.quality(own, "region", "draft", "melt").filter("n >= 4").select("region", "p_value")


# one break by least squares, and one by a window of five bins, over the binned curve
_CURVE = f"""{_bins(50)},
curve AS (
  SELECT region, avg(draft) AS draft, avg(melt) AS y, row_number() OVER (PARTITION BY region ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY region) AS n
  FROM bins WHERE bin < 50 GROUP BY region, bin),
run AS (
  SELECT *, sum(y) OVER w AS s, sum(y * y) OVER w AS q, sum(y) OVER (PARTITION BY region) AS ss, sum(y * y) OVER (PARTITION BY region) AS qq,
    lag(y, 2) OVER o AS a, lag(y) OVER o AS b, lead(y) OVER o AS d
  FROM curve WINDOW w AS (PARTITION BY region ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY region ORDER BY i)),
split AS (SELECT region, 'binseg' AS method, i, qq - ss * ss / n - (q - s * s / i) - (qq - q - (ss - s) * (ss - s) / (n - i)) AS gain FROM run WHERE i % 5 = 0 AND i >= 2 AND n - i >= 2),
near AS (SELECT region, i, a * a + b * b + y * y + d * d - pow(a + b + y + d, 2) / 4 - pow(a - b, 2) / 2 - pow(y - d, 2) / 2 AS gain FROM run WHERE i % 5 = 0 AND i >= 2 AND i < n - 2),
peak AS (
  SELECT region, 'window' AS method, i, gain FROM (
    SELECT *, coalesce(lag(gain) OVER o, last_value(gain) OVER f) AS before, coalesce(lead(gain) OVER o, first_value(gain) OVER f) AS after FROM near
    WINDOW o AS (PARTITION BY region ORDER BY i), f AS (PARTITION BY region ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WHERE gain > before AND gain > after),
found AS (SELECT region, method, arg_max(i, (gain, i)) AS i FROM (FROM split UNION ALL FROM peak) GROUP BY ALL),
wanted AS (SELECT region, method, median(draft) AS middle, count(*) AS n FROM curve, (VALUES ('binseg'), ('window')) AS m(method) GROUP BY ALL)"""


@query("SELECT w.region, w.method, {r:CASE WHEN w.n >= 10 THEN coalesce(c.draft, w.middle) END} AS threshold FROM wanted w LEFT JOIN found f USING (region, method) LEFT JOIN curve c ON c.region = w.region AND c.i = f.i - 1", ctes=f"{BENT}, {_CURVE}")
def r_thresholds(t: Tables) -> DataFrame:
    bins = regress.binned(t.bent, "region", "draft", "melt", 50, 1)
    binseg, window = (regress.thresholds(bins, "region", method).withColumn("method", F.lit(method)) for method in ("binseg", "window"))
    return binseg.unionByName(window)


@query()
def r_thresholds_pelt(t: Tables) -> DataFrame:
    return regress.thresholds(regress.binned(t.bent, "region", "draft", "melt", 50, 1), "region")


def _knee_sql(name: str, of: str, least: int, running: bool) -> str:
    """The bend of the median curve of ``of`` (region, draft, melt): a running median with zeros beyond the ends if asked for, a
    quadratic least-squares smoother of w values by its closed form, and the largest second difference."""
    y = "list_aggregate(list_concat(list_resize(CAST([] AS DOUBLE[]), greatest(w // 2 - i, 0)::BIGINT, 0), y[greatest(i - w // 2, 0) + 1:i + w // 2 + 1], list_resize(CAST([] AS DOUBLE[]), greatest(i + w // 2 - n + 1, 0)::BIGINT, 0)), 'median')" if running else "y[i + 1]"
    return f"""{name}_ends AS (SELECT region, min(draft) AS lo, max(draft) AS hi FROM {of} GROUP BY 1),
{name}_med AS (SELECT region, bin, first(lo) + (bin + 0.5) * (first(hi) - first(lo)) / 99 AS centre, median(melt) AS m FROM (SELECT region, floor((draft - lo) / ((hi - lo) / 99))::INT AS bin, lo, hi, melt FROM {of} JOIN {name}_ends USING (region)) WHERE bin < 99 GROUP BY region, bin HAVING count(*) >= {least}),
{name}_list AS (SELECT region, list(m ORDER BY bin) AS y, list(centre ORDER BY bin) AS x, count(*) AS n, greatest(least(15, count(*) // 2 * 2 + 1), 3) AS w FROM {name}_med GROUP BY 1),
{name}_run AS (SELECT region, i, n, w, x, {y} AS y FROM (SELECT *, unnest(range(0, n)) AS i FROM {name}_list)),
{name}_all AS (SELECT region, list(y ORDER BY i) AS y, first(x) AS x, first(n) AS n, first(w) AS w FROM {name}_run GROUP BY 1),
{name}_part AS (SELECT region, i, n, x, y, w, w // 2 AS h, least(greatest(i - w // 2, 0), n - w) AS a FROM (SELECT *, unnest(range(0, n)) AS i FROM {name}_all)),
{name}_sum AS (SELECT *, 2.0 * list_sum(list_transform(range(1, h + 1), lambda k: k * k)) AS s2, 2.0 * list_sum(list_transform(range(1, h + 1), lambda k: k * k * k * k)) AS s4 FROM {name}_part),
{name}_smooth AS (SELECT region, i, n, x, list_sum(list_transform(range(0, w), lambda j: y[a + j + 1] * (1.0 / w + (j - h) * (i - a - h) / s2 + ((j - h) * (j - h) - s2 / w) * ((i - a - h) * (i - a - h) - s2 / w) / (s4 - s2 * s2 / w)))) AS z FROM {name}_sum),
{name}_d AS (SELECT region, i, x, (coalesce(lead(z) OVER o, z) - coalesce(lag(z) OVER o, z)) / CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END AS d, n FROM {name}_smooth WINDOW o AS (PARTITION BY region ORDER BY i)),
{name}_dd AS (SELECT region, i, x, (coalesce(lead(d) OVER o, d) - coalesce(lag(d) OVER o, d)) / CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END AS dd FROM {name}_d WINDOW o AS (PARTITION BY region ORDER BY i)),
{name} AS (SELECT region, arg_max(x[i + 1], (round(dd, 9), -i)) AS knee FROM {name}_dd GROUP BY 1)"""


_SKEWED = "skewed AS (SELECT l_returnflag AS region, l_extendedprice / 1000 AS draft, pow(greatest(l_extendedprice / 1000 - 40, 0), 2) / 100 + l_tax AS melt FROM lineitem)"


def _skewed(t: Tables) -> DataFrame:
    """(region, draft, melt): a flat part up to 40 and a parabola beyond, over drafts that differ."""
    melt = F.pow(F.greatest(F.col("l_extendedprice") / 1000 - 40, F.lit(0.0)), F.lit(2)) / 100 + F.col("l_tax")
    return t.lineitem.select(F.col("l_returnflag").alias("region"), (F.col("l_extendedprice") / 1000).alias("draft"), melt.alias("melt"), "l_orderkey", "l_linenumber")


_CLIPPED = "clipped AS (SELECT region, draft, melt FROM skewed JOIN (SELECT region, quantile_cont(draft, 0.01) AS lo_, quantile_cont(draft, 0.99) AS hi_ FROM skewed GROUP BY 1) USING (region) WHERE draft BETWEEN lo_ AND hi_)"
_KNEES = f"{_SKEWED}, {_CLIPPED}, {_knee_sql('plain', 'skewed', 1, False)}, {_knee_sql('smooth', 'clipped', 4, True)}"


@query("SELECT region, {r:plain.knee} AS knee, {r:least(greatest(smooth.knee, 5), 85)} AS smooth_knee FROM plain JOIN smooth USING (region)", ctes=_KNEES)
def w_knee(t: Tables) -> DataFrame:
    plain = regress.knees(_skewed(t), "region", "draft", "melt")
    smooth = regress.knees(_skewed(t), "region", "draft", "melt", smooth=True, low=5.0, high=85.0).withColumnRenamed("knee", "smooth_knee")
    return plain.join(smooth, "region")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice / 1000 > plain.knee THEN 1.0::DOUBLE ELSE 0.0 END AS w, CASE WHEN l_extendedprice / 1000 > smooth.knee THEN 1.0::DOUBLE ELSE 0.0 END AS w_smooth FROM lineitem JOIN plain ON plain.region = l_returnflag JOIN smooth ON smooth.region = l_returnflag", ctes=_KNEES)
def f_dynamic_threshold_weights(t: Tables) -> DataFrame:
    own = regress.with_dynamic_threshold(_skewed(t), "region", "draft", "melt")
    return regress.with_dynamic_threshold(own, "region", "draft", "melt", "w_smooth", smooth=True).select("l_orderkey", "l_linenumber", "w", "w_smooth")


_FIT = """fit AS (SELECT region, 25.0::DOUBLE AS threshold, avg(melt) FILTER (draft < 25) AS shallow_mean, regr_slope(melt, draft) FILTER (draft >= 25) AS slope, regr_intercept(melt, draft) FILTER (draft >= 25) AS intercept, count(*) AS n FROM bent GROUP BY 1)"""


def _at_25(t: Tables) -> DataFrame:
    return t.bent.select("region").distinct().withColumn("threshold", F.lit(25.0))


@query("SELECT region, {r:threshold} AS threshold, {r:shallow_mean} AS shallow_mean, {r:slope} AS slope, {r:intercept} AS intercept, n FROM fit", digits=6, ctes=f"{BENT}, {_FIT}")
def r_piecewise_fit(t: Tables) -> DataFrame:
    return regress.piecewise_fit(t.bent, _at_25(t), "region", "draft", "melt")


_WEIGHTED = """w0 AS (SELECT *, l_linenumber::DOUBLE AS w FROM bent),
w1 AS (SELECT region, sum(w * melt) FILTER (draft < 25) / sum(w) FILTER (draft < 25) AS shallow_mean, sum(w * draft) FILTER (draft >= 25) / sum(w) FILTER (draft >= 25) AS mx, sum(w * melt) FILTER (draft >= 25) / sum(w) FILTER (draft >= 25) AS my, count(*) AS n FROM w0 GROUP BY 1),
w2 AS (SELECT region, first(shallow_mean) AS shallow_mean, first(mx) AS mx, first(my) AS my, first(n) AS n, sum(w * (draft - mx) * (melt - my)) FILTER (draft >= 25) / sum(w * pow(draft - mx, 2)) FILTER (draft >= 25) AS slope FROM w0 JOIN w1 USING (region) GROUP BY region)"""


@query("SELECT region, {r:25} AS threshold, {r:shallow_mean} AS shallow_mean, {r:slope} AS slope, {r:my - slope * mx} AS intercept, n FROM w2", digits=6, ctes=f"{BENT}, {_WEIGHTED}")
def r_piecewise_fit_weighted(t: Tables) -> DataFrame:
    return regress.piecewise_fit(t.bent.withColumn("w", F.col("l_linenumber").cast("double")), _at_25(t), "region", "draft", "melt", weight="w")


_CHOSEN = """c AS (
  SELECT region, var_pop(melt) * count(*) AS tot, sum(pow(melt - CASE WHEN draft < threshold THEN 0 ELSE slope * draft + intercept END, 2)) AS zero,
    sum(pow(melt - CASE WHEN draft < threshold THEN shallow_mean ELSE slope * draft + intercept END, 2)) AS mean,
    sum(pow(melt - CASE WHEN draft < threshold THEN slope * threshold + intercept ELSE slope * draft + intercept END, 2)) AS at_,
    first(threshold) AS threshold, first(shallow_mean) AS shallow_mean, first(slope) AS slope, first(intercept) AS intercept
  FROM bent JOIN fit USING (region) GROUP BY region),
chosen AS (SELECT *, 1 - least(zero, mean, at_) / tot AS r2, CASE WHEN zero <= mean AND zero <= at_ THEN 'zero' WHEN mean <= at_ THEN 'mean' ELSE 'threshold' END AS model FROM c)"""


@query("""SELECT region, {r:threshold} AS "minDraft", {r:CASE model WHEN 'zero' THEN 0 WHEN 'mean' THEN shallow_mean ELSE slope * threshold + intercept END} AS "constantValue", 0 AS "paramType",
  {r:intercept} AS alpha0, {r:slope} AS alpha1, model, {r:r2} AS r2 FROM chosen""", digits=6, ctes=f"{BENT}, {_FIT}, {_CHOSEN}")
def r_chosen_model(t: Tables) -> DataFrame:
    fits = regress.piecewise_fit(t.bent, _at_25(t), "region", "draft", "melt")
    return regress.chosen(t.bent, fits, "region", "draft", "melt")


@query("""SELECT region, selection, {r:CASE selection WHEN 'zero_shallow' THEN 0 WHEN 'mean_shallow' THEN shallow_mean ELSE slope * threshold + intercept END} AS "constantValue",
  {r:1 - CASE selection WHEN 'zero_shallow' THEN zero WHEN 'mean_shallow' THEN mean ELSE at_ END / tot} AS r2 FROM c, (VALUES ('zero_shallow'), ('mean_shallow'), ('threshold_intercept')) AS s(selection)""", digits=6, ctes=f"{BENT}, {_FIT}, {_CHOSEN}")
def r_selected_model(t: Tables) -> DataFrame:
    fits = kept(regress.piecewise_fit(t.bent, _at_25(t), "region", "draft", "melt").select("region", "threshold", "shallow_mean", "slope", "intercept"), "fits")
    parts = [regress.chosen(t.bent, fits, "region", "draft", "melt", x).select("region", F.lit(x).alias("selection"), "constantValue", "r2") for x in regress.MODELS]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT region, n, {r:correlation} AS correlation, {r:r2} AS r2, false AS is_meaningful, {r:0} AS "minDraft", {r:melt_mean} AS "constantValue", 1 AS "paramType", {r:0} AS alpha0, {r:0} AS alpha1 FROM gate""", ctes=f"{NOISE}, {_GATE.format('noise')}")
def r_fallback(t: Tables) -> DataFrame:
    gate = regress.quality(t.noise, "region", "draft", "melt")
    at = t.noise.select("region").distinct().withColumn("threshold", F.lit(25.0))
    params = regress.chosen(t.noise, regress.piecewise_fit(t.noise, at, "region", "draft", "melt"), "region", "draft", "melt")
    return regress.with_fallback(gate, params, "region", "mean")


@query()
def r_shelf_parameters(t: Tables) -> DataFrame:
    return regress.shelf_parameters(t.bent, "region", "draft", "melt")


# the whole chain over bends and noise, with one break by least squares
_CHAIN = f"""{_bins(50, "both_")},
curve AS (SELECT region, avg(draft) AS draft, avg(melt) AS y, row_number() OVER (PARTITION BY region ORDER BY bin) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM bins WHERE bin < 50 GROUP BY region, bin HAVING count(*) >= 5),
run AS (SELECT *, sum(y) OVER w AS s, sum(y * y) OVER w AS q, sum(y) OVER (PARTITION BY region) AS ss, sum(y * y) OVER (PARTITION BY region) AS qq FROM curve WINDOW w AS (PARTITION BY region ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT region, arg_max(i, (qq - ss * ss / n - (q - s * s / i) - (qq - q - (ss - s) * (ss - s) / (n - i)), i)) AS i FROM run WHERE i % 5 = 0 AND i >= 2 AND n - i >= 2 AND n >= 10 GROUP BY 1),
at_ AS (SELECT f.region, c.draft AS threshold FROM found f JOIN curve c ON c.region = f.region AND c.i = f.i - 1),
own AS (SELECT b.*, threshold FROM both_ b JOIN at_ USING (region)),
fit AS (SELECT region, first(threshold) AS threshold, CASE WHEN count(*) FILTER (draft < threshold) >= 5 THEN avg(melt) FILTER (draft < threshold) ELSE avg(melt) END AS shallow_mean,
  CASE WHEN count(*) FILTER (draft >= threshold) >= 5 THEN regr_slope(melt, draft) FILTER (draft >= threshold) ELSE regr_slope(melt, draft) END AS slope,
  CASE WHEN count(*) FILTER (draft >= threshold) >= 5 THEN regr_intercept(melt, draft) FILTER (draft >= threshold) ELSE regr_intercept(melt, draft) END AS intercept FROM own GROUP BY 1),
c AS (
  SELECT region, sum(pow(melt - CASE WHEN draft < f.threshold THEN 0 ELSE slope * draft + intercept END, 2)) AS zero, sum(pow(melt - CASE WHEN draft < f.threshold THEN shallow_mean ELSE slope * draft + intercept END, 2)) AS mean,
    sum(pow(melt - CASE WHEN draft < f.threshold THEN slope * f.threshold + intercept ELSE slope * draft + intercept END, 2)) AS at_, first(f.threshold) AS threshold, first(shallow_mean) AS shallow_mean, first(slope) AS slope, first(intercept) AS intercept
  FROM both_ JOIN fit f USING (region) GROUP BY region),
picked AS (SELECT *, CASE WHEN zero <= mean AND zero <= at_ THEN 0 WHEN mean <= at_ THEN shallow_mean ELSE slope * threshold + intercept END AS constant FROM c),
gated AS (SELECT *, n >= 20 AND abs(correlation) >= 0.3 AND r2 >= 0.1 AS ok FROM gate)"""


@query("""SELECT region, n, {r:correlation} AS correlation, {r:r2} AS r2, ok AS is_meaningful, {r:CASE WHEN ok THEN threshold ELSE 0 END} AS "minDraft", {r:CASE WHEN ok THEN constant ELSE melt_mean END} AS "constantValue",
  CASE WHEN ok THEN 0 ELSE 1 END AS "paramType", {r:CASE WHEN ok THEN intercept ELSE 0 END} AS alpha0, {r:CASE WHEN ok THEN slope ELSE 0 END} AS alpha1 FROM gated LEFT JOIN picked USING (region)""", digits=6,
       ctes=f"{BENT}, {NOISE}, both_ AS (SELECT 'b' || region AS region, draft, melt FROM bent UNION ALL SELECT 'n' || region, draft, melt FROM noise), {_GATE.format('both_')}, {_CHAIN}")
def r_shelf_parameters_one_break(t: Tables) -> DataFrame:
    return regress.shelf_parameters(_both(t), "region", "draft", "melt", method="binseg", noisy="mean")


# a bend, noise, and freezing, as regions of their own
_MIXED = """mixed AS (
  SELECT 'b' || region AS region, draft, melt FROM bent UNION ALL SELECT 'n' || region, draft, melt FROM noise UNION ALL SELECT 'f' || region, draft, -melt FROM noise WHERE draft < 30
  UNION ALL SELECT 'd' || l_discount, l_quantity, l_extendedprice / 1000 * (1 - l_discount) + CASE WHEN l_linenumber % 2 = 0 THEN 400 ELSE 0 END FROM lineitem UNION ALL SELECT 'few', o_custkey % 30, 1 + o_custkey % 3 FROM orders WHERE o_orderkey <= 40)"""
_MIXED_GATE = """m AS (
  SELECT region, count(*) AS n, max(draft) - min(draft) AS draft_range, avg(melt) AS melt_mean, var_pop(melt) AS var, coalesce(corr(draft, melt), 0) AS correlation, coalesce(regr_r2(melt, draft), 0) AS r2 FROM mixed GROUP BY 1),
e AS (SELECT *, var * (1 - r2) AS mse, sqrt(var * (1 - r2)) AS rmse, CASE WHEN var > 0 THEN 1 - r2 ELSE 'infinity'::DOUBLE END AS nmse, CASE WHEN melt_mean > 0 THEN sqrt(var * (1 - r2)) / melt_mean ELSE 'infinity'::DOUBLE END AS relative_rmse,
  CASE WHEN region IN ('bA', 'nN', 'fR') THEN {relax} ELSE 1 END AS ease FROM m)"""


def _mixed(t: Tables) -> DataFrame:
    own = lambda df, mark, melt="melt": df.select(F.concat(F.lit(mark), "region").alias("region"), "draft", F.expr(melt).alias("melt"))
    by_discount = t.lineitem.select(F.concat(F.lit("d"), F.col("l_discount").cast("string")).alias("region"), F.col("l_quantity").alias("draft"), (F.col("l_extendedprice") / 1000 * (1 - F.col("l_discount")) + F.when(F.col("l_linenumber") % 2 == 0, 400).otherwise(0)).alias("melt"))
    few = t.orders.filter("o_orderkey <= 40").select(F.lit("few").alias("region"), (F.col("o_custkey") % 30).cast("double").alias("draft"), (1 + F.col("o_custkey") % 3).cast("double").alias("melt"))
    return reduce(DataFrame.unionByName, [own(t.bent, "b"), own(t.noise, "n"), own(t.noise.filter("draft < 30"), "f", "-melt"), by_discount, few])


# logic, checks that count (in SQL), limit of the score, relaxing factor; written out for each rule below
_LOGICS = {
    "hybrid": ("(abs(correlation) >= 0.3 * ease OR r2 >= 0.25 * ease) AND (nmse <= 0.7 / ease OR relative_rmse <= 0.5 / ease)", "{passed} / 5.0"),
    "strict_and": ("{passed} = 5", "{passed} / 5.0"),
    "relaxed_or": ("{passed} > 0", "{passed} / 5.0"),
    "weighted": ("{score} >= 0.6", "{score}"),
}
_PASSED = "((abs(correlation) >= 0.3 * ease)::INT + (r2 >= 0.25 * ease)::INT + (mse <= 20)::INT + (nmse <= 0.7 / ease)::INT + (relative_rmse <= 0.5 / ease)::INT)"
_SCORE = "(0.25 * abs(correlation) + 0.35 * r2 + 0.25 * greatest(1 - nmse, 0) + 0.15 * least(1, n / 50.0 * draft_range / 25))"


def _assess_sql() -> str:
    rows = []
    for logic, (good, confidence) in _LOGICS.items():
        good, confidence = (x.replace("{passed}", _PASSED).replace("{score}", _SCORE) for x in (good, confidence))
        rows.append(f"""SELECT region, '{logic}' AS logic, n, {{r:mse}} AS mse, {{r:CASE WHEN isinf(relative_rmse) THEN -1 ELSE relative_rmse END}} AS relative_rmse, enough AND good AS is_meaningful, {{r:CASE WHEN enough THEN confidence ELSE 0 END}} AS confidence,
  CASE WHEN NOT enough THEN 'insufficient_data' WHEN NOT good AND melt_mean < 0.5 THEN 'poor_low_melt' WHEN NOT good THEN 'poor_significant_melt' WHEN confidence >= 0.8 THEN 'excellent' WHEN confidence >= 0.6 THEN 'good' ELSE 'moderate' END AS category
FROM (SELECT *, n >= 50 AND draft_range >= 25 AS enough, {good} AS good, {confidence} AS confidence FROM e)""")
    return " UNION ALL ".join(rows)


_MIX = f"{BENT}, {NOISE}, {_MIXED}"


@query(_assess_sql(), ctes=f"{_MIX}, {_MIXED_GATE.format(relax=0.7)}")
def r_assess(t: Tables) -> DataFrame:
    rule = regress.Assessment(use_correlation=True, use_mse=True, min_corr=0.3, min_r2=0.25, max_mse=20.0, priority=("bA", "nN", "fR"))
    parts = [regress.assess(_mixed(t), "region", "draft", "melt", replace(rule, logic=x)).withColumn("logic", F.lit(x)) for x in _LOGICS]
    own = reduce(DataFrame.unionByName, parts)
    ratio = F.when(F.col("relative_rmse") == float("inf"), -1.0).otherwise(F.col("relative_rmse"))
    return own.select("region", "logic", "n", "mse", ratio.alias("relative_rmse"), "is_meaningful", "confidence", "category")


@query("""SELECT region, logic, n, enough AND good AS is_meaningful, {r:CASE WHEN enough THEN confidence ELSE 0 END} AS confidence, 0 AS n_errors FROM (
  SELECT *, n >= 50 AND draft_range >= 25 AS enough, abs(correlation) >= 0.3 AS good, (abs(correlation) >= 0.3)::INT::DOUBLE AS confidence FROM e, (VALUES ('hybrid'), ('strict_and'), ('relaxed_or')) AS l(logic)
  UNION ALL SELECT * EXCLUDE (score), n >= 50 AND draft_range >= 25, score >= 0.6, score FROM (SELECT e.*, 'weighted' AS logic, (0.25 * abs(correlation) + 0.15 * least(1, n / 50.0 * draft_range / 25)) / 0.4 AS score FROM e))""",
       ctes=f"{_MIX}, {_MIXED_GATE.format(relax=1)}")
def r_assess_errors_without_r2(t: Tables) -> DataFrame:
    """Errors belong to the fit of R2; without it a rule has none, whatever it says of them."""
    rule = regress.Assessment(use_correlation=True, use_r2=False, use_mse=True, min_corr=0.3, max_mse=0.0)
    parts = [regress.assess(_mixed(t), "region", "draft", "melt", replace(rule, logic=x)).withColumn("logic", F.lit(x)) for x in _LOGICS]
    own = reduce(DataFrame.unionByName, parts)
    return own.select("region", "logic", "n", "is_meaningful", "confidence", (F.col("mse").isNotNull() | F.col("nmse").isNotNull()).cast("int").alias("n_errors"))


@query("""SELECT region, preset, is_meaningful FROM (
  SELECT region, 'conservative' AS preset, enough AND r2 >= 0.4 AS is_meaningful FROM g UNION ALL SELECT region, 'balanced', enough AND r2 >= 0.05 FROM g UNION ALL SELECT region, 'permissive', enough AND r2 >= 0.2 FROM g
  UNION ALL SELECT region, 'correlation_focus', false FROM g UNION ALL SELECT region, 'prediction_focus', enough AND r2 >= 0.35 FROM g UNION ALL SELECT region, 'simple', enough AND r2 >= 0.05 FROM g)""",
       ctes=f"{_MIX}, {_MIXED_GATE.format(relax=1)}, g AS (SELECT *, n >= 50 AND draft_range >= 25 AS enough FROM e)")
def r_assess_presets(t: Tables) -> DataFrame:
    parts = [regress.assess(_mixed(t), "region", "draft", "melt", x).select("region", F.lit(x).alias("preset"), "is_meaningful") for x in regress.PRESETS]
    return reduce(DataFrame.unionByName, parts)


_CLASS = """class AS (SELECT *, CASE WHEN n < 20 THEN 'insufficient_data' WHEN draft_range < 29 THEN 'insufficient_range' WHEN abs(correlation) >= 0.3 AND r2 >= 0.3 THEN 'meaningful'
  WHEN melt_mean < 1 THEN 'noisy_low_melt' ELSE 'noisy_significant_melt' END AS category FROM gate)"""
_MIX_CLASS = f"{_MIX}, {_GATE.format('mixed')}, {_CLASS}"


def _classes(t: Tables) -> DataFrame:
    return regress.classify(regress.quality(_mixed(t), "region", "draft", "melt"), 20, 29.0, 0.3, 0.3, 1.0)


def _both(t: Tables) -> DataFrame:
    return t.bent.select(F.concat(F.lit("b"), "region").alias("region"), "draft", "melt").unionByName(t.noise.select(F.concat(F.lit("n"), "region").alias("region"), "draft", "melt"))


@query("SELECT region, n, {r:r2} AS r2, category FROM class", ctes=_MIX_CLASS)
def r_classify(t: Tables) -> DataFrame:
    return _classes(t).select("region", "n", "r2", "category")


@query("""f AS (SELECT region, CASE WHEN count(*) FILTER (draft >= 25) >= 5 THEN regr_slope(melt, draft) FILTER (draft >= 25) ELSE regr_slope(melt, draft) END AS s,
  CASE WHEN count(*) FILTER (draft >= 25) >= 5 THEN regr_intercept(melt, draft) FILTER (draft >= 25) ELSE regr_intercept(melt, draft) END AS i FROM mixed WHERE region <> 'dd' GROUP BY 1),
k AS (SELECT region, melt_mean, CASE category WHEN 'noisy_low_melt' THEN 'constant_zero' WHEN 'noisy_significant_melt' THEN 'constant_mean' ELSE 'piecewise_linear' END AS kind, s, i FROM class LEFT JOIN f USING (region))
SELECT region, CASE WHEN kind = 'piecewise_linear' AND s IS NULL THEN 'fallback_mean' ELSE kind END AS model_type, {r:CASE WHEN kind = 'piecewise_linear' THEN coalesce(s, 0) ELSE 0 END} AS slope,
  {r:CASE kind WHEN 'constant_zero' THEN 0 WHEN 'constant_mean' THEN greatest(melt_mean, 0) ELSE CASE WHEN s IS NULL THEN greatest(melt_mean, 0) ELSE greatest(i, 0) END END} AS intercept,
  kind = 'piecewise_linear' AND coalesce(abs(s) > 0.1, false) AS is_steep FROM k""", digits=6, ctes=_MIX_CLASS)
def r_strategy_fit(t: Tables) -> DataFrame:
    own = _mixed(t)
    at = own.select("region").distinct().withColumn("threshold", F.lit(25.0))
    return regress.strategy_fit(_classes(t), regress.piecewise_fit(own, at, "region", "draft", "melt"), "region", nonnegative=True).drop("threshold")


_TIERS = """tiers AS (SELECT region, regr_slope(melt, draft) AS slope, regr_intercept(melt, draft) AS intercept, regr_r2(melt, draft) AS r2, corr(draft, melt) AS correlation, count(*) AS n,
  avg(draft) AS draft_mean, stddev_pop(draft) AS draft_std, avg(melt) AS melt_mean, stddev_pop(melt) AS melt_std FROM mixed WHERE draft > 0 AND melt >= 0 GROUP BY 1 HAVING count(*) >= 100),
tiered AS (SELECT *, melt_std * sqrt(1 - r2) AS rmse, r2 >= 0.1 AND abs(correlation) >= 0.2 AS is_meaningful, CASE WHEN r2 >= 0.3 AND n >= 500 THEN 'high' WHEN r2 >= 0.15 AND n >= 200 THEN 'medium' ELSE 'low' END AS tier FROM tiers)"""


@query("SELECT region, {r:slope} AS slope, {r:intercept} AS intercept, {r:r2} AS r2, {r:correlation} AS correlation, n, {r:draft_mean} AS draft_mean, {r:draft_std} AS draft_std, {r:melt_mean} AS melt_mean, {r:melt_std} AS melt_std, {r:rmse} AS rmse, is_meaningful, tier FROM tiered", ctes=f"{_MIX}, {_TIERS}")
def r_tiers(t: Tables) -> DataFrame:
    return regress.tiers(_mixed(t), "region", "draft", "melt")


@query("SELECT region, {r:r2} AS r2 FROM tiered WHERE tier = 'high' ORDER BY r2 DESC, region LIMIT 2", ctes=f"{_MIX}, {_TIERS}")
def o_best_regions(t: Tables) -> DataFrame:
    return regress.best_of(regress.tiers(_mixed(t), "region", "draft", "melt"), 2).select("region", "r2")


@query("""e AS (SELECT region, melt AS o, CASE WHEN draft < threshold THEN shallow_mean ELSE slope * draft + intercept END - melt AS err FROM bent JOIN fit USING (region))
SELECT region, count(*) AS n, {r:1 - sum(err * err) / (var_pop(o) * count(*))} AS r2, {r:sqrt(avg(err * err))} AS rmse, {r:avg(abs(err))} AS mae, {r:avg(err)} AS bias, {r:corr(o, o + err)} AS correlation FROM e GROUP BY 1""", digits=6, ctes=f"{BENT}, {_FIT}")
def r_skill(t: Tables) -> DataFrame:
    fits = kept(regress.piecewise_fit(t.bent, _at_25(t), "region", "draft", "melt").drop("n"), "fits")
    own = t.bent.join(fits, "region").withColumn("predicted", scalars.piecewise("draft", "threshold", "slope", "intercept", "shallow_mean"))
    return regress.skill(own, "region", "melt", "predicted")


@query("SELECT category, count(*) AS n, {r:count(*) / sum(count(*)) OVER ()} AS share FROM class GROUP BY 1", ctes=_MIX_CLASS)
def r_category_counts(t: Tables) -> DataFrame:
    return regress.counts_by(_classes(t), "category")


def _sets(t: Tables) -> DataFrame:
    rows = [("1_conservative", 0.10, 0.20, 1.0, 50, 5), ("2_moderate", 0.05, 0.15, 1.0, 40, 5), ("3_permissive", 0.03, 0.10, 0.8, 30, 3)]
    return t.spark.createDataFrame(rows, "set_name string, min_r2 double, min_corr double, penalty double, n_bins int, min_points int")


@query()
def j_parameter_sweep(t: Tables) -> DataFrame:
    return regress.sweep(_both(t), _sets(t), "region", "draft", "melt")


@query()
def r_compare_sets(t: Tables) -> DataFrame:
    return regress.compare_sets(regress.sweep(_both(t), _sets(t), "region", "draft", "melt"))


_CELL_GATE = "cg AS (SELECT cell, count(*) AS n, corr(draft, v) AS correlation, regr_r2(v, draft) AS r2 FROM cube GROUP BY 1)"


def _cell_gate(t: Tables) -> DataFrame:
    return regress.quality(t.cube, "cell", "draft", "v", 0.03, 0.1)


@query("""SELECT {r:a / 100.0 + 0.0} AS min_r2, {r:b / 50.0} AS min_corr, {r:avg((coalesce(r2, 9) >= a / 100.0 AND abs(coalesce(correlation, 9)) >= b / 50.0)::INT) * 100} AS pct
FROM cg, (SELECT unnest(range(1, 30)) AS a), (SELECT unnest(range(1, 24)) AS b) GROUP BY a, b""", ctes=f"{CUBE}, {_CELL_GATE}")
def j_threshold_sensitivity(t: Tables) -> DataFrame:
    return regress.sensitivity(_cell_gate(t), [a / 100.0 for a in range(1, 30)], [b / 50.0 for b in range(1, 24)])


@query("SELECT cell, {r:r2} AS r2 FROM cg WHERE r2 >= 0.01 AND r2 < 0.02 OR abs(correlation) >= 0.02 AND abs(correlation) < 0.04", digits=6, ctes=f"{CUBE}, {_CELL_GATE}")
def p_borderline(t: Tables) -> DataFrame:
    return regress.borderline(_cell_gate(t), r2=0.01, correlation=0.02).select("cell", "r2")


@query("""SELECT 'r2' AS metric, count(*) FILTER (r2 < 0.01) AS n_failing, count(*) FILTER (r2 >= 0.01 AND r2 < 0.02) AS n_borderline FROM cg
UNION ALL SELECT 'correlation', count(*) FILTER (abs(correlation) < 0.02), count(*) FILTER (abs(correlation) >= 0.02 AND abs(correlation) < 0.04) FROM cg""", ctes=f"{CUBE}, {_CELL_GATE}")
def p_failing_counts(t: Tables) -> DataFrame:
    return regress.failing_counts(_cell_gate(t), r2=0.01, correlation=0.02)


@query("SELECT cell, {r:r2} AS r2, {r:correlation} AS correlation FROM cg WHERE r2 < 0.01 ORDER BY cell LIMIT 10", digits=6, ctes=f"{CUBE}, {_CELL_GATE}")
def o_first_failing(t: Tables) -> DataFrame:
    return stats.top(regress.failing(_cell_gate(t), "r2", 0.01), [F.col("cell")], 10).select("cell", "r2", "correlation")


@query("""SELECT cell, {r:r2} AS r2, {r:correlation} AS correlation FROM cg WHERE NOT (r2 >= 0.3 AND abs(correlation) >= 0.1) ORDER BY r2 DESC NULLS LAST, correlation DESC NULLS LAST
LIMIT (SELECT greatest(0, floor((40.0 - 100.0 * count(*) FILTER (r2 >= 0.3 AND abs(correlation) >= 0.1) / count(*)) / 100.0 * count(*)))::BIGINT FROM cg)""", digits=6, ctes=f"{CUBE}, {_CELL_GATE}")
def o_regions_to_convert(t: Tables) -> DataFrame:
    gate = regress.quality(t.cube, "cell", "draft", "v", 0.3, 0.1)
    return regress.to_convert(gate, 40.0).select("cell", "r2", "correlation")


@query("""k AS (SELECT r2, correlation FROM cg WHERE NOT (r2 >= 0.3 AND abs(correlation) >= 0.1) ORDER BY r2 DESC NULLS LAST, correlation DESC NULLS LAST
LIMIT (SELECT greatest(0, floor((40.0 - 100.0 * count(*) FILTER (r2 >= 0.3 AND abs(correlation) >= 0.1) / count(*)) / 100.0 * count(*)))::BIGINT FROM cg))
SELECT count(*) AS n, {r:coalesce(min(r2), 0)} AS min_r2, {r:coalesce(min(abs(correlation)), 0)} AS min_corr FROM k""", digits=6, ctes=f"{CUBE}, {_CELL_GATE}")
def o_limits_to_convert(t: Tables) -> DataFrame:
    return regress.limits_to_convert(regress.quality(t.cube, "cell", "draft", "v", 0.3, 0.1), 40.0)


@query("""q AS (SELECT region, quantile_cont(draft, 0.01) AS lo, quantile_cont(draft, 0.99) AS hi FROM points GROUP BY 1)
SELECT region, count(*) AS n, {r:avg(melt)} AS melt FROM points JOIN q USING (region) WHERE draft BETWEEN lo AND hi GROUP BY 1""", ctes=POINTS)
def p_clip_quantiles(t: Tables) -> DataFrame:
    return regress.clip_quantiles(t.points, "region", "draft").groupBy("region").agg(F.count("*").alias("n"), F.avg("melt").alias("melt"))


@query("SELECT region, count(*) AS n FROM gaps WHERE draft > 0 AND melt >= 0 GROUP BY 1", ctes=f"{POINTS}, {_GAPS}")
def p_valid_points(t: Tables) -> DataFrame:
    return regress.valid_points(_gaps(t), "draft", "melt").groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT region, count(DISTINCT cell) AS n FROM cube JOIN cell_region USING (cell) GROUP BY 1", ctes=f"{CUBE}, {CELL_REGION}")
def a_cells_of_regions(t: Tables) -> DataFrame:
    return stats.time_mean(t.cube, "cell", "v").join(t.cell_region, "cell").groupBy("region").agg(F.count("*").alias("n"))
