"""That what a task holds does not grow with a region, and work not with the square of the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import regress


@pytest.fixture()
def points(spark):
    """Three regions of 100,000 points, beyond what may be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    draft = F.col("id") * 7919 % 10007 / 100.0
    yield spark.range(300_000).select((F.col("id") % 3).alias("region"), draft.alias("draft"), (F.greatest(draft - 30, F.lit(0.0)) + F.col("id") % 7).alias("melt"), (1.0 + F.col("id") % 2).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


_OWN = ("region", "draft", "melt")
_AT = lambda p: p.select("region").distinct().withColumn("threshold", F.lit(30.0))
JOBS = {
    "moments": lambda p: regress.with_moments(p, "region", "draft"),
    "clip": lambda p: regress.clip_quantiles(p, "region", "draft"),
    "regression": lambda p: regress.draft_regression(p, *_OWN, weight="w"),
    "fit": lambda p: regress.with_fit(p, regress.draft_regression(p, *_OWN), "region", "draft"),
    "bins": lambda p: regress.binned(p, *_OWN),
    "dynamic": lambda p: regress.with_dynamic_threshold(p, *_OWN),
    "piecewise": lambda p: regress.piecewise_fit(p, _AT(p), *_OWN),
    "weighted": lambda p: regress.piecewise_fit(p, _AT(p), *_OWN, weight="w"),
    "chosen": lambda p: regress.chosen(p, regress.piecewise_fit(p, _AT(p), *_OWN), *_OWN),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_points_are_not_dealt_by_region(points, name):
    plan = JOBS[name](points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_moments_are_those_of_the_key_and_of_rows_without_one(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 6.0), (None, 7.0), (None, 9.0), ("a", None)]
    own = regress.with_moments(spark.createDataFrame(rows, "k string, x double"), "k", "x")
    got = {(r.k, r.x): (r.x_mean, r.x_std, r.g) for r in own.withColumn("g", scalars.gaussian_weight_of("x")).collect()}
    assert got[("a", 1.0)][:2] == got[("a", None)][:2] == (2.0, 1.0) and got[("b", 5.0)][:2] == (5.5, 0.5) and got[(None, 7.0)][:2] == (8.0, 1.0)
    assert np.isclose(got[("a", 1.0)][2], np.exp(-0.5)) and got[("a", None)][2] is None


@pytest.mark.parametrize("many_targets", [True, False])
def test_nearest_meets_few_sources_whatever_the_size(spark, many_targets, monkeypatch):
    """A first bucket that holds all sources of a cluster; places that repeat; ties. As brute force, with short lists."""
    from gridloom.operators import fill

    rng = np.random.default_rng(5)
    src = np.vstack([rng.random((1500, 2)), np.floor(rng.random((100, 2)) * 6) + [20, 0], np.floor(rng.random((100, 2)) * 6) + [20, 0]])
    goal = np.vstack([rng.random((200, 2)) * 2 - 0.5, np.floor(rng.random((80, 2)) * 12) / 2 + [20, 0], [(500.0, -70.0)]])
    goal = np.vstack([goal] * (8 if many_targets else 1))
    sources = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(src)], "sid int, x double, y double")
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(goal)], "tid int, x double, y double")
    lists, sides, listed = [], [], fill._listed
    monkeypatch.setattr(fill, "_listed", lambda s, by: lists.append(out := listed(s, by)) or out)
    near = fill._near
    monkeypatch.setattr(fill, "_near", lambda *a: sides.append(a[-1]) or near(*a))
    monkeypatch.setattr(fill, "forgotten", lambda *_: None)
    got = {r.tid: (r.sid, r.dist) for r in fill.nearest(targets, sources, "tid", "x", "y", "sid", 10.0).collect()}
    for i, (x, y) in enumerate(goal):
        d2 = (src[:, 0] - x) * (src[:, 0] - x) + (src[:, 1] - y) * (src[:, 1] - y)
        k = min(range(len(src)), key=lambda j: (d2[j], src[j, 1], src[j, 0], j))
        assert got[i] == (k, pytest.approx(np.sqrt(d2[k])))
    assert sides[0] < 0.2 and max(a.agg(F.max(F.size("__near"))).first()[0] for a in lists) < 200


@pytest.mark.parametrize("seed", [1, 2])
def test_points_meet_few_triangles_whatever_the_size(spark, seed):
    """Triangles of very unlike sizes, in buckets far wider than most of them: as brute force. A triangle takes
    four buckets at most, a point one of each width."""
    from gridloom.operators import regrid

    rng = np.random.default_rng(seed)
    mid = np.vstack([rng.random((1500, 2)), rng.random((100, 2)) * 40 - 20])
    reach = np.concatenate([np.full(1500, 0.02), np.full(95, 1.5), np.full(5, 30.0)])
    corner = mid[:, None, :] + (rng.random((len(mid), 3, 2)) - 0.5) * reach[:, None, None]
    rows = [tuple(v for k in range(3) for v in (3 * i + k, float(corner[i, k, 0]), float(corner[i, k, 1]))) for i in range(len(mid))]
    tri = spark.createDataFrame(rows, "a long, ax double, ay double, b long, bx double, by double, c long, cx double, cy double")
    flat = corner.reshape(-1, 2)
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(flat)], "node long, x double, y double")
    goal = np.vstack([rng.random((150, 2)), rng.random((100, 2)) * 60 - 30, flat[:20]])
    goal = np.vstack([goal, goal[:50]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(goal)], "dst long, x double, y double")
    got = {}
    for r in regrid.mesh_weights(points, tri, nodes, "dst", "node", "x", "y", 5.0).collect():
        got.setdefault(r.dst, {})[r.src] = r.w
    for i, (x, y) in enumerate(goal):
        inside = []
        for k, (a, b, c) in enumerate(corner):
            w = np.linalg.solve(np.array([[a[0], b[0], c[0]], [a[1], b[1], c[1]], [1, 1, 1]]), [x, y, 1])
            if (w > -1e-9).all():
                inside.append((k, w))
        if inside:
            k, w = inside[0]
            assert got[i] == pytest.approx({3 * k + j: w[j] for j in range(3)}, abs=1e-6)
        else:
            d2 = ((flat - [x, y]) ** 2).sum(axis=1)
            assert got[i] == {int(np.argmin(d2)): 1.0}
    places = points.select(F.col("x").alias("px"), F.col("y").alias("py"))
    assert regrid._meetings(places, tri, 5.0).count() < len(goal) * 40  # of 1,600 each


def test_components_read_their_cube_once(spark):
    """The cube is summed up from far more rows than it has; the flat series are written, and all else reads these."""
    from gridloom.plans import pipelines

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = [(c, t, float(c + t % 12), float(c % 5)) for c in range(20) for t in range(36) if (c, t) not in ((3, 4), (7, 8))]
    cube = spark.createDataFrame(rows, "cell long, t int, v double, draft double").mapInPandas(counted, "cell long, t int, v double, draft double")
    bridge = spark.range(20).select(F.col("id").alias("cell"), (F.col("id") % 2).alias("region_id"))
    grid = spark.range(20).select(F.col("id").alias("cell"), (F.col("id") % 5).cast("int").alias("ix"), F.floor(F.col("id") / 5).cast("int").alias("iy"))
    season, vary = pipelines.components(cube, bridge, grid, "cell", "t", "v", "draft", 0, 35)
    a, b = ({(r.cell, r.t): r.value for r in df.collect()} for df in (season, vary))
    assert len(a) == len(b) == 20 * 36 and a[(3, 4)] is not None and b[(7, 8)] is not None
    assert reads.value == len(rows)


@pytest.mark.parametrize("side", [1, 3, 12])
def test_a_circle_is_held_against_the_tiles_of_its_box_only(side):
    """As all tiles do, one by one; tiles without width too."""
    from gridloom.operators import mesh

    rng = np.random.default_rng(side)
    strips, cells = np.sort(rng.random(side + 1)) * 10, np.sort(rng.random((side, side + 1)), axis=1) * 7
    if side == 3:
        strips[1], cells[0, 1] = strips[2], cells[0, 2]
    tiling = mesh.Tiling(strips, cells)
    x0, x1, y0, y1 = tiling.boxes()
    for _ in range(300):
        p = np.tile(rng.random(2) * 12 - 1, 3) + rng.random(6) * 0.3
        mx, my, r = (float(v) for v in mesh._circle(*p))
        dx, dy = np.maximum(np.maximum(x0 - mx, mx - x1), 0), np.maximum(np.maximum(y0 - my, my - y1), 0)
        assert sorted(tiling.reached(1, *p)) == np.flatnonzero(np.hypot(dx, dy) <= r).tolist()
    x, y = np.sort(rng.random(500) * 12 - 1), rng.random(500) * 9 - 1
    want = set()
    for k in range(side * side):
        a, b, c, d = tiling.box(k, 0.35)
        want |= {(int(i), k) for i in np.flatnonzero((x >= a) & (x <= b) & (y >= c) & (y <= d))}
    assert set(zip(*(v.tolist() for v in tiling.near(x, y, 0.35)))) == want
