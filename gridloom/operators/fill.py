"""Nearest neighbours on grids: filling gaps inside regions, regridding, distances.

Neighbours are found by buckets: points fall into square cells, and a target meets the points of its own bucket and of the
ring around it. Targets that the ring does not settle (no point, or the nearest may lie outside) look into rings twice as
wide, and then go down a pyramid of occupied squares, which opens only squares that may hold the nearest point. So a target
is compared with near points only, however many there are and however far from all of them it lies.

A bucket's sources are one row, a list, and buckets are made so small that these lists stay short (``_side``). So a target
meets a few rows, not one for each source near it. Targets at one place are looked up once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forgotten, stored
from .timeseries import Key, keys


#: Rounds of buckets, the second twice as wide; squares to a side that one square of the next level has; sources that a bucket
#: should have (as a source sees it) and may have.
ROUNDS, FAN, FEW, MOST = 2, 8, 4, 512


def _bucketed(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return df.withColumns({"__bx": F.floor(F.col(x) / side), "__by": F.floor(F.col(y) / side)})


def _around(df: DataFrame) -> DataFrame:
    """Every row in its own bucket and in the eight around it."""
    for c in ("__bx", "__by"):
        df = df.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return df


def _side(src: DataFrame, by: list[str], side: float) -> float:
    """``side``, halved until buckets have few sources. src: places that differ, so this ends; at the latest where buckets
    are as small as rounding."""
    ends = src.agg(*(F.max(F.abs(F.col(c))).cast("double").alias(c) for c in ("__sx", "__sy"))).first()
    least = max(1e-12 * max(ends.asDict().values()), 1e-300)
    while side > least:
        n = F.col("n").cast("double")
        seen = _bucketed(src, "__sx", "__sy", side).groupBy(*by, "__bx", "__by").agg(F.count("*").alias("n")).agg((F.sum(n * n) / F.sum(n)).alias("usual"), F.max("n").alias("most")).first()
        if seen.usual <= FEW and seen.most <= MOST:
            break
        side /= 2 ** max(1, math.floor(math.log2(seen.usual / FEW) / 2))
    return side


def _listed(src: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, __near): a row a bucket with all its sources."""
    return src.groupBy(*by, "__bx", "__by").agg(F.collect_list(F.struct("__sy", "__sx", "__id")).alias("__near"))


def _order(x: str, y: str, sx: Column, sy: Column, id_: Column) -> Column:
    d2 = (sx - F.col(x)) * (sx - F.col(x)) + (sy - F.col(y)) * (sy - F.col(y))
    return F.struct(d2.alias("d2"), sy.alias("__sy"), sx.alias("__sx"), id_.alias("__id"))


def _of_list(x: str, y: str) -> Column:
    """The best of a row's list of sources."""
    return F.array_min(F.transform("__near", lambda s: _order(x, y, s["__sx"], s["__sy"], s["__id"]))).alias("__b")


def _best(x: str, y: str) -> Column:
    """The best source of many rows; each is the best of a list already."""
    return F.min(_order(x, y, F.col("__sx"), F.col("__sy"), F.col("__id"))).alias("__b")


def _near(left: DataFrame, src: DataFrame, own: list[str], by: list[str], x: str, y: str, side: float) -> DataFrame:
    """(own, __b): the best source in a target's bucket and the ring around it, if it lies no farther than a bucket's side. Of
    targets and sources the fewer go into all nine buckets."""
    targets, sources = _bucketed(left, x, y, side), _bucketed(src, "__sx", "__sy", side)
    if src.count() <= left.count():
        listed = stored(_listed(_around(sources), by), "buckets")
        best = targets.join(listed, [*by, "__bx", "__by"]).select(*own, _of_list(x, y)).filter(F.col("__b.d2") <= side * side)
    else:
        listed = stored(_listed(sources, by), "buckets")
        met = _around(targets).join(listed, [*by, "__bx", "__by"]).select(*own, _of_list(x, y)).filter(F.col("__b.d2") <= side * side)
        best = met.select(*own, "__b.*").groupBy(*own).agg(_best(x, y))
    found = stored(best, "nearest")
    forgotten(listed)
    return found


def _far(left: DataFrame, src: DataFrame, own: list[str], by: list[str], x: str, y: str, side: float) -> DataFrame:
    """(own, __b): the best source of targets far from all of them, by a pyramid of occupied squares. Each square knows the box of
    its sources, so a target's distance to it has a lower and an upper bound; from the top down a target opens the squares
    whose lower bound is not above its least upper bound, and at the bottom it meets the sources of the few that are left. A
    square's children are one row, so a target meets a row for each square that it opens."""
    box = ("x0", "x1", "y0", "y1")
    bounds = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    at = src.withColumns({"x0": F.col("__sx"), "x1": F.col("__sx"), "y0": F.col("__sy"), "y1": F.col("__sy")})
    levels = [stored(_bucketed(at, "__sx", "__sy", side).groupBy(*by, "__bx", "__by").agg(*bounds), "pyramid")]
    up = lambda c: F.floor(F.col(c) / FAN)
    while levels[-1].groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > FAN * FAN:
        levels.append(stored(levels[-1].groupBy(*by, up("__bx").alias("__bx"), up("__by").alias("__by")).agg(*bounds), "pyramid"))
    gap = lambda v, lo, hi: F.greatest(lo - F.col(v), F.col(v) - hi, F.lit(0.0))
    end = lambda v, lo, hi: F.greatest(F.abs(F.col(v) - lo), F.abs(F.col(v) - hi))
    least = lambda q: F.hypot(gap(x, q["x0"], q["x1"]), gap(y, q["y0"], q["y1"])) * (1 - 1e-12)
    most = lambda q: F.hypot(end(x, q["x0"], q["x1"]), end(y, q["y0"], q["y1"])) * (1 + 1e-12)
    open_, used = None, []
    for k in range(len(levels) - 1, -1, -1):
        squares = F.collect_list(F.struct("__bx", "__by", *box)).alias("__q")  # at most FAN * FAN
        if open_ is None:
            told = levels[k].groupBy(*by).agg(squares)
            met = (left.join(told, by) if by else left.crossJoin(F.broadcast(told))).withColumn("__most", F.lit(float("inf")))
        else:
            told = stored(levels[k].withColumns({"__px": up("__bx"), "__py": up("__by")}).groupBy(*by, "__px", "__py").agg(squares), "pyramid")
            used.append(told)
            met = open_.withColumnsRenamed({"__bx": "__px", "__by": "__py"}).join(told, [*by, "__px", "__py"])
        met = met.withColumn("__most", F.least("__most", F.array_min(F.transform("__q", most))))
        met = met.withColumn("__s", F.filter(F.transform("__q", lambda q: F.struct(q["__bx"].alias("__bx"), q["__by"].alias("__by"), least(q).alias("__least"))), lambda q: q["__least"] <= F.col("__most")))
        met = met.select(*own, "__most", "__s")
        if open_ is not None:
            met = met.groupBy(*own).agg(F.min("__most").alias("__most"), F.flatten(F.collect_list("__s")).alias("__s"))
            used.append(open_)
        met = met.select(*own, "__most", F.explode(F.filter("__s", lambda q: q["__least"] <= F.col("__most"))).alias("__q"))
        open_ = stored(met.select(*own, "__most", "__q.__bx", "__q.__by"), "pyramid-open")
    listed = stored(_listed(_bucketed(src, "__sx", "__sy", side), by), "pyramid")
    met = open_.join(listed, [*by, "__bx", "__by"]).select(*own, _of_list(x, y))
    found = stored(met.select(*own, "__b.*").groupBy(*own).agg(_best(x, y)), "nearest")
    forgotten(*levels, *used, open_, listed)
    return found


def _searched(left: DataFrame, src: DataFrame, own: list[str], by: list[str], x: str, y: str, side: float) -> DataFrame:
    """(own, __b): the best source of every target. left and src are stored tables; both are forgotten."""
    # of sources at one place the smallest id
    before, src = src, stored(src.groupBy(*by, "__sx", "__sy").agg(F.min("__id").alias("__id")), "nearest")
    forgotten(before)
    base = side = _side(src, by, side)
    done = None
    for k in range(ROUNDS + 1):
        last = k == ROUNDS
        found = _far(left, src, own, by, x, y, base) if last else _near(left, src, own, by, x, y, side)
        done = found if done is None else done.unionByName(found)
        if last:
            break
        before, left = left, stored(left.join(found.select(*own), own, "left_anti"), "nearest")
        forgotten(before)
        if not left.limit(1).count():
            break
        side *= 2
    forgotten(left, src)
    return done


def nearest(targets: DataFrame, sources: DataFrame, key: Key, x: str, y: str, source_id: str, size: float) -> DataFrame:
    """(key of targets, x, y, source_id, dist): the nearest source of each target; among equals the smallest (y, x, id).
    ``size`` is the first bucket's side, best a few times the usual distance. Points without both coordinates take no part.
    Keys must not be null."""
    names = keys(key)
    there = lambda a, b: (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    src = stored(sources.select(F.col(x).alias("__sx"), F.col(y).alias("__sy"), F.col(source_id).alias("__id")).filter(there("__sx", "__sy")), "nearest")
    own = [*names, *(c for c in (x, y) if c not in names)]
    goal = stored(targets.select(*own).filter(there(x, y)).distinct(), "targets")
    if not src.limit(1).count():
        return goal.select(*own, F.lit(None).cast(sources.schema[source_id].dataType).alias(source_id), F.lit(None).cast("double").alias("dist")).limit(0)
    places = stored(goal.select(x, y).distinct(), "nearest")  # each round starts from what the last one left, not from the input
    found = _searched(places, src, [x, y], [], x, y, size)
    return goal.join(found, [x, y]).select(*own, F.col("__b.__id").alias(source_id), F.sqrt("__b.d2").alias("dist"))


def fill_map(cells: DataFrame, valid: DataFrame, region: str, cell: str, ix: str, iy: str) -> DataFrame:
    """(region, cell, source): for every cell of a region without a value the nearest cell of the same region with one, in
    grid index space. cells: (region, cell, ix, iy) of all; valid: (region, cell) of those with values. Regions and cells must
    not be null."""
    cells = stored(cells.join(valid.select(region, cell).distinct().withColumn("__has", F.lit(True)), [region, cell], "left"), "fill")
    have = stored(cells.filter("__has").select(region, F.col(cell).alias("__id"), F.col(ix).alias("__sx"), F.col(iy).alias("__sy")), "fill")
    left = cells.filter("__has is null").select(region, cell, ix, iy)
    left = stored(left.join(have.select(region).distinct(), region, "left_semi"), "fill")  # a region without any value stays empty
    forgotten(cells)
    found = _searched(left, have, [region, cell, ix, iy], [region], ix, iy, 4)
    return found.select(region, cell, F.col("__b.__id").alias("source"))


def filled(values: DataFrame, sources: DataFrame, region: str, cell: str, t: Key, v: str) -> DataFrame:
    """values (region, cell, t, v) with the cells of the map added, each with its source's value at every time. The map is
    made once for a pattern of gaps; only an equi-join runs over the times."""
    moved = sources.join(values.select(region, F.col(cell).alias("source"), *keys(t), v), [region, "source"]).select(region, cell, *keys(t), v)
    have = values.filter(F.col(v).isNotNull()).select(region, cell, *keys(t), v)
    return have.unionByName(moved.join(have.select(region, cell, *keys(t)), [region, cell, *keys(t)], "left_anti"))


def extrapolate(cube: DataFrame, bridge: DataFrame, grid: DataFrame, cell: str, t: str, v: str, ix: str = "ix", iy: str = "iy", region: str = "region_id") -> DataFrame:
    """(region, cell, t, v): every region's cells at every time, missing ones from the nearest valid neighbour of the region.

    Times at which the same cells of a region have values share a pattern, and sources are sought once a pattern, usually
    one a region for all times; then only equi-joins run over the times. A region without any value at a time has no rows
    there. grid: (cell, ix, iy) of all cells."""
    inside = cube.filter(F.col(v).isNotNull()).select(cell, t, v).join(bridge.select(cell, region), cell)
    pattern = F.xxhash64(F.col(region), F.bit_xor(F.xxhash64(cell)), F.count("*"))
    times = inside.groupBy(region, t).agg(pattern.alias("__p"))
    one = times.groupBy(region, "__p").agg(F.min(t).alias(t))
    valid = inside.join(one, [region, t]).select("__p", cell)
    cells = bridge.join(grid.select(cell, ix, iy), cell).join(one.select(region, "__p"), region).select("__p", cell, ix, iy)
    sources = fill_map(cells, valid, "__p", cell, ix, iy)
    moved = inside.join(times, [region, t]).withColumnRenamed(cell, "source").join(sources, ["__p", "source"])
    return inside.select(region, cell, t, v).unionByName(moved.select(region, cell, t, v))


def distance_to(cells: DataFrame, vertices: DataFrame, cell: str, x: str, y: str, size: float) -> DataFrame:
    """(cell, dist): how far each cell is from the nearest vertex."""
    named = vertices.select(x, y).distinct().withColumn("__v", F.xxhash64(x, y))
    return nearest(cells.select(cell, x, y), named, cell, x, y, "__v", size).select(cell, "dist")
