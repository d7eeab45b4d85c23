"""Polygons, membership of cells, merging of region results.

Regions are rows (region_id, name, rings: array<array<struct<x,y>>>, xmin, xmax, ymin, ymax). Cells are tested once; the
result (cell, region) is a bridge table that everything else equi-joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import Key, keys


def with_bounds(regions: DataFrame) -> DataFrame:
    """Adds the bounding box from the rings."""
    xs, ys = F.flatten("rings")["x"], F.flatten("rings")["y"]
    return regions.withColumns({"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)})


def edges(regions: DataFrame) -> DataFrame:
    """(region_id, ring, x0, y0, x1, y1): every ring's edges; an open ring is closed."""
    ring = regions.select("region_id", F.posexplode("rings").alias("ring", "points"))
    ring = ring.withColumn("next", F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1)))
    pair = ring.select("region_id", "ring", F.explode(F.arrays_zip("points", "next")).alias("e"))
    flat = pair.select("region_id", "ring", *(F.col(f"e.{a}.{c}").alias(f"{c}{i}") for i, a in enumerate(("points", "next")) for c in ("x", "y")))
    return flat.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


#: Squares to a side of the whole plane in which boxes are looked up, and parts that the cells of a square are dealt to; squares
#: to a side of a region's own box, which are inside, outside or on the edge; bands of a region's height for its edges.
SQUARES, DEALT, OWN, BANDS = 32, 16, 64, 64
OUTSIDE, INSIDE, EDGE = 0, 1, 2


def in_boxes(cells: DataFrame, regions: DataFrame, x: str = "x", y: str = "y", grow: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells joined to the regions whose bounding box, grown by a distance, holds them. Both meet by the squares of a coarse
    grid, so a cell is compared with the boxes that reach into its square; a square's cells are dealt to ``DEALT`` keys, each
    of which has the square's boxes. keep: other columns of the regions that are wanted."""
    box = regions.select("region_id", *keep, *((F.col(c) + (grow if c.endswith("max") else -grow)).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))
    whole = box.agg(*(f(c).alias(f"__{c}") for c, f in (("xmin", F.min), ("xmax", F.max), ("ymin", F.min), ("ymax", F.max))))  # one row
    at = lambda v, c: F.floor((v - F.col(f"__{c}min")) / F.greatest((F.col(f"__{c}max") - F.col(f"__{c}min")) / SQUARES, F.lit(1e-300)))
    placed = box.crossJoin(whole)
    for c in "xy":
        placed = placed.withColumn(f"__b{c}", F.explode(F.sequence(at(F.col(f"{c}min"), c), at(F.col(f"{c}max"), c))))
    placed = placed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).drop(*(f"__{c}{e}" for c in "xy" for e in ("min", "max")))
    own = cells.crossJoin(whole).withColumns({"__bx": at(F.col(x), "x"), "__by": at(F.col(y), "y"), "__part": F.pmod(F.hash(x, y), F.lit(DEALT))}).drop(*(f"__{c}{e}" for c in "xy" for e in ("min", "max")))
    inside = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))
    return own.join(placed, ["__bx", "__by", "__part"]).filter(inside).drop("xmin", "xmax", "ymin", "ymax", "__bx", "__by", "__part")


def covering(rings: list, box: tuple[float, float, float, float], buffer: float = 0.0, side: int = OWN) -> np.ndarray:
    """What the squares of a box (xmin, xmax, ymin, ymax) are to a polygon, row by row from below: outside, inside, or within
    ``buffer`` of an edge. A square that no edge comes near is inside if its middle is."""
    ends = []
    for ring in rings:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        ends.append(np.hstack([p, np.roll(p, -1, axis=0)]))
    e = np.concatenate(ends) if ends else np.zeros((0, 4))
    e = e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])]
    x0, x1, y0, y1 = box
    w, h = max((x1 - x0) / side, 1e-300), max((y1 - y0) / side, 1e-300)
    # an edge in pieces of at most a square each; the squares that a piece's own box reaches are near the edge
    n = np.clip(np.ceil(np.maximum(np.abs(e[:, 2] - e[:, 0]) / w, np.abs(e[:, 3] - e[:, 1]) / h)), 1, 2 * side).astype(int)
    of = np.repeat(np.arange(len(e)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a, b = k / n[of], (k + 1) / n[of]
    along = lambda c, f: e[of, c] + (e[of, c + 2] - e[of, c]) * f
    near = np.zeros((side + 1, side + 1), np.int64)
    slack = 1e-9 * max(abs(v) for v in (*box, 1.0)) + buffer
    first, last = [], []
    for c, at, step in ((0, x0, w), (1, y0, h)):
        p, q = along(c, a), along(c, b)
        first.append(np.clip(np.floor((np.minimum(p, q) - slack - at) / step), 0, side - 1).astype(int))
        last.append(np.clip(np.floor((np.maximum(p, q) + slack - at) / step), 0, side - 1).astype(int) + 1)
    for i, j, sign in ((first[0], first[1], 1), (last[0], first[1], -1), (first[0], last[1], -1), (last[0], last[1], 1)):
        np.add.at(near, (j, i), sign)
    near = near.cumsum(axis=0).cumsum(axis=1)[:side, :side] > 0
    out = np.zeros((side, side), np.int8)
    middle = x0 + (np.arange(side) + 0.5) * w
    for j in range(side):
        y = y0 + (j + 0.5) * h
        hit = e[(e[:, 1] > y) != (e[:, 3] > y)]
        cross = np.sort(hit[:, 0] + (y - hit[:, 1]) / (hit[:, 3] - hit[:, 1]) * (hit[:, 2] - hit[:, 0]))
        out[j] = (len(cross) - np.searchsorted(cross, middle, "right")) % 2
    return np.where(near, EDGE, out).astype(np.int8)


def covered(regions: DataFrame, buffer: float = 0.0) -> DataFrame:
    """regions with ``__squares``: the covering of each region's box, grown by the buffer, a byte for each of its squares."""

    @F.pandas_udf("binary")
    def squares(rings: pd.Series, x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([covering(r, (a - buffer, b + buffer, c - buffer, d + buffer), buffer).tobytes() for r, a, b, c, d in zip(rings, x0, x1, y0, y1, strict=True)], dtype=object)

    return regions.withColumn("__squares", squares("rings", "xmin", "xmax", "ymin", "ymax"))


def cell_region(cells: DataFrame, regions: DataFrame, cell: str = "cell_id", x: str = "x", y: str = "y", buffer: float = 0.0) -> DataFrame:
    """(cell, region_id): cells whose centre lies inside a region, or within ``buffer`` of its edge.

    A region's box is cut into squares that are outside, inside or on the edge; only cells in the latter are tested against
    edges, and only those of their band of the region's height. A ray to the right of a point crosses an odd number of the
    edges around it; an edge has its lower end but not its upper, so no corner counts twice, and a point on a left or lower
    edge is inside. The ray's crossings are summed up before the shuffle."""
    px, py = F.col(x), F.col(y)
    known = covered(regions, buffer).select("region_id", "xmin", "xmax", "ymin", "ymax", "__squares", *((F.col(f"{c}min") - buffer).alias(f"__{c}_from") for c in "xy"), *(((F.col(f"{c}max") - F.col(f"{c}min") + 2 * buffer) / OWN).alias(f"__{c}_step") for c in "xy"))
    met = in_boxes(cells.select(cell, x, y).distinct(), known, x, y, buffer, ("__squares", *(f"__{c}_{e}" for c in "xy" for e in ("from", "step"))))
    at = lambda v, c: F.least(F.greatest(F.floor((v - F.col(f"__{c}_from")) / F.greatest(F.col(f"__{c}_step"), F.lit(1e-300))), F.lit(0)), F.lit(OWN - 1))
    byte = F.substring("__squares", at(py, "y").cast("int") * OWN + at(px, "x").cast("int") + 1, 1)
    near = met.select(cell, x, y, "region_id", F.conv(F.hex(byte), 16, 10).cast("int").alias("__is")).filter(F.col("__is") != OUTSIDE)
    sure = near.filter(F.col("__is") == INSIDE).select(cell, "region_id")
    height = regions.select("region_id", (F.col("ymin") - buffer).alias("__y0"), F.greatest((F.col("ymax") - F.col("ymin") + 2 * buffer) / BANDS, F.lit(1e-300)).alias("__h"))
    band = lambda v: F.floor((v - F.col("__y0")) / F.col("__h"))
    own = near.filter(F.col("__is") == EDGE).join(height, "region_id").withColumn("__band", band(py)).drop("__y0", "__h", "__is")
    cut_up = edges(regions).join(height, "region_id").withColumn("__band", F.explode(F.sequence(band(F.least("y0", "y1") - buffer), band(F.greatest("y0", "y1") + buffer)))).drop("__y0", "__h")
    met = own.join(cut_up, ["region_id", "__band"])
    cut = (F.col("y0") > py) != (F.col("y1") > py)
    along = F.col("x0") + (py - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    inside = F.pmod(F.sum(F.when(cut & (px < along), 1).otherwise(0)), F.lit(2)) == 1
    if buffer <= 0:
        tested = met.groupBy(cell, "region_id").agg(inside.alias("__in")).filter("__in")
    else:
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        part = F.least(F.greatest(((px - F.col("x0")) * dx + (py - F.col("y0")) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        away = F.hypot(px - (F.col("x0") + part * dx), py - (F.col("y0") + part * dy))
        tested = met.groupBy(cell, "region_id").agg(inside.alias("__in"), F.min(away).alias("__d")).filter(F.col("__in") | (F.col("__d") <= buffer))
    return sure.unionByName(tested.select(cell, "region_id"))


def areas(regions: DataFrame) -> DataFrame:
    """(region_id, area, cx, cy): shoelace sums over all rings; holes run the other way round."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    s = edges(regions).groupBy("region_id").agg(F.sum(cross).alias("s"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"))
    return s.select("region_id", F.abs(F.col("s") / 2).alias("area"), (F.col("sx") / (3 * F.col("s"))).alias("cx"), (F.col("sy") / (3 * F.col("s"))).alias("cy"))


def distances(regions: DataFrame, x: float, y: float) -> DataFrame:
    """(region_id, distance): how far each region's centroid is from a point."""
    return areas(regions).select("region_id", F.hypot(F.col("cx") - x, F.col("cy") - y).alias("distance"))


def clip(cube: DataFrame, bridge: DataFrame, cell: str = "cell_id") -> DataFrame:
    """The cube's rows inside regions, with region_id."""
    return cube.join(bridge, cell)


def overlay(full: DataFrame, part: DataFrame, key: Key, *values: str) -> DataFrame:
    """The new value where there is one, else the old; extra keys of the part are left out."""
    new = part.select(*keys(key), *(F.col(v).alias(f"__{v}") for v in values))
    return full.join(new, keys(key), "left").withColumns({v: F.coalesce(f"__{v}", v) for v in values}).drop(*(f"__{v}" for v in values))


def conflicts(pieces: DataFrame, key: Key, *values: str) -> DataFrame:
    """(key, differing): keys for which the pieces have more than one value, and of which columns."""
    both = [F.when(F.min(v) != F.max(v), F.lit(v)) for v in values]
    return pieces.groupBy(*keys(key)).agg(F.array_compact(F.array(*both)).alias("differing")).filter(F.size("differing") > 0)


def merge_no_conflicts(pieces: DataFrame, key: Key, *values: str) -> DataFrame:
    """One row for each key; the value of the pieces that have one. Raises ValueError where they differ."""
    if found := conflicts(pieces, key, *values).limit(3).collect():
        raise ValueError(f"pieces have different values, as for {', '.join(str(tuple(r)) for r in found)}")
    return pieces.groupBy(*keys(key)).agg(*(F.max(v).alias(v) for v in values))


def merge_by_priority(pieces: DataFrame, priorities: DataFrame, key: Key, region: str, *values: str) -> DataFrame:
    """Of several regions' values for a key that of the highest priority (region, priority); regions without one come last,
    and among equals the region that sorts last."""
    own = pieces.join(priorities.select(region, "priority"), region, "left")
    rank = F.struct(F.coalesce(F.col("priority"), F.lit(-1)).alias("p"), F.col(region))
    return own.groupBy(*keys(key)).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), rank)).alias(v) for v in values))


def listed_then_alphabetical(regions: DataFrame, listed: list[str], name: str = "name") -> DataFrame:
    """(name, priority) of the order in which regions are merged, the last one winning: the listed names first, from the lowest
    priority on, then all others by name."""
    manual = F.when(F.col(name).isin(listed), F.array_position(F.array(*(F.lit(x) for x in listed)), F.col(name))) if listed else F.lit(None)
    at = F.row_number().over(Window.orderBy(F.coalesce(manual, F.lit(len(listed) + 1)), name))  # a row a region
    return regions.select(name).distinct().select(name, (at - 1).alias("priority"))


def by_area(names: DataFrame, regions: DataFrame, name: str = "name") -> DataFrame:
    """(name, priority): larger regions win; a name without a region counts as the smallest; among equals the name decides."""
    size = areas(regions).join(regions.select("region_id", F.col(name).alias("__name")), "region_id")
    own = names.select(name).distinct().join(size.groupBy("__name").agg(F.first("area").alias("__area")), F.col(name) == F.col("__name"), "left")
    return own.select(name, (F.row_number().over(Window.orderBy(F.coalesce("__area", F.lit(0.0)), name)) - 1).alias("priority"))  # a row a region


def by_distance(names: DataFrame, regions: DataFrame, x: float, y: float, name: str = "name") -> DataFrame:
    """(name, priority): regions whose centroid is closer to a point win; a name without a region is the farthest; among equals
    the name decides."""
    away = distances(regions, x, y).withColumnRenamed("distance", "__away").join(regions.select("region_id", F.col(name).alias("__name")), "region_id")
    own = names.select(name).distinct().join(away.groupBy("__name").agg(F.first("__away").alias("__away")), F.col(name) == F.col("__name"), "left")
    return own.select(name, (F.row_number().over(Window.orderBy(F.coalesce("__away", F.lit(float("inf"))).desc(), name)) - 1).alias("priority"))  # a row a region


def paint(bridge: DataFrame, values: DataFrame, region: str = "region_id") -> DataFrame:
    """Each region's values on all its cells."""
    return bridge.join(values, region)


def region_sum(cells: DataFrame, bridge: DataFrame, cell: str, v: str, scale: float = 1.0, region: str = "region_id") -> DataFrame:
    """(region, total, n_cells) over a membership in which a cell may lie in several regions."""
    return cells.join(bridge, cell).groupBy(region).agg((F.sum(v) * scale).alias("total"), F.count("*").alias("n_cells"))


def net_melt(cells: DataFrame, bridge: DataFrame, cell: str, flux: str, area: str, region: str = "region_id", seconds: float = 3.15576e7) -> DataFrame:
    """(region, gt_per_year, n_cells): sum of flux (kg/m2/s) * area (m2)."""
    own = cells.select(cell, (F.col(flux) * F.col(area) * seconds / 1e12).alias("__m"))
    return region_sum(own, bridge, cell, "__m", 1.0, region).withColumnRenamed("total", "gt_per_year")


def observed_bands(df: DataFrame, observed: DataFrame, region: str, years: str) -> DataFrame:
    """Adds the observed mean +- sigma of each region, grown linearly with the years."""
    o = observed.select(region, "obs_mean", "obs_sigma")
    return df.join(o, region, "left").withColumns({"obs_low": F.col(years) * (F.col("obs_mean") - F.col("obs_sigma")), "obs_high": F.col(years) * (F.col("obs_mean") + F.col("obs_sigma"))})


def observed_total(observed: DataFrame) -> DataFrame:
    """The sum of means, and of sigmas in quadrature."""
    return observed.agg(F.sum("obs_mean").alias("obs_mean"), F.sqrt(F.sum(F.col("obs_sigma") * F.col("obs_sigma"))).alias("obs_sigma"))


def display_names(df: DataFrame, names: DataFrame, code: str, out: str = "display_name") -> DataFrame:
    """Adds a code's name, or the code itself."""
    return df.join(names.select(code, F.col("name").alias(out)), code, "left").withColumn(out, F.coalesce(out, F.col(code).cast("string")))


def basin_melt(df: DataFrame, t: str, basin: str, tf: str, dt: str, offset: str, floating: str, gamma0: float, cste: float, scyr: float = 31556926.0, rhoi: float = 910.0) -> DataFrame:
    """Adds melt: -coef * (TF + dT) * |basin's mean TF + dT| + offset where floating, else 0; the basin means are summed up
    before the shuffle and joined back."""
    mean = df.groupBy(t, basin).agg(F.avg(tf).alias("__mean"))
    coef = gamma0 * cste / scyr * rhoi
    melt = -coef * (F.col(tf) + F.col(dt)) * F.abs(F.col("__mean") + F.col(dt)) + F.col(offset)
    return df.join(mean, [t, basin]).withColumn("melt", F.when(F.col(floating), melt).otherwise(0.0)).drop("__mean")
