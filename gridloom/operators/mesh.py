"""Delaunay triangles of scattered nodes, by tiles.

Nodes are dealt to tiles of about ``tile`` nodes each: strips of x with equally many nodes, cut by y into cells with equally
many. A task triangulates one tile's nodes with those of a halo around it. A triangle whose circle lies inside the halo is
right whatever other tiles have. Any other circle (or, on the hull, half-plane) is sent to the tiles that it reaches; each of
these answers with its deepest node inside, and tiles that got such nodes triangulate again with them. This ends when no
circle holds a node, so every triangle meets the empty-circle rule against all nodes. A triangle is given by the tile of its
smallest corner, once.

Nodes on one circle, as in regular grids, have many triangulations. So that all tiles choose the same one, places are moved by
a hash of themselves, some 1e-10 of the whole width, before circles are compared; results have the places as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forgotten, stored

TILE, HALO, ROUNDS = 400, 0.35, 40
_OUT = "a {0}, ax double, ay double, b {0}, bx double, by double, c {0}, cx double, cy double"


def _turn(ax, ay, bx, by, px, py):
    """Positive where p lies to the left of the line from a to b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _depth(ax, ay, bx, by, cx, cy, px, py):
    """Positive where p lies inside the circle of a, b and c (counterclockwise), as a share of what rounding could make of it."""
    ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = a2 * (bx * cy - by * cx) - b2 * (ax * cy - ay * cx) + c2 * (ax * by - ay * bx)
    size = a2 * (abs(bx * cy) + abs(by * cx)) + b2 * (abs(ax * cy) + abs(ay * cx)) + c2 * (abs(ax * by) + abs(ay * bx))
    return det / np.maximum(size, 1e-300)


def triangulated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The triangles (counterclockwise, as rows of three numbers of points) of a few hundred points, and for each edge of their
    hull a row with -1 as its last number, outside to the left. Points are added one by one; the hole that a point makes is
    filled anew. No three of the first points that are used may lie on one line, and there must be three that don't."""
    n = len(x)
    start = next(((0, i, j) for i in range(1, n) for j in range(i + 1, n) if _turn(x[0], y[0], x[i], y[i], x[j], y[j]) != 0), None)
    if start is None:
        return np.zeros((0, 3), np.int64)
    if _turn(*(v[k] for k in start[:2] for v in (x, y)), x[start[2]], y[start[2]]) < 0:
        start = start[0], start[2], start[1]
    a, b, c = start
    room = 4 * n + 64
    corner = np.full((room, 3), -1)
    place = np.zeros((6, room))
    alive = np.zeros(room, bool)
    used = 0

    def add(rows: list[tuple[int, int, int]]) -> None:
        nonlocal used, corner, place, alive
        if used + len(rows) > len(alive):  # the dead make room
            keep = np.flatnonzero(alive[:used])
            used = len(keep)
            grown = max(len(alive), 2 * (used + len(rows)))
            corner_, place_, alive_ = np.full((grown, 3), -1), np.zeros((6, grown)), np.zeros(grown, bool)
            corner_[:used], place_[:, :used], alive_[:used] = corner[keep], place[:, keep], True
            corner, place, alive = corner_, place_, alive_
        own = np.array(rows)
        to = used + len(rows)
        corner[used:to] = own
        for k in range(3):
            place[2 * k, used:to], place[2 * k + 1, used:to] = x[own[:, k]], y[own[:, k]]
        alive[used:to] = True
        used = to

    add([(a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)])
    for p in range(n):
        if p in start:
            continue
        own = place[:, :used]
        outer = corner[:used, 2] < 0
        hit = np.where(outer, _turn(*own[:4], x[p], y[p]), _depth(*own, x[p], y[p])) > 0
        bad = np.flatnonzero(hit & alive[:used])
        edges = {(int(t[k]), int(t[(k + 1) % 3])) for t in corner[bad] for k in range(3)}
        rim = [(u, v) for u, v in edges if (v, u) not in edges]
        alive[bad] = False
        add([(p, u, -1) if v < 0 else (v, p, -1) if u < 0 else (u, v, p) for u, v in rim])
    return corner[:used][alive[:used]]


def _tiles(nodes: DataFrame, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of strips, and of the cells of each strip: some 8 bytes for every ``tile`` nodes, by mergeable quantiles."""
    n, lo, hi, low, high = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(1, int(np.ceil(np.sqrt(n / tile))))
    shares = F.array(*(F.lit(k / side) for k in range(1, side))) if side > 1 else None
    if shares is None:
        return np.array([lo, hi]), np.array([[low, high]])
    strips = np.array([lo, *nodes.agg(F.percentile_approx("x", shares, 10_000).alias("q")).first().q, hi])
    inner = F.array(*(F.lit(float(e)) for e in strips[1:-1]))
    strip = F.size(F.filter(inner, lambda e: e <= F.col("x")))
    cells = {r.s: r.q for r in nodes.groupBy(strip.alias("s")).agg(F.percentile_approx("y", shares, 10_000).alias("q")).collect()}
    even = list(np.linspace(low, high, side + 1)[1:-1])
    return strips, np.array([[low, *cells.get(s, even), high] for s in range(side)])


class Tiling:
    """Where places and shapes belong. The outermost tiles reach without end, as there are no nodes beyond."""

    def __init__(self, strips: np.ndarray, cells: np.ndarray):
        self.strips, self.cells, self.side = strips, cells, len(cells)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.strips[1:-1], x, "right")
        j = np.zeros(len(x), np.int64)
        for s in np.unique(i).tolist():
            at = i == s
            j[at] = np.searchsorted(self.cells[s][1:-1], y[at], "right")
        return i * self.side + j

    def box(self, k: int, halo: float = 0.0) -> tuple[float, float, float, float]:
        i, j = divmod(k, self.side)
        x0, x1, y0, y1 = self.strips[i], self.strips[i + 1], self.cells[i][j], self.cells[i][j + 1]
        dx, dy = halo * max(x1 - x0, 1e-300), halo * max(y1 - y0, 1e-300)
        far = lambda edge, at, sign: sign * np.inf if at else edge
        return far(x0 - dx, i == 0, -1), far(x1 + dx, i == self.side - 1, 1), far(y0 - dy, j == 0, -1), far(y1 + dy, j == self.side - 1, 1)

    def boxes(self) -> np.ndarray:
        """(x0, x1, y0, y1) of all tiles, ends as they are."""
        i, j = np.divmod(np.arange(self.side**2), self.side)
        return np.stack([self.strips[i], self.strips[i + 1], self.cells[i, j], self.cells[i, j + 1]])

    def near(self, x: np.ndarray, y: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray]:
        """(which place, tile) for all tiles in whose halo a place lies, or which it is of."""
        who, where = [], []
        low, high = self.cells[:, :-1].copy(), self.cells[:, 1:].copy()
        reach = halo * np.maximum(high - low, 1e-300)
        low, high = low - reach, high + reach
        low[:, 0], high[:, -1] = -np.inf, np.inf
        for i in range(self.side):  # a strip's cells at once
            x0, x1, _, _ = self.box(i * self.side, halo)
            a, b = np.searchsorted(x, x0, "left"), np.searchsorted(x, x1, "right")
            at, cell = np.nonzero((y[a:b, None] >= low[i]) & (y[a:b, None] <= high[i]))
            who.append(a + at)
            where.append(i * self.side + cell)
        return np.concatenate(who), np.concatenate(where)

    def reached(self, kind: int, ax, ay, bx, by, cx, cy) -> np.ndarray:
        """The tiles that a circle or a half-plane reaches. A circle is held against the tiles of its own box only."""
        if kind == 2:
            x0, x1, y0, y1 = self.boxes()
            left = np.max([_turn(ax, ay, bx, by, px, py) for px in (x0, x1) for py in (y0, y1)], axis=0)
            return np.flatnonzero(left > 0)
        mx, my, r = (float(v) for v in _circle(*(np.float64(v) for v in (ax, ay, bx, by, cx, cy))))
        if not np.isfinite(r):
            return np.arange(self.side**2)
        first, last = np.searchsorted(self.strips, mx - r, "left") - 1, np.searchsorted(self.strips, mx + r, "right")
        out = []
        for i in range(max(first, 0), min(last, self.side)):
            dx = max(self.strips[i] - mx, mx - self.strips[i + 1], 0.0)
            row = self.cells[i]
            j0, j1 = max(np.searchsorted(row, my - r, "left") - 1, 0), min(np.searchsorted(row, my + r, "right"), self.side)
            dy = np.maximum(np.maximum(row[j0:j1] - my, my - row[j0 + 1 : j1 + 1]), 0)
            out.append(i * self.side + j0 + np.flatnonzero(np.hypot(dx, dy) <= r))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _moved(x: np.ndarray, y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Places moved by a hash of themselves."""
    bits = (x + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ((y + 0.0).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for k, v in enumerate((x, y)):
        h = bits ^ np.uint64(0xA5A5A5A5 * (k + 1))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(v + ((h >> np.uint64(11)) / 2.0**53 - 0.5) * (1e-10 * width))
    return out[0], out[1]


def delaunay(nodes: DataFrame, node: str = "node", x: str = "x", y: str = "y", tile: int = TILE) -> DataFrame:
    """(a, ax, ay, b, bx, by, c, cx, cy), the Delaunay triangles, a being the smallest corner. Nodes at one place are one, the
    smallest; nodes without a place are left out; nodes on one line have no triangles. Raises ValueError if circles are still
    not empty after ``ROUNDS`` rounds."""
    spark = nodes.sparkSession
    own = nodes.select(F.col(node).alias("node"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    kind = own.schema["node"].dataType.simpleString()
    own = stored(own.groupBy("x", "y").agg(F.min("node").alias("node")), "mesh-nodes")
    if not own.limit(1).count():
        return spark.createDataFrame([], _OUT.format(kind))
    tiling = Tiling(*_tiles(own, tile))
    width = float(max(tiling.strips[-1] - tiling.strips[0], tiling.cells[:, -1].max() - tiling.cells[:, 0].min())) or 1.0
    held = spark.sparkContext.broadcast(tiling)  # a number for every ``tile`` nodes

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("x", ignore_index=True)
            px, py = batch["x"].to_numpy(), batch["y"].to_numpy()
            who, where = held.value.near(px, py, HALO)
            home = held.value.of(px, py)
            yield batch.iloc[who].assign(tile=where, own=home[who] == where)[["tile", "own", "node", "x", "y"]]

    known_type = f"tile long, own boolean, node {kind}, x double, y double"
    shape_type = f"kind int, tile long, {_OUT.format(kind)}"

    def mesh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node", ignore_index=True)
        mx, my = _moved(rows["x"].to_numpy(), rows["y"].to_numpy(), width)
        tri = triangulated(mx - mx.mean(), my - my.mean())
        mine = np.append(rows["own"].to_numpy(bool), False)
        tri = tri[mine[tri].any(axis=1)]
        box = held.value.box(int(key[0]), HALO)
        ids, px, py = rows["node"].to_numpy(), rows["x"].to_numpy(), rows["y"].to_numpy()
        outer = tri[:, 2] < 0
        corner = {}
        for k, name in enumerate("abc"):
            corner[name], corner[f"{name}x"], corner[f"{name}y"] = ids[tri[:, k]], px[tri[:, k]], py[tri[:, k]]
        out = pd.DataFrame(corner, columns=[c.split()[0] for c in _OUT.split(", ")])
        cx, cy, r = _circle(*(v[tri[:, k]] for k in range(3) for v in (mx, my)))
        inside = ~outer & (cx - r >= box[0]) & (cx + r <= box[1]) & (cy - r >= box[2]) & (cy + r <= box[3])
        # kinds: 0 a triangle to give, 1 a circle to ask for, 2 a half-plane to ask for
        given = out[~outer].copy()
        order = np.sort(np.array([ids[t] for t in tri[~outer]]).reshape(-1, 3), axis=1)
        first = pd.Series(mine[:-1], index=ids)
        given = given[first.loc[order[:, 0]].to_numpy()] if len(given) else given
        asked = out[~inside]
        return pd.concat([given.assign(kind=0), asked.assign(kind=np.where(outer[~inside], 2, 1))]).assign(tile=int(key[0]))[[c.split()[0] for c in shape_type.split(", ")]]

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to = [held.value.reached(*r) for r in _shapes(batch, width)]
            yield batch.iloc[np.repeat(np.arange(len(batch)), [len(t) for t in to])].assign(at=np.concatenate(to) if to else np.zeros(0, np.int64))

    def test(asks: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(here):
            px, py = _moved(here["x"].to_numpy(), here["y"].to_numpy(), width)
            for tile_, (kind_, *p) in zip(asks["tile"].tolist(), _shapes(asks, width), strict=True):
                depth = _turn(*p[:4], px, py) if kind_ == 2 else _depth(*p, px, py)
                if kind_ == 2:
                    size = abs((p[2] - p[0]) * (py - p[1])) + abs((p[3] - p[1]) * (px - p[0]))
                    depth = depth / np.maximum(size, 1e-300)
                k = int(np.argmax(depth))
                if depth[k] > 1e-13 and not any(px[k] == p[i] and py[k] == p[i + 1] for i in range(0, 4 if kind_ == 2 else 6, 2)):
                    found.append((tile_, False, here["node"].iloc[k], here["x"].iloc[k], here["y"].iloc[k]))
        return pd.DataFrame(found, columns=["tile", "own", "node", "x", "y"]).drop_duplicates()

    known = stored(own.mapInPandas(deal, known_type), "mesh-known")
    places = known.filter("own").select(F.col("tile").alias("at"), "node", "x", "y")
    todo, done = known, []
    for _ in range(ROUNDS):
        shapes = stored(todo.groupBy("tile").applyInPandas(mesh, shape_type), "mesh-shapes")
        asked = shapes.filter("kind > 0").mapInPandas(reach, f"{shape_type}, at long")
        more = stored(asked.groupBy("at").cogroup(places.groupBy("at")).applyInPandas(test, known_type), "mesh-more")
        again = more.select("tile").distinct()
        done.append((shapes, again))
        if not more.limit(1).count():
            break
        grown = stored(todo.join(again, "tile", "left_semi").unionByName(more), "mesh-known")
        if todo is not known:
            forgotten(todo)
        todo = grown
    else:
        raise ValueError("the mesh has not settled; nodes may be too near to each other for their distance from 0")
    out = None
    for shapes, again in done:
        part = shapes.filter("kind = 0").join(again, "tile", "left_anti")
        out = part if out is None else out.unionByName(part)
    corners = F.sort_array(F.array(*(F.struct(F.col(k).alias("n"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "abc")))
    flat = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax")))
    long = F.greatest(*((F.col(f"{p}x") - F.col(f"{q}x")) ** 2 + (F.col(f"{p}y") - F.col(f"{q}y")) ** 2 for p, q in ("ab", "bc", "ca")))
    out = out.filter(flat > long * 1e-8).withColumn("k", corners)  # nodes on one line of the hull
    made = stored(out.select(*(c for i, k in enumerate("abc") for c in (F.col("k")[i]["n"].alias(k), F.col("k")[i]["x"].alias(f"{k}x"), F.col("k")[i]["y"].alias(f"{k}y")))), "mesh")
    forgotten(own, known, todo, *(s for s, _ in done))
    return made


def _circle(ax, ay, bx, by, cx, cy):
    """Centre and radius, the latter with some room for rounding; without end where the corners lie on a line."""
    with np.errstate(all="ignore"):
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        r = np.hypot(ux, uy)
        ok = np.isfinite(r)
        return np.where(ok, ax + ux, 0.0), np.where(ok, ay + uy, 0.0), np.where(ok, r * (1 + 1e-9), np.inf)


def _shapes(rows: pd.DataFrame, width: float) -> Iterator[tuple]:
    """(kind, places of its corners as moved) of each asked circle or half-plane."""
    moved = [v for k in "abc" for v in _moved(rows[f"{k}x"].to_numpy(), rows[f"{k}y"].to_numpy(), width)]
    yield from zip(rows["kind"].tolist(), *(v.tolist() for v in moved), strict=True)
