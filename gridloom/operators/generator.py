"""Principal components of a cube, phase-randomised realisations, reconstruction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .timeseries import Key, keys

#: A Gram matrix of so many steps is 200 MB; longer axes take subspace iteration, which holds steps x (modes + EXTRA) values.
MOST_STEPS, LONGEST, EXTRA, PASSES = 5_000, 200_000, 10, 40


def series(cube: DataFrame, cell: Key, t: str, v: str) -> DataFrame:
    """(cell, y, whole): each cell's series in order of time, less its mean; whole: whether no step of the cube is missing."""
    names = keys(cell)
    n = cube.agg(F.count_distinct(t).alias("__n"))  # one row
    own = cube.filter(F.col(v).isNotNull()).groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, v))), lambda s: s[v]).alias("y"))
    own = own.crossJoin(n).withColumn("whole", F.size("y") == F.col("__n"))
    mean = F.aggregate("y", F.lit(0.0), lambda a, b: a + b) / F.size("y")
    return own.select(*names, F.transform("y", lambda q: q - mean).alias("y"), "whole")


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that tasks send as packed blocks of rows (i, g); blocks of one place are added in one task, as they come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("i").to_pylist(), batch.column("g"), strict=True):
                x = np.frombuffer(raw.as_buffer())
                total[i] = total[i] + x if i in total else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["i", "g"])

    out = np.zeros(shape)
    for r in parts.repartition("i").mapInArrow(add, "i int, g binary").toLocalIterator():  # a row a block of the matrix
        x = np.frombuffer(r.g).reshape(-1, shape[1])
        out[r.i : r.i + len(x)] = x
    return out


def _sent(total: np.ndarray) -> pa.RecordBatch:
    """A task's matrix in blocks of rows of some 256 KB."""
    step = max(1, (1 << 15) // total.shape[1])
    at = range(0, len(total), step)
    return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([total[i : i + step].tobytes() for i in at], pa.binary())], names=["i", "g"])


def gram(rows: DataFrame, steps: int, cells: int) -> np.ndarray:
    """Sum over cells of y y'. A task has four times as many cells as steps at least, so that the matrices that tasks send are
    less than what they have read."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((steps, steps))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy().reshape(-1, steps)
            total += y.T @ y
        yield _sent(total)

    tasks = max(1, cells // (4 * steps), min(8, cells // steps))
    return _added(rows.select("y").coalesce(tasks).mapInArrow(part, "i int, g binary"), (steps, steps))


def leading(rows: DataFrame, steps: int, modes: int, seed: int = 0, passes: int = PASSES, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the Gram matrix and their vectors, without the matrix: a random thin basis goes through the
    rows (one product a task, steps x few values each), is made orthonormal, and goes again, until the values stay."""
    wide = min(modes + EXTRA, steps)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((steps, wide)))[0]
    before = np.zeros(modes)
    for _ in range(passes):
        held = rows.sparkSession.sparkContext.broadcast(basis)  # bounded by LONGEST

        def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(held.value.shape)
            for batch in batches:
                y = batch.column(0).flatten().to_numpy().reshape(-1, steps)
                total += y.T @ (y @ held.value)
            yield _sent(total)

        moved = _added(rows.select("y").mapInArrow(part, "i int, g binary"), basis.shape)
        held.destroy()
        value, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
        order = np.argsort(value)[::-1]
        value, vector = value[order], basis @ turn[:, order]
        settled = np.abs(value[:modes] - before) <= tolerance * max(value[0], 1e-300)
        if settled.all():
            break
        before = value[:modes]
        basis = np.linalg.qr(moved)[0]
    return value[:modes], vector[:, :modes]


def eof(cube: DataFrame, cell: Key, t: str, v: str, modes: int | None = None, drop_gaps: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """loadings (cell, mode, loading), scores (t, mode, score) and variance (mode, ratio) of the centred cube, modes from 1 in
    order of variance. Raises ValueError if cells miss steps, unless drop_gaps leaves these cells out, for more than ``LONGEST``
    steps, and for more than ``MOST_STEPS`` without ``modes``. The cells' series are written once; cells never leave their
    tasks, only sums over cells do. The loadings have length 1; each mode's largest score is positive."""
    names = keys(cell)
    times = sorted(r[0] for r in cube.select(t).distinct().limit(LONGEST + 1).collect())
    if len(times) > LONGEST:
        raise ValueError(f"more than {LONGEST} steps")
    if len(times) > MOST_STEPS and not modes:
        raise ValueError(f"{len(times)} steps; beyond {MOST_STEPS} say how many modes are wanted")
    rows = stored(series(cube, cell, t, v), "eof-series")
    whole = F.count_if("whole").alias("whole")
    square = F.sum(F.when(F.col("whole"), F.aggregate("y", F.lit(0.0), lambda a, q: a + q * q))).alias("square")
    seen = rows.agg(whole, F.count("*").alias("all"), square).first()
    if seen.all > seen.whole and not drop_gaps:
        raise ValueError(f"{seen.all - seen.whole} of {seen.all} cells miss steps; fill them, or leave them out with drop_gaps")
    rows = rows.filter("whole").drop("whole")
    if len(times) <= MOST_STEPS:
        value, vector = np.linalg.eigh(gram(rows, len(times), seen.whole))
        order = np.argsort(value)[::-1]
        value, vector = np.clip(value[order], 0, None), vector[:, order]
    else:
        value, vector = leading(rows, len(times), modes)
    total = float(seen.square or 0.0)
    rank = int((value > value[0] * 1e-12).sum()) if len(value) and value[0] > 0 else 0
    k = min(modes or rank, rank)
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    vector, value_k = (vector * np.where(sign == 0, 1, sign))[:, :k], value[:k]
    spark = cube.sparkSession
    basis = spark.sparkContext.broadcast(vector / np.sqrt(value_k))  # steps x modes, both bounded

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = basis.value[batch.column("__i").to_numpy()] * value_k
            yield pa.RecordBatch.from_arrays([batch.column(t), pa.array(list(found), pa.list_(pa.float64()))], names=[t, "s"])

    kind = cube.schema[t].dataType.simpleString()
    steps = spark.createDataFrame([(i, x) for i, x in enumerate(times)], f"__i long, {t} {kind}")
    scores = steps.mapInArrow(rows_of, f"{t} {kind}, s array<double>").select(t, F.posexplode("s").alias("mode", "score")).withColumn("mode", F.col("mode") + 1)
    ratio = value_k / total if total > 0 else value_k
    variance = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratio)], "mode int, ratio double")
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        for batch in batches:
            y = batch.column("y").flatten().to_numpy().reshape(-1, len(b))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(list(y @ b), pa.list_(pa.float64()))], names=[*names, "l"])

    kinds = ", ".join(f"{n} {cube.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(project, f"{kinds}, l array<double>")
    loadings = found.select(*names, F.posexplode("l").alias("mode", "loading")).withColumn("mode", F.col("mode") + 1)
    return loadings, scores, variance


def phase_randomised(scores: DataFrame, t: str, n: int, seed: int = 0) -> DataFrame:
    """(realization, t, mode, score): each mode's series with its amplitudes kept and its phases drawn anew, n times. A draw
    depends on (seed, realization, mode) alone. The mean's term keeps its value; the length may be odd or even."""
    realisations = scores.sparkSession.range(n).select(F.col("id").cast("int").alias("realization"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        y = pdf["score"].to_numpy(float)
        spectrum = np.fft.rfft(y)
        rng = np.random.default_rng([seed, int(pdf["realization"].iloc[0]), int(pdf["mode"].iloc[0])])
        turn = np.exp(2j * np.pi * rng.random(len(spectrum)))
        turn[0] = 1
        if len(y) % 2 == 0:
            turn[-1] = 1 if turn[-1].real >= 0 else -1
        return pdf.assign(score=np.fft.irfft(spectrum * turn, len(y)))[["realization", t, "mode", "score"]]

    kind = scores.schema[t].dataType.simpleString()
    return realisations.crossJoin(scores).groupBy("realization", "mode").applyInPandas(draw, f"realization int, {t} {kind}, mode int, score double")


#: Rows of a block of cells or of times; a product of two blocks is a batch of some 250,000 values.
BLOCK = 512


def _packed(df: DataFrame) -> DataFrame:
    """(rows): df's rows in blocks, each as one packed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    return df.mapInArrow(run, "rows binary")


def _rebuilt(loadings: DataFrame, scores: DataFrame, cell: Key, t: str, first: int, last: int | None, step: int, moments: DataFrame | None = None) -> DataFrame:
    """(realization if scores have it, t, cell, value): sums of score * loading, times each cell's std plus its mean plus its
    season at that time if ``moments`` (cell, mean, std, times, seasons) is given; times without a season are left out.

    Cells go into blocks and times into blocks; a pair of blocks is one matrix product in one task, so neither cells nor times
    meet row by row, and no value is shuffled after it is made."""
    names, by = keys(cell), [c for c in ("realization", t) if c in scores.columns]
    used = (F.col("mode") >= first) & (F.pmod(F.col("mode") - first, F.lit(step)) == 0)
    if last is not None:
        used = used & (F.col("mode") <= last)
    lists = lambda df, own, v: df.filter(used).groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", v))), lambda s: s[v]).alias("w"))
    cells, rows = lists(loadings, names, "loading"), lists(scores, by, "score")
    if moments is not None:
        cells = cells.join(moments, names)
    whole = moments is not None
    both = _packed(cells).withColumnRenamed("rows", "cells").crossJoin(_packed(rows).withColumnRenamed("rows", "times"))

    def matrix(table: pa.Table) -> np.ndarray:
        lists = table.column("w").combine_chunks()
        return lists.flatten().to_numpy().reshape(len(lists), -1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("cells"), batch.column("times"), strict=True):
                own, when = (pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks() for x in (a, b))
                value = matrix(when) @ matrix(own).T  # times x cells
                keep = np.ones(value.shape, bool)
                if whole:
                    at, seasons = own.column("times").combine_chunks(), own.column("seasons").combine_chunks()
                    known = pc.unique(at.flatten())
                    season = np.full((len(own), len(known) + 1), np.nan)  # the last column: no season
                    season[np.repeat(np.arange(len(own)), at.value_lengths().to_numpy()), pc.index_in(at.flatten(), known).to_numpy()] = seasons.flatten().to_numpy(zero_copy_only=False)
                    place = pc.index_in(when.column(t).combine_chunks(), known).fill_null(len(known)).to_numpy()
                    mean, std = (own.column(c).to_numpy() for c in ("mean", "std"))
                    value = value * std + mean + season[:, place].T
                    keep = np.isfinite(value)
                i, j = (pa.array(x) for x in np.nonzero(keep))
                yield pa.RecordBatch.from_arrays([*(when.column(c).combine_chunks().take(i) for c in by), *(own.column(c).combine_chunks().take(j) for c in names), pa.array(value[keep])], names=[*by, *names, "value"])

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, own in ((scores, by), (loadings, names)) for c in own]
    return both.mapInArrow(product, f"{', '.join(kinds)}, value double")


def reconstructed(loadings: DataFrame, scores: DataFrame, cell: Key, t: str, first: int = 1, last: int | None = None, step: int = 1) -> DataFrame:
    """(realization if scores have it, t, cell, value): sums of score * loading over modes first, first + step, ... last."""
    return _rebuilt(loadings, scores, cell, t, first, last, step)


def realisations(loadings: DataFrame, scores: DataFrame, moments: DataFrame, seasonality: DataFrame, cell: Key, t: str, mean: str, std: str, season: str) -> DataFrame:
    """(realization, t, cell, value): reconstruction * std + mean + seasonality of each cell."""
    names = keys(cell)
    own = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(season).cast("double").alias("s"))))
    seasons = seasonality.filter(F.col(t).isNotNull()).groupBy(*names).agg(own.alias("__s")).select(*names, F.col("__s.t").alias("times"), F.col("__s.s").alias("seasons"))
    extra = moments.select(*names, F.col(mean).cast("double").alias("mean"), F.col(std).cast("double").alias("std")).join(seasons, names)
    return _rebuilt(loadings, scores, cell, t, 1, None, 1, extra)


def _each_series(df: DataFrame, key: Key, t: str, v: str, fn: Callable[[np.ndarray, np.ndarray], dict[str, list]], out: str) -> DataFrame:
    """(key, ``out``): what fn gives for each key's times and values (NaN where missing) in order of time, many keys a batch."""
    names = keys(key)
    schema = T.StructType.fromDDL(out)
    own = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).cast("double").alias("v"))))
    lists = df.groupBy(*names).agg(own.alias("__s"), F.count("*").alias("__n")).select(*names, F.col("__s.t").alias("t"), F.col("__s.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x, y in zip(pdf["t"], pdf["v"], strict=True):
                if len(x) > MOST_STEPS:
                    raise ValueError(f"a series of {len(x)} steps; at most {MOST_STEPS}")
                found.append(fn(np.asarray(x), np.array(y, float)))
            yield pdf[names].assign(**{f.name: [x[f.name] for x in found] for f in schema.fields})

    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return lists.mapInPandas(run, f"{kinds}, {out}")


def segment_trends(df: DataFrame, key: Key, t: str, v: str, deg: int = 1, model: str = "rbf", penalty: float = 10.0, out: str = "detrended") -> DataFrame:
    """(key, t, v, segment, out): break points of each series, then each segment less its own polynomial (mean not restored).
    A series has at most MOST_STEPS steps: the kernel's table takes their square."""
    from .changepoint import pelt

    def cut(x: np.ndarray, y: np.ndarray) -> dict[str, list]:
        good = np.isfinite(y)
        segment, flat = np.full(len(y), -1), np.full(len(y), np.nan)
        own, a = np.flatnonzero(good), 0
        at_all = x.astype(float)
        for k, b in enumerate(pelt(y[good], model=model, penalty=penalty) if len(own) else []):
            at = own[a:b]
            segment[at] = k
            if len(at) > deg:
                mid = at_all[at].mean()
                flat[at] = y[at] - np.polyval(np.polyfit(at_all[at] - mid, y[at], deg), at_all[at] - mid)
            elif len(at):
                flat[at] = y[at] - y[at].mean()
            a = b
        return {"t": x.tolist(), "v": [q if np.isfinite(q) else None for q in y.tolist()], "segment": segment.tolist(), "flat": [q if np.isfinite(q) else None for q in flat.tolist()]}

    kind = df.schema[t].dataType.simpleString()
    done = _each_series(df, key, t, v, cut, f"t array<{kind}>, v array<double>, segment array<int>, flat array<double>")
    rows = done.select(*keys(key), F.explode(F.arrays_zip("t", "v", "segment", "flat")).alias("r"))
    return rows.select(*keys(key), F.col("r.t").alias(t), F.col("r.v").alias(v), F.col("r.segment").alias("segment"), F.col("r.flat").alias(out))


def break_points(df: DataFrame, key: Key, t: str, v: str, model: str = "l2", penalty: float = 10.0, method: str = "pelt", jump: int = 5) -> DataFrame:
    """(key, segment, start, end, n): the segments between change points of each series, by time."""
    from .changepoint import METHODS

    def cut(x: np.ndarray, y: np.ndarray) -> dict[str, list]:
        ends = METHODS[method](y, model=model, penalty=penalty, jump=jump)
        starts = [0, *ends[:-1]]
        return {"start": [float(x[a]) for a in starts], "end": [float(x[b - 1]) for b in ends], "n": [b - a for a, b in zip(starts, ends, strict=True)]}

    done = _each_series(df.filter(F.col(v).isNotNull()), key, t, v, cut, "start array<double>, end array<double>, n array<bigint>")
    rows = done.select(*keys(key), F.posexplode(F.arrays_zip("start", "end", "n")).alias("segment", "r"))
    return rows.select(*keys(key), "segment", *(F.col(f"r.{c}").alias(c) for c in ("start", "end", "n")))


def trend_component(df: DataFrame, key: Key, t: str, v: str, penalty: float = 10.0, model: str = "rbf", out: str = "trend") -> DataFrame:
    """(key, t, out): the sign-flipped change from the start less its piecewise-detrended self."""
    from .timeseries import change_from_start

    flipped = change_from_start(df, key, t, v, "__c", flip=True).select(*keys(key), t, "__c")
    return segment_trends(flipped, key, t, "__c", 1, model, penalty, "__d").select(*keys(key), t, (F.col("__c") - F.col("__d")).alias(out))
