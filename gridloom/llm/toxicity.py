"""Toxicity by non-negative positive-unlabelled learning.

Texts marked toxic are the positives; the unlabelled are drawn from all texts alike, whatever a label calls them, at every
size. The classifier is linear over the presence of words. Its risk is that of the positives, weighed by the class prior, plus that
of the unlabelled as negatives less what the positives among them account for; where this second part falls below zero,
the step goes the other way, so it can't be fitted below its least (non-negative risk). The prior is the toxic share of the
labelled texts that may be learnt from.

Bounds: of at most ``POSITIVES`` toxic and about ``UNLABELLED`` texts of all, chosen by a hash of their ids, the candidate words
(hashes, at most ``WORDS``) go to the driver for the fit. Candidate words and their positive counts come from these toxic texts
only, where they must occur ``LEAST`` times, ``RATIO`` times as often as in all texts that may be learnt from, and with a
``SURPRISE`` that chance does not give (less where there are few candidates). Of rows that repeat an id one is learnt from.

Defined results: null and empty texts have no words and get the score of a text without any known word; rows that repeat
an id each get their score; without positives every score is near 0; other columns stay, but those
with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, freed, text_batches
from .textbuf import LOWER, NOT_ALNUM, pieces, spans_hash, texts_of, words

POSITIVES, UNLABELLED = 8_000, 24_000
#: Words: least positives with it, least ratio of its share among positives to its share among all, least surprise (twice
#: the log likelihood ratio of a Poisson count) so that few words get in by chance, at most so many. Of k candidate words
#: about one gets in by chance at a surprise of 2 log k, so that is enough where there are few.
LEAST, RATIO, SURPRISE, WORDS = 3, 1.5, 15.0, 50_000
#: Slices of the words whose counts are summed apart.
SLICES = 16
STEPS, RATE, DECAY = 400, 0.05, 1e-4


def present(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text: hash and row, by row."""
    buf, off = texts_of(column)
    low = LOWER[buf]
    start, end, row = words(low, off, NOT_ALNUM)
    h = spans_hash(low, start, end)
    at = np.lexsort((h, row))
    h, row = h[at], row[at]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh]


def _among(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each h in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def features(df: DataFrame, text_col: str, wanted: np.ndarray | None = None) -> DataFrame:
    """df without the text, with its distinct words' hashes (those of ``wanted``, sorted hashes, if given) as array<long>."""
    rest = [c for c in df.columns if c != text_col]
    held = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                h, row = present(part.column(text_col))
                if held.value is not None:
                    good = _among(held.value, h)[1]
                    h, row = h[good], row[good]
                off = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists], names=[*rest, "words"])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField("words", T.ArrayType(T.LongType()))]))


def frequencies(df: DataFrame, text_col: str, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each wanted word (sorted hashes) is, and how many texts there are."""
    held = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        n, rows = np.zeros(len(own), np.int64), 0
        for batch in batches:
            for part in pieces(batch, text_col):
                h, _ = present(part.column(text_col))
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                n += np.bincount(at[own[at] == h], minlength=len(own))
                rows += part.num_rows
        parts = np.array_split(n, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([rows] + [0] * (SLICES - 1), pa.int64())], names=["slice", "counts", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rows = 0
        for batch in batches:
            rows += sum(batch.column("rows").to_pylist())
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array([rows] * len(total), pa.int64())], names=["slice", "counts", "rows"])

    parts = df.select(text_col).mapInArrow(run, "slice int, counts binary, rows long").repartition(SLICES, "slice")
    out, rows = {k: np.zeros(len(x), np.int64) for k, x in enumerate(np.array_split(wanted, SLICES))}, 0
    for r in parts.mapInArrow(add, "slice int, counts binary, rows long").collect():  # as many counts as wanted words
        out[r.slice], rows = np.frombuffer(r.counts, np.int64), max(rows, r.rows)
    return np.concatenate([out[k] for k in range(SLICES)]), rows


@dataclass
class Model:
    """Sorted hashes of words, their weights, and the offset."""

    words: np.ndarray
    weights: np.ndarray
    offset: float

    def margins(self, column: pa.Array) -> np.ndarray:
        h, row = present(column)
        if not len(self.words):
            return np.full(len(column), self.offset)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return self.offset + np.bincount(row, weights=np.where(self.words[at] == h, self.weights[at], 0), minlength=len(column))


def fit(words_: np.ndarray, positive: tuple[np.ndarray, np.ndarray, int], other: tuple[np.ndarray, np.ndarray, int], prior: float, steps: int = STEPS) -> Model:
    """Weights of ``words_`` by full-batch steps on the non-negative risk with logistic loss. positive, other: the index of
    each word, the row that has it, and the number of rows."""

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * x))

    k = len(words_)
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)

    def margins(at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=w[at], minlength=n)[:n] + w[k]

    def pulled(by: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, weights=by[row], minlength=k)[:k], by.sum())

    for step in range(1, steps + 1):
        p, u = margins(*positive), margins(*other)
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        as_negative = pulled(sigmoid(u) / other[2], *other[:2]) - prior * pulled(sigmoid(p) / positive[2], *positive[:2])
        grad = prior * pulled((sigmoid(p) - 1) / positive[2], *positive[:2]) + as_negative if negative >= 0 else -as_negative
        grad[:k] += DECAY * w[:k]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(words_, w[:k], float(w[k]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From docs (id, text) that may be learnt from and labels (id, 0/1) that may."""
    text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("id is not null and toxic is not null")
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("prior"), F.count("*").alias("n")).first()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    toxic = known.filter("toxic = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(POSITIVES)  # bounded
    texts = own.join(F.broadcast(toxic), "id", "left_semi")

    def lists_of(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
        return features(rows, "text", wanted).groupBy("id").agg(F.min("words").alias("words"))

    words_of = lists_of(texts)
    n_toxic = words_of.count()
    if not n_toxic or not share.prior or share.prior >= 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0 if not share.prior else 0.0)

    def placed(found: pa.ChunkedArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        found = found.combine_chunks()
        h = found.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        at, good = _among(wanted, h)
        return at[good], row[good], len(found)

    counts = words_of.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).toArrow()
    h, n = counts.column("w").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    h, n = h[np.argsort(h)], n[np.argsort(h)]
    if len(h):
        total, rows = frequencies(own, "text", h)
        expected = np.maximum(total * n_toxic / max(1, rows), 1e-9)
        ratio = n / expected
        surprise = 2 * (n * np.log(ratio) - (n - expected))
        best = np.argsort(-surprise, kind="stable")[:WORDS]
        h = np.sort(h[best[(ratio[best] >= RATIO) & (surprise[best] >= min(SURPRISE, 2 * np.log(len(h))))]])
    else:
        rows = own.count()
    if not len(h):
        return Model(h, np.zeros(0), float(np.log(share.prior / (1 - share.prior))))
    part = min(1.0, UNLABELLED / max(1, rows))
    chosen = own.filter((F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1_000_000)) < int(part * 1_000_000) + 1))  # positives too, as the risk takes off their part
    lists, other = (lists_of(x, h).select("words").toArrow().column("words") for x in (texts, chosen.filter("id is not null")))
    return fit(h, placed(lists, h), placed(other, h), float(share.prior))


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score double and predicted int."""
    held = df.sparkSession.sparkContext.broadcast(model)
    text_batches(df.sparkSession)
    df = freed(df, ["score", "predicted"], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                score = 0.5 * (1 + np.tanh(0.5 * held.value.margins(part.column(text_col))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def learns(id_col: Column) -> Column:
    return F.coalesce(crc_mod(id_col, 5), F.lit(1)) != 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the toxicity of every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.filter(learns(F.col("doc_id"))), labels.filter(learns(F.col("doc_id"))))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "score", "predicted")
