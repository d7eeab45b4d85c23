"""Language-model scoring: an interpolated modified Kneser-Ney model of word n-grams, counted in Spark.

Texts become written chunks of token numbers. From the highest order to the lowest, a chunk sends each range of hashes its
sorted distinct n-grams (64-bit hashes as gaps) with what it adds to their sums; a range adds all chunks up to one slice of
the model: a sorted array of hashes and arrays of counts beside it, in one file that the worker maps into memory. Each
chunk's n-grams are then looked up in the mapped arrays by binary search, and the chunk gets its numbers back in its own order.
Slices are stored as the model, if asked for, and a stored slice is mapped in the same way to score other texts.

Sums are: for the highest order the count; below it the number of distinct words before the n-gram (or its count, where it
begins a text, as nothing stands before it), and over the words that follow it their total and how many of them have a
number of one, two, and three or more. Each distinct n-gram is owned by one of the chunks that have it; the range says which.
Only the owner adds it to the sums of the n-grams that it starts and ends with, so these need no second list of n-grams.

A text's probability is the product over its words and one end of

    p(w | h) = max(a(hw) - D(a(hw)), 0) / a(h) + (D1 n1(h) + D2 n2(h) + D3 n3(h)) / a(h) * p(w | h without its first word),

where the last one is 1 / (V + 1). D1, D2 and D3 come from how many n-grams of an order have numbers of one to four; where
one of these is none they are 0.5, 1 and 1.5. A history that was not learned leaves the shorter one's probability.

Sizes are those of substring dedup: chunks of some 8 MB and slices of some 1 million tokens, both times the root of the input
over 64 GB, so what passes between chunks and slices grows no faster than the input. A frequent n-gram is one entry a chunk.
The driver gets eight sums of an order. Words are told apart by 64 bits.

Defined results: A-Z are lower-cased; words are what white space of ASCII parts; a null text is empty and has its end only;
rows that ``learn`` leaves null are not learned from; repeated rows count and are scored each; with nothing to learn from every
probability is one; other columns are left out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod, documents, forgotten, stored, text_batches
from .substring_dedup import Sizes, gaps, packed, range_of, unpacked
from .textbuf import LOWER, give_back, mix, pieces, spans_hash, texts_of, trimmed, words

ORDER = 3
#: Documents that the query does not learn from: those whose crc32 modulo 7 is 2. Fixed by the contract.
FOLDS, HELD_OUT = 7, 2
_START, _END = np.uint64(0x5C1E_57A2_7000_0001), np.uint64(0x5C1E_57A2_7000_0002)
_BY = np.uint64(0xD6E8FEB86659FD93)
#: Tokens that are scored at a time.
STEP = 1 << 17
#: Sums of an n-gram below the highest order. The first is its number a; then those of the words after it; the last only
#: of single words: how often the word occurs.
SUMS = ("a", "total", "n1", "n2", "n3", "count")
CHUNK = "chunk long, learn binary, sizes binary, vocabulary binary, codes binary"
BLOCK = "order int, slice long, chunk long, hashes binary, sums array<binary>, present binary"
ANSWER = "order int, slice long, chunk long, hashes binary, sums array<binary>, owned binary, stats array<long>"
_KEY = [("order", pa.int32()), ("slice", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("sums", pa.list_(pa.binary()))]
_BLOCK = pa.schema([*_KEY, ("present", pa.binary())])
_ANSWER = pa.schema([*_KEY, ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Model:
    """slices: (order, slice, hashes, sums), stored, or None if not kept; ranges: slices of an order; discounts: an order's
    D1, D2 and D3; unigrams: the sum of a over words, and of those with one, two and more; tokens, types: N and V."""

    order: int
    ranges: int
    discounts: tuple[tuple[float, float, float], ...]
    unigrams: tuple[int, int, int, int]
    tokens: int
    types: int
    slices: DataFrame | None = None


def chunks(df: DataFrame, id_col: str, text_col: str, learn: Column, chunk_bytes: int) -> DataFrame:
    """The texts as written chunks: ids, which are learned from, tokens of each, distinct hashes and every token's number."""
    kind = to_arrow_schema(T.StructType([df.schema[id_col]])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, ids, learns, sizes, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def sent() -> pa.RecordBatch:
            nonlocal at
            vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            raw = [np.packbits(np.concatenate(learns)).tobytes(), packed(np.concatenate(sizes).astype(np.uint64)), packed(gaps(vocabulary)), packed(codes.astype(np.uint64))]
            at += 1
            listed = pa.concat_arrays(ids)
            own = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            return pa.RecordBatch.from_arrays([pa.array([at - 1]), *(pa.array([x], pa.binary()) for x in raw), own], names=["chunk", "learn", "sizes", "vocabulary", "codes", "ids"])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                buf, off = texts_of(part.column("text"))
                low = LOWER[buf]
                start, end, row = words(low, off)
                n = np.bincount(row, minlength=part.num_rows)
                to = np.cumsum(n + 2)
                own = np.empty(int(to[-1]), np.uint64)
                own[to - n - 2], own[to - 1] = _START, _END
                own[np.arange(len(row)) + 2 * row + 1] = spans_hash(low, start, end)
                hashes.append(own)
                sizes.append(n + 2)
                learns.append(part.column("learn").fill_null(False).to_numpy(zero_copy_only=False))
                ids.append(part.column("id").cast(kind))
                held += len(buf) + 1
                if held > chunk_bytes:
                    yield sent()
                    ids, learns, sizes, hashes, held = [], [], [], [], 0
        if held:
            yield sent()

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), learn.alias("learn"))
    return stored(own.mapInArrow(trimmed(run), f"{CHUNK}, ids array<{df.schema[id_col].dataType.simpleString()}>"), "kneser-ney-chunks")


class Tokens:
    """A chunk's tokens end to end, each text with its start and end."""

    def __init__(self, chunk: dict):
        self.size = unpacked(chunk["sizes"]).astype(np.int64)
        self.word = np.cumsum(unpacked(chunk["vocabulary"]), dtype=np.uint64)[unpacked(chunk["codes"])]
        self.text = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.place = np.arange(len(self.word), dtype=np.int32) - np.repeat((np.cumsum(self.size) - self.size).astype(np.int32), self.size)
        self.learn = np.unpackbits(np.frombuffer(chunk["learn"], np.uint8), count=len(self.size)).astype(bool)[self.text]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of an order: the place of each one's last token, the distinct hashes in order, and which of these each is."""
        h = mix(self.word)
        for _ in range(order - 1):
            h = mix(np.append(np.uint64(0), h[:-1]) * _BY + self.word)  # what stands across the border of a text is left out
        at = np.flatnonzero(self.place >= order - 1).astype(np.int32)
        h = h[at]
        found, of = np.unique(h, return_inverse=True)
        return at, found, of.astype(np.int32)

    def at(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """grams, with the number of the n-gram that ends at each token (-1: none) instead of the list of numbers."""
        at, found, of = self.grams(order)
        ending = np.full(len(self.word), -1, np.int32)
        ending[at] = of
        return at, found, ending


def counted(tokens: Tokens, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The highest order's n-grams of a chunk, what it adds to their sums, and which of them it learns from."""
    at, found, of = tokens.grams(order)
    n = np.bincount(of[tokens.learn[at]], minlength=len(found))
    return found, [n], n > 0


def continued(tokens: Tokens, order: int, above: tuple[list[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The same for a lower order, from the sums and owned n-grams of the order above."""
    far, distinct, of = tokens.grams(order + 1)
    sums, owned = above
    last = np.zeros(len(distinct), np.int32)
    last[of] = far  # a place of each distinct n-gram
    last, a = last[owned], sums[0][owned]
    del far, distinct, of
    at, found, ending = tokens.at(order)
    n = len(found)
    number = np.bincount(ending[last], minlength=n)
    learned = at[tokens.learn[at]]
    if order > 1:  # nothing stands before the start of a text
        number += np.bincount(ending[learned[tokens.place[learned] == order - 1]], minlength=n)
    begun = ending[last - 1]
    total = np.zeros(n, np.int64)
    np.add.at(total, begun, a)
    out = [number, total, *(np.bincount(begun[own], minlength=n) for own in (a == 1, a == 2, a >= 3))]
    if order == 1:
        out.append(np.bincount(ending[learned[tokens.place[learned] > 0]], minlength=n))
    return found, out, np.bincount(ending[learned], minlength=n) > 0


def blocks(chunk: int, order: int, ranges: int, found: np.ndarray, sums: list[np.ndarray], present: np.ndarray) -> pa.Table:
    """What a chunk sends to each range."""
    own, begin = np.unique(range_of(found, ranges), return_index=True)
    cuts = list(zip(own.tolist(), begin.tolist(), [*begin.tolist(), len(found)][1:], strict=True))
    return pa.table(
        [[order] * len(cuts), [r for r, _, _ in cuts], [chunk] * len(cuts), [packed(gaps(found[a:b])) for _, a, b in cuts], [[packed(x[a:b].astype(np.uint64)) for x in sums] for _, a, b in cuts], [np.packbits(present[a:b]).tobytes() for _, a, b in cuts]],
        schema=_BLOCK,
    )


def answers_of(rows: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A chunk's sums of an order in the order of its n-grams, and which it owns; rows are its answers."""
    own = rows.filter(pc.equal(rows.column("order"), order)).sort_by("slice").to_pylist()
    if not own:  # no text has so many tokens
        return [np.zeros(0, np.int64)] * len(SUMS), np.zeros(0, bool)
    sums = [[_narrow(unpacked(x)) for x in r["sums"]] for r in own]
    owned = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(s[0])).astype(bool) for r, s in zip(own, sums, strict=True)]
    return [np.concatenate(x) for x in zip(*sums, strict=True)], np.concatenate(owned)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each where they all have room."""
    return x.astype(np.int32 if not len(x) or x.max() < 1 << 31 else np.int64)


class Slice:
    """Sorted hashes and arrays of sums beside them, in one file that is mapped into memory and has no name any more."""

    def __init__(self, hashes: np.ndarray, sums: list[np.ndarray]):
        with tempfile.TemporaryFile() as f:
            for x in (hashes, *sums):
                f.write(np.ascontiguousarray(x, "<u8").data)
            f.flush()
            mapped = np.memmap(f, "<u8", "r", shape=(1 + len(sums), len(hashes))) if len(hashes) else np.zeros((1 + len(sums), 0), np.uint64)
        self.hashes, self.sums = mapped[0], mapped[1:]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the hashes is, and whether it is there."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


def summed(order: int, highest: bool, keep: bool):
    """A function of a range's blocks: adds them up to a slice, answers each chunk, and sums the slice up."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        which, chunk = rows.column("slice")[0].as_py(), rows.column("chunk").to_pylist()
        own = [np.cumsum(unpacked(x.as_buffer()), dtype=np.uint64) for x in rows.column("hashes")]
        hashes, of = np.unique(np.concatenate(own), return_inverse=True)
        fields = len(rows.column("sums")[0])
        total = [np.zeros(len(hashes), np.int64) for _ in range(fields)]
        at = 0
        for x, sums in zip(own, rows.column("sums"), strict=True):
            for t, s in zip(total, sums, strict=True):
                t[of[at : at + len(x)]] += unpacked(s.as_buffer()).astype(np.int64)  # a block has an n-gram once
            at += len(x)
        del of
        known = total[0] > 0
        a = total[0][known]
        stats = [*(int(np.count_nonzero(a == j)) for j in (1, 2, 3, 4)), len(a), int(a.sum()), int(total[-1].sum()) if order == 1 else 0, int(np.count_nonzero(a >= 3))]
        out = [{"order": order, "slice": which, "chunk": -1, "stats": stats}]
        if keep:
            stays = known | (total[1] > 0) if fields > 1 else known
            out[0] |= {"hashes": packed(gaps(hashes[stays])), "sums": [packed(x[stays].astype(np.uint64)) for x in total]}
        model = Slice(hashes, total)
        del hashes, total
        taken = np.zeros(len(model.hashes), bool)
        for k, x, present in zip(chunk, own, rows.column("present"), strict=True):
            at, there = model.find(x)
            mine = np.unpackbits(np.frombuffer(present.as_buffer(), np.uint8), count=len(x)).astype(bool) & there & ~taken[at]
            taken[at[mine]] = True
            out.append({"order": order, "slice": which, "chunk": k, "sums": [packed(np.where(there, s[at], 0)) for s in model.sums], "owned": np.packbits(mine).tobytes()})
        del own, model, taken
        give_back()
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return run


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.0), j) for j, x in ((1.0, 1 - 2 * y * n2 / n1), (2.0, 2 - 3 * y * n3 / n2), (3.0, 3 - 4 * y * n4 / n3)))


def scored(tokens: Tokens, model: Model, rows: pa.Table) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a chunk; rows: the chunk's answers of all orders, of which two are
    in memory at a time."""
    n = len(tokens.size)
    p = np.full(len(tokens.word), 1.0 / (model.types + 1))
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    below: tuple[np.ndarray, list[np.ndarray]] | None = None
    for k in range(1, model.order + 1):
        places, _, ending = tokens.at(k)
        sums, d = answers_of(rows, k)[0], model.discounts[k - 1]
        steps = np.array([0.0, *d])
        for first in range(0, len(places), STEP):
            at = places[first : first + STEP]
            at = at[tokens.place[at] > 0]  # a start is never predicted
            a = sums[0][ending[at]]
            if below is None:
                whole, *single = model.unigrams
                if whole:
                    p[at] = np.maximum(a - steps[np.minimum(a, 3)], 0) / whole + sum(x * y for x, y in zip(d, single, strict=True)) / whole * p[at]
                count, text = sums[-1][ending[at]], tokens.text[at]
                known += np.bincount(text[count > 0], minlength=n)
                base += np.bincount(text, weights=np.log10((count + 1) / (model.tokens + model.types + 1)), minlength=n)
                continue
            history = below[0][at - 1]
            total = below[1][1][history]
            go = np.flatnonzero(total > 0)
            at, history, total, a = at[go], history[go], total[go], a[go]
            gamma = sum(x * y[history] for x, y in zip(d, below[1][2:5], strict=True)) / total
            p[at] = np.maximum(a - steps[np.minimum(a, 3)], 0) / total + gamma * p[at]
        below = ending, sums
    del below, ending, sums, places
    for first in range(0, len(p), STEP):
        go = first + np.flatnonzero(tokens.place[first : first + STEP] > 0)
        score += np.bincount(tokens.text[go], weights=np.log10(p[go]), minlength=n)
    return {"n_tokens": tokens.size - 1, "n_known": known, "base_score": base, "score": score}


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _results(own: DataFrame, told: DataFrame, model: Model, id_col: str) -> DataFrame:
    """A row a text, from the chunks and all answers."""
    model = replace(model, slices=None)  # tasks get the numbers only
    kind = own.schema["ids"].dataType.elementType
    schema = to_arrow_schema(T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(SCORES).fields]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for chunk in left.to_pylist():
            got = scored(Tokens(chunk), model, right)
            out.append(pa.table([pa.array(chunk["ids"], schema.field(0).type), *(pa.array(got[f.name], f.type) for f in list(schema)[1:])], schema=schema))
            give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    done = own.groupBy("chunk").cogroup(told.filter(F.col("chunk") >= 0).groupBy("chunk")).applyInArrow(run, f"id {kind.simpleString()}, {SCORES}")
    return done.withColumnRenamed("id", id_col)


def _asked(own: DataFrame, order: int, highest: int, ranges: int, above: DataFrame | None) -> DataFrame:
    """The blocks that chunks send for an order; above: the answers for the order above."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                yield from blocks(chunk["chunk"], order, ranges, *counted(Tokens(chunk), order)).to_batches()

    def next_(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [blocks(c["chunk"], order, ranges, *continued(Tokens(c), order, answers_of(right, order + 1))) for c in left.to_pylist()]
        give_back()
        return pa.concat_tables(out) if out else _BLOCK.empty_table()

    columns = own.drop("ids")
    if order == highest:
        return columns.mapInArrow(trimmed(first), BLOCK)
    return columns.groupBy("chunk").cogroup(above.filter(F.col("chunk") >= 0).groupBy("chunk")).applyInArrow(next_, BLOCK)


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, order: int = ORDER, keep: bool = False, sizes: Sizes | None = None) -> tuple[Model, DataFrame]:
    """The model of the rows where ``learn`` holds (default all), and (id, n_tokens, n_known, base_score, score) of all rows.
    ``keep`` stores the model's slices; forget them with ``forgotten(model.slices)``."""
    if order < 2:
        raise ValueError("an n-gram model needs an order of two at least")
    text_batches(df.sparkSession)
    sizes = sizes or Sizes.of(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    own = chunks(df, id_col, text_col, F.lit(True) if learn is None else learn, sizes.chunk)
    # some 1 token in 6 bytes; a slice has an order's n-grams of half as many tokens as substring dedup's ranges have windows
    ranges = 1 + 2 * (sizes.chunk // 6 * own.count()) // sizes.windows
    told, discounts, unigrams, tokens, types = [], [], (0, 0, 0, 0), 0, 0
    for k in range(order, 0, -1):
        asked = _asked(own, k, order, ranges, told[-1] if told else None)
        told.append(stored(asked.groupBy("slice").applyInArrow(summed(k, k == order, keep), ANSWER), f"kneser-ney-{k}"))
        stats = told[-1].filter("chunk < 0").select(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(8))).first()
        discounts.insert(0, discounts_of(*stats[:4]))
        if k == 1:
            unigrams, tokens, types = (stats[5], stats[0], stats[1], stats[7]), stats[6], stats[4]
    every = told[0]
    for t in told[1:]:
        every = every.unionByName(t)
    slices = stored(every.filter("chunk < 0").select("order", "slice", "hashes", "sums"), "kneser-ney-model") if keep else None
    model = Model(order, ranges, tuple(discounts), unigrams, tokens, types, slices)
    out = stored(_results(own, every, model, id_col), "kneser-ney-scores")
    forgotten(own, *told)
    return model, out


def perplexity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of texts by a model that was kept: its slices are mapped by the
    tasks that the texts' n-grams are sent to."""
    if model.slices is None:
        raise ValueError("the model's slices were not kept")
    text_batches(df.sparkSession)
    sizes = sizes or Sizes.of(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    own = chunks(df, id_col, text_col, F.lit(False), sizes.chunk)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                tokens = Tokens(chunk)
                for k in range(1, model_order + 1):
                    found = tokens.grams(k)[1]
                    yield from blocks(chunk["chunk"], k, ranges, found, [], np.zeros(len(found), bool)).to_batches()

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            part = [Slice(np.cumsum(unpacked(r["hashes"]), dtype=np.uint64), [unpacked(x) for x in r["sums"]]) for r in held.to_pylist()]
            for r in asked.to_pylist():
                x = np.cumsum(unpacked(r["hashes"]), dtype=np.uint64)
                fields = 1 if r["order"] == model_order else len(SUMS) - (r["order"] > 1)
                if part:
                    at, there = part[0].find(x)
                    sums = [packed(np.where(there, s[at], 0).astype(np.uint64) if len(part[0].hashes) else np.zeros(len(x), np.uint64)) for s in part[0].sums]
                else:
                    sums = [packed(np.zeros(len(x), np.uint64))] * fields
                out.append({"order": r["order"], "slice": r["slice"], "chunk": r["chunk"], "sums": sums, "owned": np.packbits(np.zeros(len(x), bool)).tobytes()})
        return pa.Table.from_pylist(out, schema=_ANSWER)

    model_order, ranges = model.order, model.ranges
    asked = own.drop("ids").mapInArrow(trimmed(ask), BLOCK)
    told = asked.groupBy("order", "slice").cogroup(model.slices.groupBy("order", "slice")).applyInArrow(answer, ANSWER)
    out = _results(own, told, model, id_col)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the probability of every document; scores to six digits."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out_of = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    model, found = learned(docs, learn=~out_of)
    rounded = lambda c: F.round(F.col(c), 6).alias(c)
    return found.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), rounded("base_score"), rounded("score"))


def _discount_sql(name: str, a: str) -> str:
    ns = ", ".join(f"(count(*) FILTER ({a} = {j}))::DOUBLE AS c{j}" for j in (1, 2, 3, 4))
    clamp = lambda j, x, y: f"least(greatest({j} - {j + 1} * (c1 / (c1 + 2 * c2)) * {y} / {x}, 0), {j})"
    return f"(SELECT {', '.join(f'CASE WHEN least(c1, c2, c3, c4) > 0 THEN {clamp(j, f'c{j}', f'c{j + 1}')} ELSE {j / 2} END AS d{j}' for j in (1, 2, 3))} FROM (SELECT {ns} FROM {name}))"


def _alpha(a: str) -> str:
    return f"greatest(coalesce({a}.a, 0) - CASE coalesce({a}.a, 0) WHEN 0 THEN 0 WHEN 1 THEN d{a}.d1 WHEN 2 THEN d{a}.d2 ELSE d{a}.d3 END, 0)"


def _sql() -> str:
    from .spelling_variants import CRC_SQL, crc_sql

    history = lambda a: "sum(a)::DOUBLE AS total, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2, count(*) FILTER (a >= 3) AS n3"
    return rf"""
WITH {CRC_SQL},
d AS (SELECT doc_id, {crc_sql("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_concat([' s'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' e']) AS q FROM documents, crc_table),
g AS MATERIALIZED (SELECT doc_id, held_out, i, q[i] AS w, q[i - 1] AS h1, CASE WHEN i > 2 THEN q[i - 2] END AS h2 FROM (SELECT *, unnest(range(2, len(q) + 1)) AS i FROM d)),
c1 AS MATERIALIZED (SELECT w, count(*) AS n FROM g WHERE NOT held_out GROUP BY 1),
a3 AS MATERIALIZED (SELECT h2, h1, w, count(*) AS a FROM g WHERE NOT held_out AND h2 IS NOT NULL GROUP BY 1, 2, 3),
a2 AS MATERIALIZED (SELECT h1, w, count(*) AS a FROM a3 GROUP BY 1, 2 UNION ALL SELECT h1, w, count(*) FROM g WHERE NOT held_out AND h2 IS NULL GROUP BY 1, 2),
a1 AS MATERIALIZED (SELECT w, count(*) AS a FROM a2 GROUP BY 1),
k2 AS (SELECT h2, h1, {history("a3")} FROM a3 GROUP BY 1, 2),
k1 AS (SELECT h1, {history("a2")} FROM a2 GROUP BY 1),
k0 AS (SELECT {history("a1")}, count(*) AS v FROM a1),
n AS (SELECT sum(n) AS n FROM c1),
p1 AS (SELECT g.*, c1.n AS c, n.n AS train, k0.v AS v, {_alpha("a1")} / k0.total + (da1.d1 * k0.n1 + da1.d2 * k0.n2 + da1.d3 * k0.n3) / k0.total / (k0.v + 1) AS p
  FROM g LEFT JOIN a1 ON a1.w = g.w LEFT JOIN c1 ON c1.w = g.w, k0, n, {_discount_sql("a1", "a")} da1),
p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN k1.total > 0 THEN {_alpha("a2")} / k1.total + (da2.d1 * k1.n1 + da2.d2 * k1.n2 + da2.d3 * k1.n3) / k1.total * p ELSE p END AS p
  FROM p1 LEFT JOIN a2 ON a2.h1 = p1.h1 AND a2.w = p1.w LEFT JOIN k1 ON k1.h1 = p1.h1, {_discount_sql("a2", "a")} da2),
p3 AS (SELECT p2.* EXCLUDE (p), CASE WHEN k2.total > 0 THEN {_alpha("a3")} / k2.total + (da3.d1 * k2.n1 + da3.d2 * k2.n2 + da3.d3 * k2.n3) / k2.total * p ELSE p END AS p
  FROM p2 LEFT JOIN a3 ON a3.h2 = p2.h2 AND a3.h1 = p2.h1 AND a3.w = p2.w LEFT JOIN k2 ON k2.h2 = p2.h2 AND k2.h1 = p2.h1, {_discount_sql("a3", "a")} da3)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(train)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (train + v + 1)::DOUBLE)), 6) AS base_score, round(sum(log10(p)), 6) AS score
FROM p3 GROUP BY doc_id
"""


SQL = _sql()
