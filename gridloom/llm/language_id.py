"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; everything but letters becomes a space and spaces in a row count once. Character sequences of
``ORDER`` are counted per language over all learning texts but an eighth; each task sums up its own, Spark adds them. From
these counts come, per language, the discounted counts and the back-off weights of all orders.
Counts of up to ``BROADCAST`` bytes become sorted arrays on the driver, which go to the tasks, where sequences are searched in
them. Larger ones stay where they are, in tables that Spark groups: texts are packed into blocks; the distinct sequences of all blocks get their probabilities in each language by joins,
order by order; each block asks the ranges of sequences for its own, and the answers are joined to its texts. Both ways give
the same probabilities. The language of the lowest cross-entropy per character wins. The eighth that was held back calibrates rejection: a text is rejected if its
cross-entropy, less what chance gives a text of its length, lies above nearly all of its language's texts there by ``SLACK``.

No sequence and no language is left out. A sequence holds 16 bits a character: letters beyond the first 65,536 code points share 8,448 codes that no
letter has, so two of these count as one where their numbers are equal modulo 8,448, and none counts as a common letter.

Defined results: null texts and texts without a letter get ``und``, score 0 and are rejected; ties go to the language that
sorts first; without any learning text all are ``und``, and ``kept`` keeps all, as nothing is known; a language without any text
held back rejects nothing; repeated rows each get their result; other columns stay, but those with a result's name are
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, documents, forgotten, freed, parallelism, stored, text_batches
from .textbuf import mix, pieces, trimmed

ORDER = 4
#: Bytes of the sorted arrays of all models together that are broadcast (at most 160 for each sequence of a language), and of
#: the blocks' rows that a task takes together.
BROADCAST, TASK = 64 << 20, 64 << 20
#: A block of texts ends beyond so many bytes, or about so many distinct sequences.
BLOCK, KINDS = 16 << 20, 1_000_000
RESULTS = ("lang_pred", "score", "cross_entropy", "rejected")
#: Rejection: the share of learning texts that may lie above, nats beyond them, and nats times the root of the length.
QUANTILE, SLACK, CHANCE = 0.999, 1.0, 3.0
#: Of so many learning texts one calibrates rejection.
HELD_BACK = 8
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER`` characters at each character of the texts, 16 bits each, and the row of each. A text starts after
    spaces; texts without letters have none."""
    raw = np.frombuffer("".join(f"   {(t or '').lower()} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len((t or "").lower()) + 4 for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    letter = _is_letter()[raw]
    c = np.where(letter, np.where(raw > 0xFFFF, 0xD800 + raw % 0x2100, raw), 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of spaces in a row the first
    c, row = np.concatenate([np.full(3, 32, np.uint64), c[keep]]), row[keep]
    out = (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(fresh)
    for k in range(3):  # nothing of the text before
        at = begin + k
        at = at[(at < len(row))]
        at = at[row[at] == row[begin[: len(at)]]] if len(at) else at
        spaces = sum(32 << (16 * j) for j in range(k + 1, 4))
        out[at] = (out[at] & np.uint64((1 << (16 * (k + 1))) - 1)) | np.uint64(spaces)
    return out, row


def count_sequences(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, seq, n) over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            seq, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            return seq, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                seq, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seq), pa.string()), pa.array(seq.view(np.int64)), pa.array(n)], names=["lang", "seq", "n"])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                seq, row = sequences(part.column("text").to_pylist())
                lang = np.array(part.column("lang").to_pylist(), object)
                for x in set(lang.tolist()):
                    one = np.unique(seq[(lang == x)[row]], return_counts=True)
                    held.setdefault(x, []).append(one)
                    size += len(one[0])
                if size > 2_000_000:
                    held = {x: [merged(v)] for x, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1_000_000:
                        yield from sent()
                        held, size = {}, 0
        yield from sent()

    own = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    return own.mapInArrow(trimmed(run), "lang string, seq long, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))


def _low(seq: Column, order: int) -> Column:
    """The last ``order`` characters."""
    return seq if order == ORDER else seq.bitwiseAND((1 << (16 * order)) - 1)


def _each(values: list[float], k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(x)) for x in values)), k + 1)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


class Arrays:
    """The models as sorted arrays: for each language and each order from 1 the sequences with their discounted counts, and the
    contexts with their totals and what is left to the back-off; and the probability below order 1."""

    def __init__(self, k: np.ndarray, seq: np.ndarray, n: np.ndarray, langs: int):
        self.floors: list[float] = []
        self.models: list[list[tuple[np.ndarray, ...]]] = []
        for i in range(langs):
            own, times, orders = seq[k == i], n[k == i], []
            for order in range(ORDER, 0, -1):
                at = np.argsort(own, kind="stable")
                own, times = own[at], times[at]
                off = _discount(int((times == 1).sum()), int((times == 2).sum()))
                context, begin = np.unique(own >> np.uint64(16), return_index=True)
                kinds = np.diff(np.append(begin, len(own)))
                orders.insert(0, (own, times - np.minimum(times, off), context, np.add.reduceat(times, begin).astype(float), off * kinds))
                floor = 1.0 / (len(own) + 1)
                if order > 1:  # lower orders count the characters that come before
                    own, times = np.unique(own & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
            self.models.append(orders)
            self.floors.append(floor)

    def log_probabilities(self, seqs: np.ndarray) -> np.ndarray:
        """Of every language (sequences x languages)."""
        out = np.empty((len(seqs), len(self.floors)), np.float32)
        for k, (orders, floor) in enumerate(zip(self.models, self.floors, strict=True)):
            p = np.full(len(seqs), floor)
            for order, (keys, n, contexts, total, off) in enumerate(orders, 1):
                own = seqs & np.uint64((1 << (16 * order)) - 1)
                i, known = self._find(keys, own)
                j, has = self._find(contexts, own >> np.uint64(16))
                p = np.where(has, (np.where(known, n[i], 0.0) + off[j] * p) / total[j], p)
            out[:, k] = np.log(p)
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


class Memo:
    """Log probabilities of the sequences that a task has met, at most ``KINDS`` of them."""

    def __init__(self, arrays: Arrays):
        self.arrays, self.seqs = arrays, np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(arrays.floors)), np.float32)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        """own: sorted distinct sequences."""
        at = np.minimum(np.searchsorted(self.seqs, own), max(0, len(self.seqs) - 1))
        new = own[self.seqs[at] != own] if len(self.seqs) else own
        if len(new):
            if len(self.seqs) + len(new) > KINDS:
                self.seqs, self.values, new = self.seqs[:0], self.values[:0], own
            both = np.concatenate([self.seqs, new])
            order = np.argsort(both, kind="stable")
            self.seqs, self.values = both[order], np.concatenate([self.values, self.arrays.log_probabilities(new)])[order]
        return self.values[np.searchsorted(self.seqs, own)]


@dataclass
class Model:
    """Languages in order of name, and the cross-entropy above which a text is rejected in each. The models themselves are sorted
    arrays, or else for each order from 1 the tables (k, seq, own) of discounted counts and (k, context, total, off) of what they
    are divided by and what is left to the back-off, k being the language's place, and the probability below order 1; ``stored_``:
    the written tables that these read."""

    langs: list[str]
    arrays: Arrays | None = None
    orders: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    floors: list[float] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)
    stored_: list[DataFrame] = field(default_factory=list)


def build(counts: DataFrame, broadcast: int | None = None) -> Model:
    """The models from all of (lang, seq, n)."""
    counts = stored(counts, "language-counts")
    kinds = {r.lang: r["count"] for r in counts.groupBy("lang").count().collect()}  # a row a language
    model = Model(sorted(kinds), stored_=[counts])
    if not model.langs:
        return model
    now = counts.select((F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")) - 1).cast("int").alias("k"), "seq", "n")
    if sum(kinds.values()) * 160 <= (BROADCAST if broadcast is None else broadcast):
        table = now.toArrow()
        model.arrays = Arrays(table.column("k").to_numpy(), table.column("seq").to_numpy().view(np.uint64), table.column("n").to_numpy(), len(model.langs))
        return model
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # lower orders count the characters that come before
            now = stored(now.groupBy("k", _low(F.col("seq"), order).alias("seq")).agg(F.count("*").alias("n")), "language-counts")
            model.stored_.append(now)
        few = {r.k: r for r in now.groupBy("k").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count("*").alias("kinds")).collect()}  # a row a language
        few = [few[k] for k in range(len(model.langs))]
        off = _each([_discount(r.once, r.twice) for r in few], F.col("k"))
        seen = now.select("k", "seq", (F.col("n") - F.least(F.col("n").cast("double"), off)).alias("own"))
        context = now.groupBy("k", F.shiftrightunsigned("seq", 16).alias("context")).agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("kinds"))
        model.orders.insert(0, (seen, context.select("k", "context", "total", (off * F.col("kinds")).alias("off"))))
        model.floors = [1.0 / (r.kinds + 1) for r in few]
    return model


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """df in written blocks: (block, seqs, rows), with the sorted distinct sequences and the compressed rows."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            seqs = np.unique(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([seqs.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "seqs", "rows"])

        for batch in batches:
            for part in pieces(batch, text_col, 1 << 19):
                found.append(np.unique(sequences(part.column(text_col).to_pylist())[0]))
                held.append(part)
                size += part.nbytes
                if size > BLOCK or sum(map(len, found)) > KINDS:
                    found = [np.unique(np.concatenate(found))]
                    if size > BLOCK or len(found[0]) > KINDS // 2:
                        yield sent()
                        held, found, size = [], [], 0
        if held:
            yield sent()

    return stored(df.mapInArrow(trimmed(run), "block long, seqs binary, rows binary"), "language-blocks")


def probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """(k, seq, p) of every language for each of wanted (seq)."""
    lower = None
    for order, (seen, context) in enumerate(model.orders, 1):
        asked = wanted.select(_low(F.col("seq"), order).alias("seq")).distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(len(model.langs) - 1))).alias("k"))
        asked = asked.withColumn("context", F.shiftrightunsigned("seq", 16)).join(seen, ["k", "seq"], "left").join(context, ["k", "context"], "left")
        if lower is None:
            asked = asked.withColumn("less", _each(model.floors, F.col("k")))
        else:
            asked = asked.withColumn("lower", _low(F.col("seq"), order - 1)).join(lower.select("k", F.col("seq").alias("lower"), F.col("p").alias("less")), ["k", "lower"])
        p = F.when(F.col("total").isNull(), F.col("less")).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("off") * F.col("less")) / F.col("total"))
        before, lower = lower, stored(asked.select("k", "seq", p.alias("p")), "language-probabilities")
        if before is not None:
            forgotten(before)
    return lower


def _ranges(least: int) -> int:
    """The first prime from ``least`` on that deals sequences evenly as a divisor: one by which 2**16 has no short period."""
    n = max(61, least)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)) or n in (257, 65537):
        n += 1
    return n


def answered(blocks: DataFrame, model: Model) -> tuple[DataFrame, int]:
    """(block, part, values): the log probabilities (sequences x languages) of a block's sequences in each range of sequences;
    and how many ranges there are."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for raw in batch.column("seqs"):
                held.append(np.frombuffer(raw.as_buffer(), np.int64))
                if sum(map(len, held)) > 2_000_000:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0])], names=["seq"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["seq"])

    wanted = stored(blocks.select("seqs").mapInArrow(trimmed(distinct), "seq long").distinct(), "language-sequences")
    asked = blocks.agg(F.sum(F.length("seqs") / 8)).first()[0] or 0
    langs = len(model.langs)
    ranges = _ranges(int(max(wanted.count() * langs / 500_000, asked * langs / 4_000_000)))
    table = probabilities(wanted, model)
    known = table.select(F.pmod("seq", F.lit(ranges)).cast("int").alias("part"), "k", "seq", F.log("p").cast("float").alias("p"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("seqs"), strict=True):
                seqs = np.frombuffer(raw.as_buffer(), np.int64)
                part = seqs % ranges
                at = np.argsort(part, kind="stable")
                own, begin = np.unique(part[at], return_index=True)
                data = [x.tobytes() for x in np.split(seqs[at], begin[1:])] if len(seqs) else []
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "seqs"])

    def looked_up(ours: pa.Table, asks: pa.Table) -> pa.Table:
        at = np.lexsort((ours.column("k").to_numpy(), ours.column("seq").to_numpy()))
        seqs = ours.column("seq").to_numpy()[at][::langs]
        values = ours.column("p").to_numpy()[at].reshape(-1, langs)
        out = [values[np.searchsorted(seqs, np.frombuffer(x.as_buffer(), np.int64))].tobytes() for x in asks.column("seqs")]
        return pa.table([asks.column("block"), asks.column("part"), pa.array(out, pa.binary())], names=["block", "part", "values"])

    requests = blocks.select("block", "seqs").mapInArrow(trimmed(dealt), "block long, part int, seqs binary")
    out = known.groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(looked_up, "block long, part int, values binary")
    out = stored(out, "language-answers")
    forgotten(wanted, table)
    return out, ranges


@dataclass
class Judge:
    """Gives rows of ``schema`` their lang_pred, score, cross_entropy (null for und), rejected and letters, each name after
    ``prefix``; ``drop``: without the text."""

    langs: list[str]
    limits: list[float]
    schema: T.StructType
    text_col: str
    prefix: str
    drop: bool

    def __post_init__(self):
        self.rest = [x for x in self.schema.fields if not (self.drop and x.name == self.text_col)]
        self.names = [f"{self.prefix}{x}" for x in (*RESULTS, "letters")]
        kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.LongType()]
        self.out = T.StructType([*self.rest, *(T.StructField(a, b) for a, b in zip(self.names, kinds, strict=True))])

    def __call__(self, rows: pa.RecordBatch, lookup: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """``lookup``: log probabilities (sequences x languages) of sorted distinct sequences."""
        for piece in pieces(rows, self.text_col, 1 << 19):
            yield self.judged(piece, lookup)

    def judged(self, part: pa.RecordBatch, lookup: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        langs, limits = self.langs, np.array(self.limits or [np.inf] * len(self.langs))
        seq, row = sequences(part.column(self.text_col).to_pylist())
        n = np.bincount(row, minlength=part.num_rows)
        own, at = np.unique(seq, return_inverse=True)
        own = lookup(own).astype(np.float64)
        entropy = np.full((part.num_rows, len(langs)), np.inf)
        for k in range(len(langs)):
            np.divide(np.bincount(row, weights=-own[:, k][at], minlength=part.num_rows), n, out=entropy[:, k], where=n > 0)
        good, best = n > 0, np.argmin(entropy, 1)
        low = np.where(good, entropy[np.arange(len(n)), best], np.nan)
        gap = np.where(good[:, None], low[:, None] - np.where(good[:, None], entropy, 0), 0)
        score = np.where(good, 1 / np.exp(gap * np.minimum(n, 40)[:, None]).sum(1), 0.0)
        over = ~good | (low - CHANCE / np.sqrt(np.maximum(n, 1)) > limits[best])
        pred = [langs[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist(), strict=True)]
        new = [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(low, from_pandas=True), pa.array(over), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*(part.column(x.name) for x in self.rest), *new], names=[*(x.name for x in self.rest), *self.names])


def in_blocks(df: DataFrame, model: Model, judge: Judge) -> DataFrame:
    """df judged with a model of any size."""
    blocks = packed(df, judge.text_col)
    table, ranges = answered(blocks, model)
    langs = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seqs = np.frombuffer(batch.column("seqs")[i].as_buffer(), np.uint64)
                values = np.zeros((len(seqs), langs), np.float32)
                part = seqs.view(np.int64) % ranges
                by_part = np.argsort(part, kind="stable")
                border = np.searchsorted(part[by_part], np.arange(ranges + 1))
                for answer in batch.column("answers")[i].values if batch.column("answers")[i].is_valid else ():
                    own = by_part[border[answer["part"].as_py()] : border[answer["part"].as_py() + 1]]
                    values[own] = np.frombuffer(answer["values"].as_buffer(), np.float32).reshape(-1, langs)
                lookup = lambda own, seqs=seqs, values=values: values[np.searchsorted(seqs, own)]
                for rows in pa.ipc.open_stream(batch.column("rows")[i].as_buffer()):
                    yield from judge(rows, lookup)

    size = blocks.agg(F.coalesce(F.sum(F.length("rows")), F.lit(0))).first()[0]
    n = max(parallelism(df.sparkSession), 1 + size // TASK)
    lists = table.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("part", "values")).alias("answers"))
    joined = blocks.repartition(n, "block").join(lists, "block", "left").select("seqs", "rows", "answers")
    return joined.mapInArrow(trimmed(run), judge.out)


def found(df: DataFrame, model: Model, text_col: str, prefix: str = "", drop: bool = False) -> DataFrame:
    """df with lang_pred, score, cross_entropy (null for und), rejected and letters, each name after ``prefix``; ``drop``: without
    the text."""
    judge = Judge(model.langs, model.limits, df.schema, text_col, prefix, drop)
    if model.arrays is None:
        return in_blocks(df, model, judge)
    held = df.sparkSession.sparkContext.broadcast(model.arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(held.value)
        for batch in batches:
            yield from judge(batch, memo)

    return df.mapInArrow(trimmed(run), judge.out)


def scored(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df with lang_pred, score, cross_entropy (null for und) and rejected, each name after ``prefix``."""
    names = [f"{prefix}{x}" for x in RESULTS]
    df = freed(df, names, text_col)
    if not model.langs:
        return df.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double"), F.lit(True)), strict=True)))
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}  # results get no name of theirs
    out = found(df.toDF(*place.values()), model, place[text_col], "__")
    return out.select(*(F.col(x).alias(c) for c, x in place.items()), *(F.col(f"__{x}").alias(n) for x, n in zip(RESULTS, names, strict=True)))


def _limits(known: DataFrame, langs: list[str]) -> list[float]:
    """known: (__lang_pred, __cross_entropy, size) of the learning texts."""
    less = F.col("__cross_entropy") - CHANCE / F.sqrt(F.greatest("size", F.lit(1)))
    own = known.filter("__cross_entropy is not null").groupBy("__lang_pred").agg(F.percentile_approx(less, QUANTILE, 10_000).alias("limit"))
    limits = {r[0]: r.limit + SLACK for r in own.collect()}  # a row a language
    return [limits.get(x, float("inf")) for x in langs]


def counts_in_models(text: Column) -> Column:
    """Whether a learning text is counted; the others calibrate rejection."""
    return F.pmod(F.xxhash64(text, F.lit("held back")), F.lit(HELD_BACK)) != 0


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models and limits from all rows with a text and a language."""
    text_batches(df.sparkSession)
    own = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    model = build(count_sequences(own.filter(counts_in_models(F.col("text"))), "text", "lang"))
    if model.langs:
        rows = own.filter(~counts_in_models(F.col("text"))).select("text", F.length("text").alias("size"))
        model.limits = _limits(found(rows, model, "text", "__", drop=True), model.langs)
    return model


def learns(id_col: Column) -> Column:
    """The documents that may be learnt from; one without an id may."""
    return F.coalesce(crc_mod(id_col, 3), F.lit(0)) != 1


def _known(docs: DataFrame, text_col: str, lang_col: str, learning: Column, drop: bool) -> tuple[Model, DataFrame] | None:
    """The model, and all rows' results (with the text unless ``drop``), judged once; the rows get ``learning`` (2 for texts
    that are counted, 1 for those held back, else 0) and ``size``."""
    part = F.when(learning & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull(), F.when(counts_in_models(F.col(text_col)), 2).otherwise(1)).otherwise(0)
    own = docs.withColumns({"learning": part, "size": F.length(text_col)})
    text_batches(docs.sparkSession)
    model = build(count_sequences(own.filter("learning = 2"), text_col, lang_col))
    if not model.langs:
        return None
    results = stored(found(own, model, text_col, "__", drop), "language-results")
    forgotten(*model.stored_)
    model.limits = _limits(results.filter("learning = 1"), model.langs)
    return model, results


def _over(model: Model) -> Column:
    """Whether a row of results is rejected."""
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in zip(model.langs, model.limits, strict=True) for x in pair)), F.col("__lang_pred"))
    return F.col("__cross_entropy").isNull() | (F.col("__cross_entropy") - CHANCE / F.sqrt(F.greatest("__letters", F.lit(1))) > limit)


def kept(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected; learnt from those that may be learnt from; columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: names[i] for i, c in enumerate(docs.columns)}
    known = _known(docs.toDF(*names), place["text"], place["lang"], learns(F.col(place["doc_id"])), drop=False)
    if known is None:
        return docs
    model, results = known
    return results.filter(~_over(model)).select(names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    known = _known(docs, "text", "lang", learns(F.col("doc_id")), drop=True)
    if known is None:
        out = scored(docs, Model([]))
    else:
        model, results = known
        out = results.select("doc_id", *(F.col(f"__{x}").alias(x) for x in RESULTS[:3]), _over(model).alias("rejected"))
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), *RESULTS)
