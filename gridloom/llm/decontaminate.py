"""Benchmark decontamination by suffix arrays over the training words.

A task takes some 8 MB of training text at a time as a shard. Words that no benchmark item has can't lie in a match, so a
shard keeps only its runs of benchmark words that are at least one window long; it sorts the suffixes of what is left
(prefix doubling) and binary-searches every benchmark suffix in it, word by word, up to the window's length. The range of
equal prefixes gives all places. Each place then finds its longest verbatim match among the items' sorted suffixes: a binary
search that compares by common prefixes, which hashes of 1, 2, 4, ... words give in a few steps, so a match of n words costs
n log n.

Words are told apart by hashes, but a match is of words: the bytes of every word of a run are compared with those of the
benchmark's word before the search, and the benchmark's own words have unlike hashes (another hash is taken where not).

The benchmark's words go to the workers by broadcast in blocks of at most ``block_bytes`` of text, of which a worker indexes one
at a time. Up to ``BLOCKS`` blocks take one pass over the documents and nothing is written between them; a larger benchmark takes
a pass more, with what the last one found written to the shared folder, for every so many. Documents are never shuffled.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of anything beyond ASCII. A window is ``window``
consecutive words of one item; an item of fewer words, but not none, is one window.

Defined results: null and empty texts have no words and no hits; null and empty items have no windows; items that repeat an
item_id count once; words of an item without an item_id count as hit, but it is not listed; repeated documents each get
their result; other columns stay, but those with a result's name are replaced.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forgotten, freed, stored, text_batches
from .textbuf import LOWER, NOT_ALNUM, mix, per_row, pieces, same_bytes, spans_hash, texts_of, trimmed, words

WINDOW = 10
#: Bytes of item text that are in a worker's memory at a time (with their index some 40 times that), and such blocks that are
#: broadcast in one pass over the documents.
BLOCK_BYTES, BLOCKS = 8 << 20, 16
SHARD_BYTES = 8 << 20
#: What a document gets.
OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hits", T.BinaryType()),
    ]
)


class Words:
    """The words of a string column: their bytes, hashes and rows."""

    def __init__(self, column: pa.Array, salt: int = 0):
        buf, off = texts_of(column)
        self.buf = LOWER[buf]
        self.start, end, self.row = words(self.buf, off, NOT_ALNUM)
        self.size = end - self.start
        self.hash = spans_hash(self.buf, self.start, end, salt)


class Items:
    """A block of benchmark items: word ranks end to end, and the suffixes to search."""

    def __init__(self, names: list[str | None], texts: list[str | None], window: int):
        column = pa.array(texts, pa.string())
        for self.salt in (0, 1):
            own = Words(column, self.salt)
            self.vocabulary, first, rank = np.unique(own.hash, return_index=True, return_inverse=True)
            self.buf, self.start, self.bytes = own.buf, own.start[first], own.size[first]
            if self.same(rank, own, np.arange(len(rank))).all():
                break
        else:
            raise ValueError("unlike words of the benchmark share both hashes")
        row = own.row
        size = np.bincount(row, minlength=len(names))
        self.names, self.window = names, window
        self.word, self.item = rank + 1, row
        ends = np.cumsum(size)
        self.left = ends[row] - np.arange(len(row))  # words from here to the item's end
        need = np.minimum(size[row], window)
        self.need = np.where(self.left >= need, need, 0)  # the window's length, 0 where none starts
        self.least = int(need.min()) if len(need) else 0
        self.deepest = int(need.max()) if len(need) else 0
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        # the items end to end, a number beyond all ranks after each; sorted suffixes for the longest matches
        self.seq = np.full(len(row) + len(names), len(self.vocabulary) + 1)
        self.seq[np.arange(len(row)) + row] = self.word
        self.order = suffix_array(self.seq, int(size.max()) if len(size) else 0)
        self.prefixes = prefix_hashes(self.seq, int(size.max()) if len(size) else 0)

    def same(self, rank: np.ndarray, own: Words, at: np.ndarray) -> np.ndarray:
        """Whether words (indexes of own) have the bytes of the vocabulary's words."""
        out = self.bytes[rank] == own.size[at]
        go = np.flatnonzero(out)
        out[go] = same_bytes(self.buf, self.start[rank[go]], own.buf, own.start[at[go]], own.size[at[go]])
        return out

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank from 1 of each word, 0 for words whose hash no item's word has."""
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        out[at] = np.where(self.vocabulary[found] == h[at], found + 1, 0)
        return out

    def runs(self, own: Words) -> tuple[np.ndarray, np.ndarray]:
        """The runs of benchmark words, by their bytes."""
        rank = self.ranks(own.hash)
        seq, place = runs(rank, own.row, self.least)
        at = place[place >= 0]
        unlike = at[~self.same(rank[at] - 1, own, at)] if len(at) else at
        if len(unlike):
            rank[unlike] = 0
            seq, place = runs(rank, own.row, self.least)
        return seq, place

    def longest(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words of the longest match of an item with seq from each of ``at``."""
        own = prefix_hashes(seq, 1 << max(0, len(self.prefixes) - 1))
        lo, hi, best = np.zeros(len(at), np.int64), np.full(len(at), len(self.order)), np.zeros(len(at), np.int64)
        while (go := np.flatnonzero(lo < hi)).size:  # both neighbours of the place where a suffix belongs are met on the way
            mid = (lo[go] + hi[go]) >> 1
            other = self.order[mid]
            n = common_prefix(own, at[go], self.prefixes, other)
            best[go] = np.maximum(best[go], n)
            less = self.seq[np.minimum(other + n, len(self.seq) - 1)] < seq[np.minimum(at[go] + n, len(seq) - 1)]
            lo[go] = np.where(less, mid + 1, lo[go])
            hi[go] = np.where(less, hi[go], mid)
        return best


def prefix_hashes(seq: np.ndarray, depth: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each place, up to ``depth`` words or less; shorter at the end of seq."""
    out = [mix(seq.astype(np.uint64))]
    while 1 << len(out) <= min(depth, len(seq)):
        k = 1 << (len(out) - 1)
        then = np.zeros(len(seq), np.uint64)
        then[:-k] = out[-1][k:]
        out.append(mix(out[-1] * np.uint64(0xD6E8FEB86659FD93) + then, len(out)))
    return out


def common_prefix(a: list[np.ndarray], at_a: np.ndarray, b: list[np.ndarray], at_b: np.ndarray) -> np.ndarray:
    """How many words two sequences have in common from at_a and at_b on. The separators of a and b are unlike, so a common
    prefix ends before both ends."""
    n = np.zeros(len(at_a), np.int64)
    if not len(a[0]) or not len(b[0]):
        return n
    for k in range(min(len(a), len(b)) - 1, -1, -1):
        for _ in range(2 if k == min(len(a), len(b)) - 1 else 1):  # the highest level may hold twice
            i, j = at_a + n, at_b + n
            go = (i < len(a[0])) & (j < len(b[0]))
            n[go] += (a[k][i[go]] == b[k][j[go]]) * (1 << k)
    return n


def runs(rank: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of runs of ``least`` or more ranked words of a row, a 0 after each run, and each one's place (-1 at a 0)."""
    if not len(rank):
        return rank, rank
    fresh = np.ones(len(rank), bool)
    fresh[1:] = (row[1:] != row[:-1]) | ((rank[1:] > 0) != (rank[:-1] > 0))
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(rank)))
    good = (rank[begin] > 0) & (size >= least)
    begin, size = begin[good], size[good] + 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    last = np.cumsum(size) - 1
    seq = rank[np.minimum(place, len(rank) - 1)]
    seq[last], place[last] = 0, -1
    return seq, place


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of seq by their first ``depth`` words or more."""
    rank, k = seq.copy(), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        then = np.zeros_like(rank)
        then[:-k] = rank[k:] + 1
        key = rank * (rank.max() + 2) + then
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(key), np.int64)
        new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank[order] = new
        k *= 2
        if k >= len(rank) or new[-1] == len(new) - 1:
            break
    return order


def narrowed(seq: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range of suffixes whose word at ``depth`` is ``word``."""
    last = len(seq) - 1
    found = []
    for goal in (word, word + 1):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = seq[np.minimum(order[np.minimum(mid, last)] + depth, last)] < goal
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        found.append(a)
    return found[0], found[1]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indexes of the ranges, and the range each comes from."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def search(items: Items, own: Words, n: int) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Of a shard: which words are hit, the longest match of each row, and each row's items."""
    row = own.row
    hit, longest, listed = np.zeros(len(row), bool), np.zeros(n, np.int64), [[] for _ in range(n)]
    if not len(items.word) or not len(row):
        return hit, longest, listed
    seq, place = items.runs(own)
    if not len(seq):
        return hit, longest, listed
    order = suffix_array(seq, items.deepest)
    of = np.flatnonzero(items.need > 0)
    lo, hi = np.zeros(len(of), np.int64), np.full(len(of), len(seq))
    whole = np.zeros(len(row) + 1, np.int64)
    pairs, starts = [], []
    for depth in range(items.deepest):
        lo, hi = narrowed(seq, order, lo, hi, depth, items.word[of + depth])
        go = hi > lo
        of, lo, hi = of[go], lo[go], hi[go]
        if not len(of):
            break
        ends = items.need[of] == depth + 1
        if ends.any():
            ranges, back = np.unique(np.stack([lo[ends], hi[ends]], 1), axis=0, return_inverse=True)
            at, which = spread(ranges[:, 0], ranges[:, 1])
            at = order[at]
            starts.append(at)
            at = place[at]
            start = np.unique(at)
            np.add.at(whole, start, 1)
            np.add.at(whole, start + depth + 1, -1)
            seen = np.unique(np.stack([row[at], which], 1), axis=0)
            own_items = np.unique(np.stack([back.reshape(-1), items.item[of[ends]]], 1), axis=0)
            first = np.searchsorted(own_items[:, 0], seen[:, 1], side="left")
            i, k = spread(first, np.searchsorted(own_items[:, 0], seen[:, 1], side="right"))
            pairs.append(np.stack([seen[k, 0], own_items[i, 1]], 1))
            of, lo, hi = of[~ends], lo[~ends], hi[~ends]
    hit = np.cumsum(whole[:-1]) > 0
    for r, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
        if items.names[i] is not None:
            listed[r].append(items.names[i])
    if starts:
        at = np.unique(np.concatenate(starts))
        np.maximum.at(longest, row[place[at]], items.longest(seq, at))
    return hit, longest, listed


_loaded: dict[str, Items] = {}


class Found:
    """What has been found in a batch of texts so far."""

    def __init__(self, part: pa.RecordBatch, text_col: str):
        buf, off = texts_of(part.column(text_col))
        row = words(LOWER[buf], off, NOT_ALNUM)[2]
        self.size = per_row(np.ones(len(row)), row, part.num_rows)
        self.hit = np.zeros(int(self.size.sum()), bool)
        self.longest = np.zeros(part.num_rows, np.int64)
        self.listed: list[list[str]] = [[] for _ in range(part.num_rows)]
        if OUT.names[0] in part.schema.names:  # from an earlier pass
            ends = np.cumsum(self.size)
            for i, raw in enumerate(part.column("hits").to_pylist()):
                if raw:
                    self.hit[ends[i] - self.size[i] : ends[i]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.size[i]).astype(bool)
            self.longest = part.column("longest").to_numpy(zero_copy_only=False).astype(np.int64)
            self.listed = [x or [] for x in part.column("items").to_pylist()]

    def add(self, items: Items, part: pa.RecordBatch, text_col: str) -> None:
        hit, longest, listed = search(items, Words(part.column(text_col), items.salt), part.num_rows)
        self.hit |= hit
        self.longest = np.maximum(self.longest, longest)
        self.listed = [a + b if b else a for a, b in zip(self.listed, listed, strict=True)]

    def batch(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """part with OUT's columns."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        n_hit, ends = per_row(self.hit, row, len(self.size)), np.cumsum(self.size)
        bits = [np.packbits(self.hit[e - s : e]).tobytes() if c else None for e, s, c in zip(ends.tolist(), self.size.tolist(), n_hit.tolist(), strict=True)]
        new = [pa.array(self.size, pa.int64()), pa.array(n_hit), pa.array(self.longest), pa.array([sorted(set(x)) for x in self.listed], pa.list_(pa.string())), pa.array(bits, pa.binary())]
        kept = [c for c in part.schema.names if c not in OUT.names]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=[*kept, *OUT.names])


def _pass(df: DataFrame, held: list, text_col: str, window: int) -> DataFrame:
    """df with OUT's columns brought up to date by some blocks of items. With one block texts are only streamed. With more, a
    task keeps its batches in a file of its own without a name, and goes over it once a block; one block's index is in memory."""
    key = uuid.uuid4().hex

    def items_of(block) -> Items:
        return Items(*pickle.loads(zlib.decompress(block.value)), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in pieces(batch, text_col, SHARD_BYTES))
        if len(held) == 1:
            if key not in _loaded:
                _loaded.clear()
                _loaded[key] = items_of(held[0])
            for part in parts:
                found = Found(part, text_col)
                found.add(_loaded[key], part, text_col)
                yield found.batch(part)
            return
        with tempfile.TemporaryFile() as spool:
            writer, found = None, []
            for part in parts:
                writer = writer or pa.ipc.new_file(spool, part.schema)
                writer.write_batch(part)
                found.append(Found(part, text_col))
            if writer is None:
                return
            writer.close()
            _loaded.clear()
            with pa.ipc.open_file(pa.PythonFile(spool, "r")) as kept:
                for block in held:
                    items = items_of(block)
                    for i, x in enumerate(found):
                        x.add(items, kept.get_batch(i), text_col)
                    del items
                for i, x in enumerate(found):
                    yield x.batch(kept.get_batch(i))

    fields = [f for f in df.schema.fields if f.name not in OUT.names]
    return df.mapInArrow(trimmed(run), T.StructType([*fields, *OUT.fields]))


def find_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words in windows of items), longest (words of the longest verbatim match; 0 without a
    hit), items (ids of the items with such windows, sorted) and hits (a bit for each word; null without any)."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("item_text")).filter(F.length("item_text") > 0)
    size = own.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    text_batches(spark)
    found = freed(docs, OUT.names, text_col)
    for first in range(0, blocks, BLOCKS):
        held = []
        for k in range(first, min(first + BLOCKS, blocks)):
            block = own.filter(F.pmod(F.xxhash64("name", "item_text"), F.lit(blocks)) == k) if blocks > 1 else own
            rows = block.collect()  # one block at a time is on the driver
            held.append(spark.sparkContext.broadcast(zlib.compress(pickle.dumps(([r.name for r in rows], [r.item_text for r in rows])), 1)))
            del rows
        before, found = found, _pass(found, held, text_col, window)
        if first + BLOCKS < blocks:
            found = stored(found, "decontaminate")
            forgotten(before)
            for h in held:
                h.unpersist()
    return found


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any window of an item; columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    marked = find_matches(plain, items, text_col=names[docs.columns.index("text")])
    return marked.filter("n_hit = 0").select(names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: words of each document that verbatim matches with benchmark items hit."""
    found = find_matches(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

