"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over the byte positions of a piece holds, at every
node, the lowest pair rank below it and, among equals, the leftmost position, packed as ``rank * width + position``. The
root names the next merge; a merge changes three leaves (the pair, the neighbour before it and the position that is gone)
and their paths to the root. Pieces of up to 64 bytes go through the trees in numpy, as many as a batch has new ones;
longer pieces take one tree each, so a piece of n bytes costs n log n.

Defined results: null text and empty text give no ids and decode to empty bytes; repeated rows each get their result;
other columns of the input stay as they are, but one that has the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freed, text_batches
from .textbuf import pieces, trimmed

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps, of at most so many characters; it starts anew when there are more.
CACHE, LONGEST = 150_000, 256
#: Bytes of text that a worker encodes, and ids that it decodes, at a time.
TEXT, IDS = 1 << 20, 1 << 18
_GONE = np.int32(2**31 - 1)


class ByteBpe:
    """Ranks of a public byte-level vocabulary. ``ids_of`` gives pieces' ids as little-endian int32 bytes."""

    def __init__(self, rank_lines: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pair = {(ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(pair), np.int64)
        self.pair_ranks = np.array([pair[k] for k in self.pair_keys.tolist()], np.int32)
        last = max(ranks.values()) + 1
        self.lengths, parts = np.zeros(last, np.int64), [b""] * last
        for t, r in ranks.items():
            parts[r], self.lengths[r] = t, len(t)
        self.vocabulary = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _GONE where they do not merge."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _GONE)

    def merge_many(self, texts: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes (a power of two up to 64), one tree a row."""
        n, bits = len(texts), width.bit_length() - 1
        size = np.array([len(x) for x in texts])
        ids = np.zeros((n, width + 1), np.int64)
        ids[:, :width] = self.first[np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(n, width)]
        place = np.arange(width + 1)
        after = np.broadcast_to(place + 1, (n, width + 1)).copy()
        after[place + 1 >= size[:, None]] = width
        before = np.broadcast_to(place - 1, (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _GONE, np.int32)
        pair = self.rank(ids[:, : width - 1], ids[:, 1:width])
        pair[place[1:width] >= size[:, None]] = _GONE
        tree[:, width : 2 * width - 1] = np.where(pair == _GONE, _GONE, (pair << bits) | place[: width - 1].astype(np.int32))
        node = width
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        alive = np.ones((n, width + 1), bool)
        alive[place >= size[:, None]] = False
        row = np.flatnonzero(tree[:, 1] != _GONE)
        while len(row):
            top = tree[row, 1].astype(np.int64)
            at, merged = top & (width - 1), top >> bits
            gone = after[row, at]
            then, prior = after[row, gone], before[row, at]
            ids[row, at] = merged
            alive[row, gone] = False
            after[row, at] = then
            before[row, then] = at
            right = np.where(then < width, self.rank(merged, ids[row, then]), _GONE)
            left = np.where(prior >= 0, self.rank(ids[row, prior], merged), _GONE)
            prior = np.where(prior >= 0, prior, gone)  # no neighbour before: the leaf that is gone is written again
            leaves = np.stack([gone, prior, at])
            tree[row, width + gone] = _GONE
            tree[row, width + prior] = np.where(left == _GONE, _GONE, (left.astype(np.int64) << bits) | prior)
            tree[row, width + at] = np.where(right == _GONE, _GONE, (right.astype(np.int64) << bits) | at)
            node = (leaves + width) >> 1
            for _ in range(bits):
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1
            row = row[tree[row, 1] != _GONE]
        flat, count = ids[alive].astype("<i4").tobytes(), alive.sum(1) * 4
        ends = np.cumsum(count)
        return [flat[e - c : e] for e, c in zip(ends.tolist(), count.tolist(), strict=True)]

    def merge_one(self, text: bytes) -> bytes:
        """Ids of one long piece."""
        n = len(text)
        width = 1 << max(1, (n - 1).bit_length())
        gone = 1 << 62
        ids = self.first[np.frombuffer(text, np.uint8)]
        pair = self.rank(ids[:-1], ids[1:]).astype(np.int64)
        leaf = np.full(width, gone, np.int64)
        leaf[: n - 1] = np.where(pair == _GONE, gone, pair * width + np.arange(n - 1))
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [gone, *chain.from_iterable(x.tolist() for x in reversed(levels))]
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                at >>= 1
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low

        def pair_at(a: int, b: int) -> int:
            if a < 0 or b >= n:
                return gone
            key = (ids[a] << 20) | ids[b]
            found = min(int(np.searchsorted(self.pair_keys, key)), len(self.pair_keys) - 1)
            return int(self.pair_ranks[found]) * width + a if self.pair_keys[found] == key else gone

        while tree[1] != gone:
            merged, at = divmod(tree[1], width)
            dead = after[at]
            ids[at], ids[dead], after[at] = merged, -1, after[dead]
            before[after[at]] = at
            put(dead, gone)
            put(at, pair_at(at, after[at]))
            if before[at] >= 0:
                put(before[at], pair_at(before[at], at))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def learn(self, new: Iterable[str]) -> None:
        """Encodes pieces and keeps their ids."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = int(whole).to_bytes(4, "little")
            elif len(raw) > 64:
                self.cache[piece] = self.merge_one(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, found in by_width.items():
            for i in range(0, len(found), 8192):
                part = found[i : i + 8192]
                self.cache.update(zip((x for x, _ in part), self.merge_many([x for _, x in part], width), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = [self.split.findall(x) for x in texts]
        new = set(chain.from_iterable(found)).difference(self.cache)
        self.learn(new)
        out = [b"".join(map(self.cache.__getitem__, x)) for x in found]
        for piece in new:
            if len(piece) > LONGEST:
                del self.cache[piece]
        return out

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids; ``off`` are the rows' borders in ids."""
        length = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], length)
        flat, cut = self.vocabulary[at].tobytes(), ends[off].tolist()
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_loaded: dict[tuple, ByteBpe] = {}


def _codec(held, pattern: str) -> ByteBpe:
    """The worker's codec; built once from the broadcast rank file (under 1 MB)."""
    key = (hashlib.sha256(held.value).digest(), pattern)
    if key not in _loaded:
        _loaded[key] = ByteBpe(held.value, pattern)
    return _loaded[key]


def _held(spark: SparkSession, rank_path: str):
    text_batches(spark)
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(codec: ByteBpe, texts: pa.Array) -> pa.ListArray:
    raw = codec.encode_all(texts.fill_null("").to_pylist())
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _decoded(codec: ByteBpe, lists: pa.ListArray) -> pa.Array:
    """The bytes of each list's ids, some ``IDS`` of them at a time."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids, texts, at = lists.flatten().to_numpy(zero_copy_only=False), [], 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + IDS, side="right")) - 1)
        texts += codec.decode_all(ids[ends[at] : ends[to]].astype(np.int64), ends[at : to + 1] - ends[at])
        at = to
    return pa.array(texts, pa.binary())


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text as ``out`` array<int>. ``rank_path`` is read where this is called; the ranks go to the
    workers by broadcast, so executors need no such file."""
    held = _held(df.sparkSession, rank_path)
    df = freed(df, [out], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern)
        for batch in batches:
            for part in pieces(batch, text_col, TEXT):
                yield pa.RecordBatch.from_arrays([*part.columns, _encoded(codec, part.column(text_col))], names=[*part.schema.names, out])
        codec.cache.clear()

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each row's ids stand for as ``out``; null ids give empty bytes."""
    held = _held(df.sparkSession, rank_path)
    df = freed(df, [out], ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern)
        for batch in batches:
            at = 0
            size = np.cumsum(batch.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + IDS, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(codec, part.column(ids_col))], names=[*part.schema.names, out])
                at = to

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """df with the ids of each text as ``out`` and the bytes that these ids stand for as ``back``, without the texts: what
    ``encode`` and ``decode`` give, by one worker a task instead of two, and texts don't come back from it."""
    held = _held(df.sparkSession, rank_path)
    df = freed(df, [out, back], text_col)
    rest = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern)
        for batch in batches:
            for part in pieces(batch, text_col, TEXT):
                ids = _encoded(codec, part.column(text_col))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), ids, _decoded(codec, ids)], names=[*(f.name for f in rest), out, back])
        codec.cache.clear()

    return df.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(back, T.BinaryType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    back = round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


