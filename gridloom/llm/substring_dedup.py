"""Substring dedup: words in a long window that an earlier document also has are removed.

Texts are written once, in compressed chunks, and every pass reads these. All sizes follow the data, see ``Sizes``: a chunk
has some 8 MB, a range of hashes some 2 million windows, both times the root of the input over 64 GB where that is more than
one, and there are as many of each as it takes.

Pass one: a count-min sketch of two rows with at least four cells a window. A chunk sends each range of cells its sorted
cell numbers, split into "once" and "more" (counters stop at two, as no more matters). A range adds up what all chunks sent
and answers each chunk with a bit for each of its cells. Estimates are never below true counts, so a window with a zero bit
is in one place only. The sketch is nowhere as a whole: not on the driver, not in a broadcast.

Pass two: a chunk sends the windows that are estimated repeated, once each, with its smallest doc_id, to ranges of hashes. A
range groups them by 128 bits (two independent hashes of the words, combined in two ways) and answers with a bit for each: a
smaller doc_id is elsewhere. A window that a third of all documents has is one entry a chunk, so no group is hot. Words are
not sent: among 10**13 windows some 10**26 pairs could meet by chance, with a chance of 3 * 10**-39 each.

Pass three: chunks meet their answers and words covered by a hit window go. Windows are judged on the input.

What passes between chunks and ranges is packed in one row for each pair of them. Because both grow with the root of the
input beyond 64 GB, so do the windows in a row, and rows grow no faster than the input.

Defined results: ids are whole numbers, any other type is a ValueError; null text is a text without words; a null id counts as larger than any other; rows that repeat an id do
not remove each other's words; texts under ``size`` words stay; other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import documents, stored, text_batches
from .textbuf import SPACE, covered, mix, per_row, pieces, spans_hash, texts_of, trimmed, windows, words

SIZE = 13
#: Rows of the sketch; log2 of the places of the table in which a chunk looks its cells up.
ROWS, TABLE = 2, 24
_NO_ID = np.int64(2**63 - 1)
_ZSTD = pa.Codec("zstd", 1)


@dataclass(frozen=True)
class Sizes:
    """Bytes of text of a chunk, windows of a range, log2 of a sketch row's cells in a range, and tasks of passes two and three:
    8 MB each up to 20,000, then the same number until each has 512 MB."""

    chunk: int
    windows: int
    cells: int
    tasks: int

    @staticmethod
    def of(text_bytes: int) -> Sizes:
        grow = max(1.0, (text_bytes / (64 << 30)) ** 0.5)
        tasks = min(1 + text_bytes // (8 << 20), max(20_000, text_bytes // (512 << 20)))
        return Sizes(int(grow * (8 << 20)), int(grow * (2 << 20)), 23 + int(np.ceil(np.log2(grow))), max(8, tasks))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers (uint64) as compressed planes of bytes: the lowest bytes of all, the next ones, and so on."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max(1, int(values.max()).bit_length() + 7 >> 3) if len(values) else 1
    return len(values).to_bytes(8, "little") + bytes([used]) + _ZSTD.compress(np.ascontiguousarray(planes[:used]), asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, used = int.from_bytes(raw[:8], "little"), raw[8]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(_ZSTD.decompress(raw[9:], n * used, asbytes=True), np.uint8).reshape(used, n).T
    return planes.view("<u8").reshape(-1)


def gaps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_[:1] * 0)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def chunks(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """The rows in written chunks: (chunk, spaces, rows), with the spaces in the texts and the compressed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, spaces = [], 0, 0

        def sent() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), pa.array([spaces]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "spaces", "rows"])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                buf, _ = texts_of(part.column("text"))
                held.append(part)
                size, spaces = size + len(buf), spaces + int(np.count_nonzero(SPACE[buf]))
                if size > chunk_bytes:
                    yield sent()
                    held, size, spaces = [], 0, 0
        if held:
            yield sent()

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(own.mapInArrow(trimmed(run), "chunk long, spaces long, rows binary"), "substring-dedup")


class Chunk:
    """A chunk's texts and windows. ``ranges``: how many; ``bits``: log2 of a sketch row's cells in a range."""

    def __init__(self, raw: pa.Buffer, size: int, ranges: int, bits: int):
        self.docs = pa.ipc.open_stream(raw).read_all().combine_chunks()
        self.size, self.ranges, self.bits = size, ranges, np.uint64(bits)
        buf, off = texts_of(self.docs.column("text"))
        start, end, self.row = words(buf, off)
        self.span = (buf, start, end)
        self.first, self.at = windows(spans_hash(buf, start, end), self.row, size)

    def cells(self, k: int) -> np.ndarray:
        """Each window's cell of row k, range and number."""
        h = mix(self.first, 21 + k)
        return (range_of(h, self.ranges) << self.bits) | (h & ((np.uint64(1) << self.bits) - np.uint64(1)))

    def distinct(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each range with cells: its number, its distinct cells in order, and which have more than one window."""
        cells = np.sort(cells)
        begin, _ = _groups(cells)
        key, more = cells[begin], np.diff(np.append(begin, len(cells))) > 1
        found, begin = np.unique(key >> self.bits, return_index=True)
        for r, a, b in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
            yield r, key[a:b], more[a:b]

    def asks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """For each range of each row of the sketch: its number, the cells with one window, those with more."""
        for k in range(ROWS):
            for r, key, more in self.distinct(self.cells(k)):
                own = key - (np.uint64(r) << self.bits)
                yield k * self.ranges + r, packed(gaps(own[~more])), packed(gaps(own[more]))

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """Indexes of the windows that the sketch estimates over one, and of a few that share a place in a table with them.
        ``answers``: by range, a bit for each cell asked once."""
        go = np.arange(len(self.first))
        for k in range(ROWS):
            cells = self.cells(k)
            place = lambda x: (mix(x, 31) >> np.uint64(64 - TABLE)).astype(np.int64)
            table = np.zeros(1 << TABLE, bool)
            for r, key, more in self.distinct(cells):
                over = more.copy()
                bits = answers.get(k * self.ranges + r)
                if bits is not None:
                    over[~more] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(over) - int(more.sum())).astype(bool)
                table[place(key[over])] = True
            go = go[table[place(cells[go])]]
        return go

    def judge(self, answers: dict[int, bytes]) -> None:
        """Sets the distinct candidates in order of their hashes (h, second), the chunk's smallest id of each (least), the
        place of every candidate window (at), which candidate it is (of), and the id of its row (ids)."""
        go = self.candidates(answers)
        first, at = self.first[go], self.at[go]
        own, by = mix(spans_hash(*self.span, 1), 7), np.uint64(0xA0761D6478BD642F)
        second = np.zeros(len(go), np.uint64)
        for j in range(self.size):
            second = second * by + own[at + j]
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        if ((first[1:] == first[:-1]) & (second[1:] != second[:-1])).any():
            again = np.lexsort((second, first))
            order, first, second = order[again], first[again], second[again]
        self.at = at[order]
        begin, self.of = _groups(first, second)
        self.h, self.second = first[begin], second[begin]
        self.ids = self.docs.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)[self.row[self.at]]
        self.least = np.minimum.reduceat(self.ids, begin) if len(begin) else self.ids[:0]
        self.found, self.begin = np.unique(range_of(self.h, self.ranges), return_index=True)
        self.begin = np.append(self.begin, len(self.h))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal keys, which are in order, begins, and the group of each."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of batches in order of key."""
    now, held = None, []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            if k[a] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = int(k[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _answer(chunk: list[int], slot: list[int], kind: int, bits: list[bytes | None]) -> pa.RecordBatch:
    go = [x is not None for x in bits]
    n = sum(go)
    return pa.RecordBatch.from_arrays([pa.array(list(compress(chunk, go)), pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(list(compress(slot, go)), pa.int64()), pa.array(list(compress(bits, go)), pa.binary())], names=["chunk", "kind", "slot", "bits"])


def _bits(hit: np.ndarray) -> bytes | None:
    return np.packbits(hit).tobytes() if hit.any() else None


def added_up(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Pass one's ranges: the sketch of all chunks, and each chunk's answer."""
    one, two = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    for slot, part in _by(batches, "slot"):
        one[:], two[:] = False, False
        own = []
        for a, b in zip(part.column("once").to_pylist(), part.column("more").to_pylist(), strict=True):
            once, more = (np.cumsum(unpacked(x)).astype(np.int64) for x in (a, b))
            two[once] |= one[once]
            one[once] = one[more] = two[more] = True
            own.append(a)
        found = [_bits(two[np.cumsum(unpacked(a)).astype(np.int64)]) for a in own]
        yield _answer(part.column("chunk").to_pylist(), [slot] * len(found), 0, found)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass two's ranges: which entries have a smaller id elsewhere."""
    for slot, part in _by(batches, "slot"):
        first, second, ids = ([unpacked(x) for x in part.column(c).to_pylist()] for c in ("first", "second", "least"))
        size = [len(x) for x in first]
        a, b = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in first]), np.concatenate(second)
        ids = np.concatenate(ids).view(np.int64)
        order = np.lexsort((b, a))
        begin, of = _groups(a[order], b[order])
        hit = np.zeros(len(a), bool)
        if len(a):
            hit[order] = np.minimum.reduceat(ids[order], begin)[of] < ids[order]
        bits = [_bits(x) for x in np.split(hit, np.cumsum(size)[:-1])]
        yield _answer(part.column("chunk").to_pylist(), [slot] * len(bits), 1, bits)


def _parts(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(table.column("kind").to_pylist(), table.column("slot").to_pylist(), table.column("bits").to_pylist(), strict=True)
    return {slot: bits for k, slot, bits in rows if k == kind}


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, sizes: Sizes | None = None) -> DataFrame:
    """For each row: id_col, n_words, n_removed and kept, the words that stay joined by one space. ``sizes``: taken from the
    bytes of the texts unless given."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    if not isinstance(id_type, IntegralType):
        raise ValueError(f"{id_col} is {id_type.simpleString()}; ids must be whole numbers, as the smaller one keeps its words")
    text_batches(spark)
    sizes = sizes or Sizes.of(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    own = chunks(df, id_col, text_col, sizes.chunk)
    ranges, bits = 1 + own.agg(F.coalesce(F.sum("spaces"), F.lit(0))).first()[0] // sizes.windows, sizes.cells
    dealt = own.select("chunk", "rows").repartition(sizes.tasks, "chunk")

    def ask_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
                found = list(Chunk(raw.as_buffer(), size, ranges, bits).asks())
                slot, once, more = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array([chunk] * len(slot), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["slot", "chunk", "once", "more"])

    def ask_windows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names, out = ["slot", "chunk", "first", "second", "least"], [[] for _ in range(5)]
        for chunk, raw in zip(docs.column("chunk").to_pylist(), docs.column("rows"), strict=True):
            part = Chunk(raw.as_buffer(), size, ranges, bits)
            part.judge(_parts(answers, 0))
            for slot, a, b in zip(part.found.tolist(), part.begin[:-1].tolist(), part.begin[1:].tolist(), strict=True):
                row = slot, chunk, packed(gaps(part.h[a:b])), packed(part.second[a:b]), packed(part.least[a:b].view(np.uint64))
                for x, y in zip(out, row, strict=True):
                    x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    def strip(docs: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [_stripped(Chunk(raw.as_buffer(), size, ranges, bits), answers) for raw in docs.column("rows")]
        return pa.concat_tables(parts) if parts else _NOTHING

    reply = "chunk long, kind int, slot long, bits binary"
    asked = own.select("chunk", "rows").mapInArrow(trimmed(ask_sketch), "slot long, chunk long, once binary, more binary")
    sums = lambda batches: added_up(batches, bits)
    sketched = stored(asked.repartition(sizes.tasks, "slot").sortWithinPartitions("slot").mapInArrow(trimmed(sums), reply), "substring-dedup")
    entries = dealt.groupBy("chunk").cogroup(sketched.groupBy("chunk")).applyInArrow(ask_windows, "slot long, chunk long, first binary, second binary, least binary")
    replies = entries.repartition(sizes.tasks, "slot").sortWithinPartitions("slot").mapInArrow(trimmed(grouped), reply)
    out = dealt.groupBy("chunk").cogroup(sketched.unionByName(replies).groupBy("chunk")).applyInArrow(strip, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_words", "n_removed", "kept")


_NOTHING = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]).empty_table()


def _stripped(part: Chunk, answers: pa.Table) -> pa.Table:
    """A chunk's texts without the words of hit windows."""
    part.judge(_parts(answers, 0))
    hit = np.zeros(len(part.h), bool)
    edge = dict(zip(part.found.tolist(), zip(part.begin[:-1].tolist(), part.begin[1:].tolist(), strict=True), strict=True))
    for slot, bits in _parts(answers, 1).items():
        a, b = edge[slot]
        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    go = hit[part.of] | (part.ids > part.least[part.of])
    gone = covered(len(part.row), part.at[go], part.size)
    n = part.docs.num_rows
    count, removed = per_row(np.ones(len(part.row)), part.row, n), per_row(gone, part.row, n)
    ends, stay, kept = np.cumsum(count).tolist(), ~gone, []
    texts = part.docs.column("text").combine_chunks()
    for i, (of_row, fewer) in enumerate(zip(count.tolist(), removed.tolist(), strict=True)):
        own = (texts[i].as_py() or "").encode().split()
        kept.append(b" ".join(compress(own, stay[ends[i] - of_row : ends[i]].tolist()) if fewer else own))
    return pa.table([part.docs.column("id"), pa.array(count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], schema=_NOTHING.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: words removed from every document, and a digest of those kept."""
    done = dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM win JOIN first USING (k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
