"""Spelling variants: words that differ by one edit, found by pivotal bigrams, and each variant's usual form.

Bigrams have one order over all words, the rarest first. A word's prefix is its three first bigrams (and any others equal to
the third); of these three a dynamic program over their places picks two disjoint ones with the fewest words in all: the
pivots. One edit touches at most one of two disjoint bigrams. So of two near words, the one whose prefix ends first in that
order (the asking word) has a pivot that the other has in its prefix, at a place that is off by the edit at most. The edit
lies behind the first pivot or before the second one:

* behind the first pivot, both words begin alike up to the end of that pivot, at the same place from the start;
* before the second pivot, both end alike from that pivot on, at the same place from the end.

So prefixes are indexed twice: by a bigram with all before it, and by a bigram with all behind it. The first pivot asks the
former, the second one the latter, and both ask for the other word's length too: one less, the same or one more. This takes
both limits of places (from the start and from the end) into the key. The rest of the word, which has the edit, is cut into
three parts by the other word's length, and a key also has the two parts without the edit. So what meets has all but a few
letters in common, however many words share a rare bigram. Each pair is then verified by its edit distance.

Words come from whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Counting them is a small count in
each batch of texts, then Spark's sum. The table of bigram counts has at most 90 * 90 entries whatever the input, because
words have no other letters.

Defined results: null and empty texts have no words; a null id is an id without characters; repeated rows count each; a
batch tells words apart by 64-bit hashes of their letters (two unlike words of L bytes share one with a chance of
(L / 2**32)**2), everything after that by the words themselves; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, stored, text_batches
from .textbuf import LOWER, mix, pieces, spans_hash, texts_of, trimmed, words

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter in the query (the contract's planted misspellings).
DROP = 31
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = _ASCII_LETTER[ord("A") : ord("Z") + 1] = True
_OUTSIDE = np.array([True, False] + [False] * 254)
#: Bytes of the longest run whose checksum is taken for many runs at once.
_SHORT = 48
#: Parts of what two near words need not have in common.
PARTS = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def letter_runs(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, row and code points of each maximal run of letters."""
    lead = low == _LEAD
    inside = _ASCII_LETTER[low] | lead
    inside[1:] |= lead[:-1]
    start, end, row = words(inside.view(np.uint8), off, _OUTSIDE)
    before = np.zeros(len(low) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return start, end, row, end - start - (before[end] - before[start])


def checksums(low: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the crc32 of what stands before it (``seed``)."""
    out = np.empty(len(start), np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_SHORT))
    raw = memoryview(np.ascontiguousarray(low))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]], int(seed[i]))
    order = order[long:]
    state, at, left = ~seed[order], start[order], -size[order]
    for j in range(int(-left[0]) if len(left) else 0):
        k = int(np.searchsorted(left, -j))  # spans with more than j bytes
        state[:k] = _CRC[(state[:k] ^ low[at[:k] + j]) & 255] ^ (state[:k] >> np.uint32(8))
    out[order] = ~state
    return out


def counted_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, drop: int = 0) -> DataFrame:
    """(word, n): the words of at least ``least_chars`` code points. With ``drop``, a run whose crc32 of ``<id>:<run>`` is
    divisible by it loses the letter at crc32 modulo its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                buf, off = texts_of(part.column("text"))
                low = LOWER[buf]
                start, end, row, chars = letter_runs(low, off)
                go = chars >= least_chars
                start, end, row, chars = start[go], end[go], row[go], chars[go]
                extra: list[str] = []
                if drop and len(start):
                    seed = np.array([zlib.crc32(f"{x or ''}:".encode()) for x in part.column("id").to_pylist()], np.uint32)
                    h = checksums(low, start, end, seed[row])
                    hit = h % drop == 0
                    raw = low.tobytes()
                    for a, b, k in zip(start[hit].tolist(), end[hit].tolist(), (h[hit] % chars[hit]).tolist(), strict=True):
                        word = raw[a:b].decode()
                        if len(word) > least_chars:
                            extra.append(word[:k] + word[k + 1 :])
                    start, end = start[~hit], end[~hit]
                _, first, n = np.unique(spans_hash(low, start, end), return_index=True, return_counts=True)
                size = end[first] - start[first]
                border = np.zeros(len(first) + 1, np.int64)
                np.cumsum(size, out=border[1:])
                at = np.arange(border[-1]) + np.repeat(start[first] - border[:-1], size)
                own = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(border), pa.py_buffer(low[at])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64())], names=["word", "n"])
                if extra:
                    yield pa.RecordBatch.from_arrays([pa.array(extra, pa.string()), pa.array([1] * len(extra), pa.int64())], names=["word", "n"])

    text_batches(df.sparkSession)
    own = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The bigrams of a column of words: codes, places and words, end to end."""

    def __init__(self, column: pa.Array):
        buf, off = texts_of(column)
        lead = buf == _LEAD
        after = np.zeros(len(buf), bool)
        after[1:] = lead[:-1]
        kept = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(~lead, out=kept[1:])
        self.letter = np.where(after, buf | 0x40, buf)[~lead]  # one byte a letter: U+00C0 is 0xC0
        self.off = kept[off]
        self.size = np.diff(self.off)
        self.word = np.repeat(np.arange(len(self.size)), np.maximum(self.size - 1, 0))
        begin = np.cumsum(np.maximum(self.size - 1, 0)) - np.maximum(self.size - 1, 0)
        self.place = np.arange(len(self.word)) - begin[self.word]
        self.at = self.off[:-1][self.word] + self.place
        self.code = self.letter[self.at].astype(np.int64) << 8 | self.letter[self.at + 1] if len(self.at) else np.zeros(0, np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of which differences are hashes (modulo 2**64) of a word up to a letter, and of a word from a letter on."""
        longest = int(self.size.max()) if len(self.size) else 0
        power = np.ones(longest + 1, np.uint64)
        np.cumprod(np.full(longest, _BASE), out=power[1:])
        own = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.letter)) - self.off[:-1][own]
        value = self.letter.astype(np.uint64) + np.uint64(1)
        ahead, behind = np.zeros(len(value) + 1, np.uint64), np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * power[place], out=ahead[1:])
        np.cumsum(value * power[self.size[own] - 1 - place], out=behind[1:])
        return ahead, behind

    def keys(self, word: np.ndarray, size: np.ndarray, place: np.ndarray, behind: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys under which words meet words of ``size`` letters, and which word each is of. ``place``: where the shared bigram
        starts in the word of ``size`` letters. With ``behind`` all from there on is alike, else all up to its end; the rest
        is cut into ``PARTS``, of which one has the edit, so a key is all but one part."""
        lo = np.zeros(len(word), np.int64) if behind else place + 2
        rest = (place if behind else size) - lo
        sums = self.whole()
        start, end = self.off[:-1][word], self.off[1:][word]
        out, of = [], []
        for j in range(PARTS):
            head, tail = lo + j * rest // PARTS, size - (lo + (j + 1) * rest // PARTS)
            go = np.flatnonzero(head + tail <= end - start)  # else an inserted letter has no room in this part
            h = mix(sums[0][start[go] + head[go]] - sums[0][start[go]], 1) + mix(sums[1][end[go]] - sums[1][end[go] - tail[go]], 2)
            out.append(mix(h + (size[go] * (2 * PARTS) + 2 * j + behind).astype(np.uint64)))
            of.append(word[go])
        return np.concatenate(out), np.concatenate(of)


def gram_ranks(found: DataFrame, col: str = "word") -> np.ndarray:
    """The place of each bigram (65,536 codes of two letters) in the order: by the words that have it, then by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(Grams(batch.column(0)).code, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    count = np.zeros(1 << 16, np.int64)
    for r in found.select(col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        count[r.code] = r.n
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), count))] = np.arange(1 << 16)
    return rank


def pivots(weight: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's bigrams, in order of their places, the two disjoint ones of least total weight: their columns. Every row
    must have two whose places are two apart. ``best[j]``: the lightest bigram that ends before bigram j starts."""
    n, m = weight.shape
    best, from_ = np.full((n, m), np.iinfo(np.int64).max // 4), np.zeros((n, m), np.int64)
    for j in range(1, m):
        for i in range(j):
            better = (place[:, j] - place[:, i] >= 2) & (weight[:, i] < best[:, j])
            best[:, j] = np.where(better, weight[:, i], best[:, j])
            from_[:, j] = np.where(better, i, from_[:, j])
    second = np.argmin(best + weight, axis=1)
    return from_[np.arange(n), second], second


def keyed(found: DataFrame, rank: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """What words ask and what the index holds, both (key, word, last, n). ``last``: where in the order the prefix ends."""

    def run(asks: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g = Grams(batch.column("word"))
                own, rows = rank[g.code], np.arange(batch.num_rows)
                order = np.lexsort((g.place, own, g.word))
                begin = np.searchsorted(g.word[order], rows)
                last = own[order[begin + 2]]
                if asks:
                    three = np.sort(order[begin[:, None] + np.arange(3)], axis=1)  # by place
                    one, two = pivots(own[three], g.place[three])
                    a, b = g.place[three[rows, one]], g.place[three[rows, two]]
                    made = [g.keys(rows, g.size + d, *x) for d in (-1, 0, 1) for x in ((a, False), (b + d, True))]
                else:
                    at = np.flatnonzero(own <= last[g.word])
                    made = [g.keys(g.word[at], g.size[g.word[at]], g.place[at], behind) for behind in (False, True)]
                key, of = (np.concatenate(x) for x in zip(*made, strict=True))
                taken = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("word").take(taken), batch.column("n").take(taken), pa.array(last[of], pa.int32())], names=["key", "word", "n", "last"])

        return go

    own = found.select("word", "n")
    return tuple(own.mapInArrow(run(asks), "key long, word string, n long, last int") for asks in (True, False))


def near_pairs(found: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words that differ by one inserted, deleted or replaced code point, once. found:
    (word, n), distinct words of the letters above and at least four of them."""
    asks, index = keyed(found, gram_ranks(found))
    other = index.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    # the asking word is the one whose prefix ends first; where both end alike the smaller word
    asked = (F.col("last") < F.col("other_last")) | ((F.col("last") == F.col("other_last")) & (F.col("word") < F.col("other")))
    met = asks.join(other, "key").filter(asked).filter(F.levenshtein("word", "other", 1) == 1)
    return met.select("word", "n", "other", "other_n").distinct()


def variants(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, root, form, n, n_near, form_n) of distinct words with their counts (word, n). A word's form is its near word of
    the largest n (the smallest of these in code-point order), if that is at least ``ratio`` times the word's; its root is the
    last of its forms."""
    found = stored(found.select("word", "n"), "spelling-words")
    pairs = near_pairs(found)
    sides = F.explode(F.array(F.struct(F.col("word").alias("w"), F.col("other").alias("o"), F.col("other_n").alias("m")), F.struct(F.col("other").alias("w"), F.col("word").alias("o"), F.col("n").alias("m"))))
    best = pairs.select(sides.alias("s")).groupBy(F.col("s.w").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("m"), F.col("s.o").alias("o"))).alias("best"))
    usual: Column = -F.col("best.m") >= F.col("n") * ratio
    out = found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.o")).alias("form"), F.when(usual, -F.col("best.m")).alias("form_n")
    )
    out = stored(out, "spelling-forms")
    forgotten(found)
    # n grows tenfold with every form, so doubling the steps comes to the end within some five rounds
    steps = stored(out.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forgotten(steps)
        steps = moved.select("word", "root")
        steps._stored_in = moved._stored_in
        if not moved.filter("moved").limit(1).count():
            break
    return out.join(steps, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "form", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the variants among the words of all documents, of which one in 31 has lost a letter."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = counted_words(docs, drop=DROP).filter(F.col("n") >= LEAST_COUNT)
    return variants(found).select("word", "form", "root", "n", "n_near", "form_n")


#: The table of crc32, and the checksum of a list of bytes. Fixed by the contract.
CRC_SQL = r"""
crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)) AS crc)"""


def crc_sql(text: str) -> str:
    """SQL for crc32 of an ASCII or UTF-8 text, where ``crc`` (the table) is in scope."""
    steps = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substring(hex({text}), (2 * i - 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


SQL = rf"""
WITH {CRC_SQL},
runs AS MATERIALIZED (
  SELECT translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, doc_id
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 7),
sums AS (SELECT run, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM sums),
w AS MATERIALIZED (SELECT word, count(*)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
less AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
lost AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM less),
pairs AS (
  SELECT a.word, b.word AS o, b.n AS m FROM lost a JOIN lost b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM lost a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM lost a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, max(m) AS m, arg_min(o, (-m, o)) AS o FROM pairs GROUP BY 1),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN o END AS form, CASE WHEN m >= 10 * w.n THEN m END::BIGINT AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
RECURSIVE_STEPS
SELECT f.word, f.form, coalesce(walked.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN walked ON f.word = walked.word
"""
SQL = SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "RECURSIVE_STEPS",
    """walk AS (SELECT word, form AS root, 1 AS depth FROM f WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form, depth + 1 FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
walked AS (SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY 1)""",
)
