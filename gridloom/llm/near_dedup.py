"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set: its shingles of five words (a shorter text is one shingle) with their counts. Each shingle's
weight axis falls into regions [2^v - 1, 2^(v+1) - 1); hashed darts arrive in a region at a rate of its width along the rank
axis, each with a weight and a coordinate of the signature. A dart counts if its weight lies below the shingle's; of every
coordinate the earliest dart is kept. Two texts share a coordinate's dart with probability equal to their weighted Jaccard
similarity. Darts are thrown only up to the rank that fills the signature, so a text costs about k log k darts whatever k
coordinates and shingles it has.

Bands of ``ROWS`` coordinates are joined: of texts with equal shingles one stands for all; each band's bucket gets a pivot,
found by a sum that is built up before the shuffle; members are compared with the pivot only, by exact similarity of their
shingles. Texts linked so far form components. Buckets that still hold several components compare, in blocks, the texts
outside their largest component with the texts of other components; pairs are not written out, only links that join
components are. So large groups of near copies cost one comparison a member, texts that only look alike cost a product of
matrices, and no link found by the bands is lost.

Defined results: texts without words (null and empty too) are in a class of their own each; a null id stands after all
others; rows that repeat an id belong to the classes of all their texts, which become one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forgotten, parallelism, sized, stored, text_batches
from .textbuf import mix, pieces, spans_hash, texts_of, trimmed, windows, words

SHINGLE, SIMILARITY = 5, 0.8
#: 40 bands of 8: a pair of similarity 0.8 shares a band with probability 0.9994, one of 0.5 with 0.14.
BANDS, ROWS = 40, 8
#: Pivots that a bucket gets, one after another, while comparing all its components would take over ``WORK`` pairs.
TURNS, WORK = 3, 1 << 16
#: Texts of a block: of those outside their bucket's largest component, and of all.
BLOCK_X, BLOCK_Y = 256, 1024
#: A text's number of 63 bits, from its 128-bit key.
NODE = "CASE WHEN text_key IS NOT NULL THEN shiftrightunsigned(xxhash64(text_key), 1) END"


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text: two independent hashes, row and count, by row and hashes."""
    buf, off = texts_of(column)
    start, end, row = words(buf, off)
    n = np.bincount(row, minlength=len(column))
    short = np.flatnonzero((n > 0) & (n < size))
    first = np.cumsum(n) - n
    found = []
    for k in range(2):
        h = spans_hash(buf, start, end, k)
        win, at = windows(h, row, size, 7 * k)
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            extra[has] = mix(extra[has] * np.uint64(3) + h[first[short][has] + j], 1 + k)
        found.append(np.concatenate([win, extra]))
    win, other, row = *found, np.concatenate([row[at], short])
    order = np.lexsort((other, win, row))
    win, other, row = win[order], other[order], row[order]
    fresh = np.ones(len(win), bool)
    fresh[1:] = (win[1:] != win[:-1]) | (other[1:] != other[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    return win[begin], other[begin], row[begin], np.diff(np.append(begin, len(win)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(key: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates for each of n weighted sets (0 for empty sets)."""
    signature = np.zeros((n, k), np.uint64)
    total = np.bincount(row, weights=weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = k * (np.log(k) + 3) / total[todo]
    while len(todo):
        own = np.isin(row, todo) if len(todo) < n else np.ones(len(row), bool)
        best = np.full(n * k, np.inf)
        dart = np.zeros(n * k, np.uint64)
        e, r, w = key[own], row[own], weight[own]
        level = 0
        while len(e):
            low, width = 2**level - 1, 2**level
            _throw(mix(e, 101 + level), r, w, low, width, reach, k, best, dart)
            go = w > low + width
            e, r, w, level = e[go], r[go], w[go], level + 1
        best = best.reshape(n, k)
        full = np.isfinite(best[todo]).all(1)
        signature[todo[full]] = dart.reshape(n, k)[todo[full]]
        todo = todo[~full]
        reach[todo] *= 2
    return signature


def _throw(e: np.ndarray, row: np.ndarray, weight: np.ndarray, low: float, width: float, reach: np.ndarray, k: int, best: np.ndarray, dart: np.ndarray) -> None:
    """The darts of one region of each element, in order of rank, up to the reach of its set."""
    rank, goal, number = np.zeros(len(e)), reach[row], 0
    while len(e):
        step = 8 if len(e) > 4096 else 64
        h = mix(e[:, None] + (np.arange(number, number + step, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None])
        ranks = rank[:, None] + np.cumsum(-np.log(_unit(h)) / width, 1)
        number += step
        hit = ranks <= goal[:, None]
        if width > 1:
            hit &= low + _unit(mix(h, 1)) * width < weight[:, None]
        i, j = np.nonzero(hit)
        found, at = mix(h[i, j], 2), ranks[i, j]
        place = row[i] * k + (found % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, place, at)
        win = best[place] == at
        dart[place[win]] = found[win]
        rank = ranks[:, -1]
        go = rank <= goal
        e, row, weight, rank, goal = e[go], row[go], weight[go], rank[go], goal[go]


def set_keys(h: np.ndarray, row: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles as a set of 32-bit keys, the repeats of a shingle as keys of their own, by row and key. Two texts
    of n shingles each take an unlike key for a common one n * n / 2**32 times."""
    again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key = (mix(np.repeat(h, count) + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 17) >> np.uint64(32)).astype(np.uint32)
    row = np.repeat(row, count)
    order = np.lexsort((key, row))
    return key[order], row[order]


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common)


def text_keys(h: np.ndarray, other: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits of each text's shingles and counts, 64 from each hash; null without words."""
    key = np.zeros((n, 2), np.uint64)
    for k, own in enumerate((h, other)):
        np.add.at(key[:, k], row, mix(mix(own, 11 + k) + count.astype(np.uint64), 13 + k))
    raw, has = key.tobytes(), np.bincount(row, minlength=n) > 0
    return [raw[16 * i : 16 * i + 16] if x else None for i, x in enumerate(has.tolist())]


def signatures(df: DataFrame, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """df without the text, with text_key (128 bits of the shingles and counts; null without words), size (shingles with
    repeats) and bands, a hash each."""
    rest = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 19):
                n = part.num_rows
                h, other, row, count = shingles(part.column(text_col))
                sig = dart_signatures(h, row, count.astype(np.float64), n, bands * rows).reshape(n, bands, rows)
                band = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    band = mix(band * np.uint64(3) + sig[:, :, j])
                band = mix(band + np.arange(bands, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
                size = np.bincount(row, weights=count, minlength=n).astype(np.int64)
                keys = text_keys(h, other, row, count, n)
                off = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(band[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(keys, pa.binary()), pa.array(size), lists], names=[*rest, "text_key", "size", "bands"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(trimmed(run), f"{kinds + ', ' if kinds else ''}text_key binary, size long, bands array<long>")


def shingle_blobs(df: DataFrame, text_col: str) -> DataFrame:
    """(text_key, blob): each text's shingles; texts without words have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                h, other, row, count = shingles(part.column(text_col))
                key, of = set_keys(h, row, count)
                edge = np.searchsorted(of, np.arange(part.num_rows + 1)).tolist()
                blobs = [key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                keys = text_keys(h, other, row, count, part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["text_key", "blob"])

    return df.select(text_col).mapInArrow(trimmed(run), "text_key binary, blob binary")


def similar_pairs(pairs: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of texts whose similarity is ``least`` or more. blobs: (node, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("blob_a"), batch.column("blob_b")
            good = [similarity(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()) >= least for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(blobs.select(F.col("node").alias("a"), F.col("blob").alias("blob_a")), "a")
    both = both.join(blobs.select(F.col("node").alias("b"), F.col("blob").alias("blob_b")), "b")
    return both.select("a", "b", "blob_a", "blob_b").mapInArrow(trimmed(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the edges (a, b). Every round each node takes the
    smallest label around it, and then its label's label; the labels are written to the shared folder each round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "near-dedup")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "near-dedup")
    held = label
    while True:
        around = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("near"))
        new = label.join(around, label.node == around.a, "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # only labels that have a lower label themselves, so that a large component is no hot key
        jump = new.select("comp").distinct().join(new.select(F.col("node").alias("comp"), F.col("comp").alias("beyond")), "comp").filter("beyond < comp")
        new = stored(new.join(jump, "comp", "left").select("node", "old", F.coalesce("beyond", "comp").alias("comp")), "near-dedup")
        forgotten(held)
        if not new.filter("comp < old").limit(1).count():
            forgotten(both)
            return new.select("node", "comp")
        held, label = new, new.select("node", "comp")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sizes_allow(x: str, y: str, least: float):
    return (F.col(x) >= least * F.col(y)) & (F.col(y) >= least * F.col(x))


def links(shared: DataFrame, texts: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join all texts which a bucket's similarities join. shared: (band, node, size) of buckets with two
    texts or more; texts: (node, bands)."""
    edges = compared = None
    opened = shared.withColumn("comp", F.col("node"))
    for turn in range(TURNS):
        order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
        pivot = opened.groupBy("band").agg(F.min_by(F.struct("node", "size", "comp"), order).alias("p"), F.count("*").alias("n"))
        asked = opened.join(pivot.select("band", "p"), "band").filter((F.col("comp") != F.col("p.comp")) & _sizes_allow("size", "p.size", least))
        asked = _ordered(asked.select(F.col("p.node").alias("a"), F.col("node").alias("b")))
        if compared is not None:
            asked = asked.join(compared, ["a", "b"], "left_anti")
        asked = stored(asked, "near-dedup")
        found = stored(similar_pairs(asked, blobs, least), "near-dedup")
        edges = found if edges is None else edges.unionByName(found)
        compared = asked if compared is None else compared.unionByName(asked)
        mark = shared.join(components(edges), "node", "left").select("band", "node", "size", F.coalesce("comp", "node").alias("comp"))
        sums = mark.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("of_main"), F.sum("n").alias("n"))
        left = stored(mark.join(sums.filter("of_main < n"), "band").withColumn("work", F.col("n") * (F.col("n") - F.col("of_main"))), "near-dedup")
        opened = left.filter(F.col("work") > WORK).select("band", "node", "size", "comp")
        if not opened.limit(1).count():
            break
    return edges.unionByName(stored(links_in_blocks(left.filter("n > 2"), texts, blobs, least), "near-dedup"))


def links_in_blocks(left: DataFrame, texts: DataFrame, blobs: DataFrame, least: float) -> DataFrame:
    """Links between the components of buckets: every text outside a bucket's largest component is compared with every other
    of another component, and what joins components comes out, not the pairs. left: (band, node, comp, main, n, of_main).

    A bucket is dealt into blocks of some ``BLOCK_X`` such texts by ``BLOCK_Y`` of all, so no task holds more than a block
    of each. Texts that share several bands are compared in the first of these only."""
    share = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    deal = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    own = left.withColumn("out", F.col("n") - F.col("of_main")).withColumns({"xs": share("out", BLOCK_X), "ys": share("n", BLOCK_Y)})
    x = own.filter("comp <> main").withColumns({"is_x": F.lit(True), "bx": deal(1, "xs"), "by": F.explode(F.sequence(F.lit(0), F.col("ys") - 1))})
    y = own.withColumns({"is_x": F.lit(False), "by": deal(2, "ys"), "bx": F.explode(F.sequence(F.lit(0), F.col("xs") - 1))})
    rows = x.unionByName(y).select("band", "bx", "by", "is_x", "node", "comp", (F.col("comp") != F.col("main")).alias("stray"))
    rows = rows.join(texts.select("node", "bands").join(blobs, "node"), "node")
    spark = left.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            found = _joining(group, least)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition(parallelism(spark), "band", "bx", "by").sortWithinPartitions("band", "bx", "by")
    return dealt.mapInArrow(trimmed(compare), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (band, bx, by) of batches in their order."""
    now, held = None, []
    for batch in batches:
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "bx", "by")], 1)
        edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            if tuple(k[a]) != now:
                if held:
                    yield pa.Table.from_batches(held)
                now, held = tuple(k[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _joining(group: pa.Table, least: float) -> list[tuple[int, int]]:
    """Of a block the links that join its components, each join once."""
    group = group.combine_chunks()
    is_x, stray = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_x", "stray"))
    node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    sets = [np.frombuffer(b, np.uint32) for b in group.column("blob").to_pylist()]
    size = np.array([len(s) for s in sets])
    xs, ys = np.flatnonzero(is_x), np.flatnonzero(~is_x)
    if not len(xs) or not len(ys):
        return []
    place = int(np.flatnonzero(bands[xs[0]] == group.column("band")[0].as_py())[0])
    earlier = np.zeros((len(xs), len(ys)), bool)
    for k in range(place):
        earlier |= bands[xs, k][:, None] == bands[ys, k][None]
    n, m = size[xs][:, None], size[ys][None]
    ask = ~earlier & (comp[xs][:, None] != comp[ys][None]) & (n >= least * m) & (m >= least * n)
    ask &= ~stray[ys][None] | (node[xs][:, None] < node[ys][None])  # two strays meet once
    xs, ys, ask = xs[ask.any(1)], ys[ask.any(0)], ask[ask.any(1)][:, ask.any(0)]
    if not len(xs):
        return []
    common = _common([sets[i] for i in xs], [sets[j] for j in ys])
    both = size[xs][:, None] + size[ys][None] - common
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.setdefault(c, c) != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for i, j in np.argwhere(ask & (common >= least * both)).tolist():
        a, b = root(int(comp[xs[i]])), root(int(comp[ys[j]]))
        if a != b:
            up[a] = b
            out.append((int(node[xs[i]]), int(node[ys[j]])))
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many keys each set of a has in common with each of b: products of incidence matrices, some keys at a time."""
    ka, kb = np.concatenate(a), np.concatenate(b)
    ra, rb = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b))
    keys = np.intersect1d(ka, kb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(keys):
        return out
    found = []
    for k, r in ((ka, ra), (kb, rb)):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        good = keys[at] == k
        order = np.argsort(at[good], kind="stable")
        found.append((at[good][order], r[good][order]))
    (ca, ra), (cb, rb) = found
    for lo in range(0, len(keys), width):
        parts = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            i, j = np.searchsorted(c, [lo, lo + width])
            m = np.zeros((n, min(width, len(keys) - lo)), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of df: id_col, class_id (the smallest id of its class; null if none has one) and copies (rows whose
    shingles equal its own)."""
    text_batches(df.sparkSession)
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(own, "text", bands, rows).withColumn("node", F.expr(NODE)), "near-dedup")
    members = signed.select("id", "node")
    texts = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    texts = stored(texts, "near-dedup")
    banded = texts.select("node", "size", F.explode("bands").alias("band"))
    several = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    shared = stored(banded.join(several, "band"), "near-dedup")
    wanted = stored(texts.select("node", F.col("id").alias("rep")).join(shared.select("node").distinct(), "node", "left_semi"), "near-dedup")
    named = own.join(sized(wanted.filter("rep is not null").select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    found = shingle_blobs(named.unionByName(own.filter("id is null")).select("text"), "text").withColumn("node", F.expr(NODE))
    blobs = stored(found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("blob").alias("blob")), "near-dedup")
    edges = links(shared, texts.select("node", "bands"), blobs, least)
    # rows that share an id tie their texts together
    tied = members.filter("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    tied = members.join(tied.filter("low < high"), "id").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    label = components(edges.unionByName(tied))
    of_text = texts.select("node", "id", "copies").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_text = of_text.join(of_text.groupBy("comp").agg(F.min("id").alias("class_id")), "comp").select("node", "class_id", "copies")
    out = members.join(of_text, "node", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id; columns as they were. Of rows that repeat an id one stays; rows
    without an id stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    found = stored(classes(plain, key, text), "near-dedup")
    gone = stored(found.filter(F.col(key) != F.col("class_id")).select(key).distinct(), "near-dedup")
    stay = plain.filter(F.col(key).isNotNull()).join(sized(gone), key, "left_anti")
    many = stored(found.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull() & (F.col("n") > 1)).select(key), "near-dedup")
    if many.limit(1).count():
        stay = stay.join(many, key, "left_anti").unionByName(stay.join(many, key, "left_semi").dropDuplicates([key]))
    return stay.unionByName(plain.filter(F.col(key).isNull())).select(names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the class of near copies of every document."""
    return classes(documents(spark, sf_dir))
