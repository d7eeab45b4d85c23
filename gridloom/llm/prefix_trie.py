"""The trie of conversations' prefixes, by range minima over sorted common prefixes.

Conversations become sequences of turn digests (128 bits of role and text). Spark sorts them by ranges of (sequence,
conversation), so copies of one conversation are spread over as many tasks as they need. A task has a run of sorted sequences
and the common prefix, in turns, of each neighbouring pair. A candidate prefix (a row and a depth that its left neighbour does
not share) finds its members by two binary searches over a sparse table of range minima, to the left and to the right, each
for itself: as far as no common prefix is shorter than the depth. A second sparse table gives the smallest id of an interval.
Children, leaves and savings are differences of sums in order of depth first, so no stack and no tree of objects is built.

Prefixes of a task's first or last row may go on in another task. Only these are summed up across tasks: what a task knows of
them (a row a depth for its first and its last sequence) meets in one task, which therefore holds two paths a task and never
a member. The ids of conversations that end at such a prefix come as one text a task and are hashed one after the other; a
digest of all of them in order can't be taken in another way, and no task holds more than one such text.

Defined results: rows without a conversation id belong to no conversation and are left out; turns are ordered by turn (null
first), then role, then the digest of the text; a null role or text is an empty one; repeated rows are turns of their own;
ids may be negative (c - c % 20 goes towards zero); no conversations give no nodes, not even a root; other columns are left
out. A conversation's digests (20 bytes a turn) must fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, forgotten, parallelism, sized, stored
from .spelling_variants import CRC_SQL, crc_sql

DIGEST = 16
#: Sequences that a task gets, on average.
ROWS = 1 << 15
NODE = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ids binary"
CLOSED, OPEN, ENDS = 0, 1, 2


def sequences(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of rows that are a turn each: the digest and the number of words of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    n = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text).alias("text"), digest.alias("digest"), n.alias("n"))
    own = rows.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"))
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n")))
    return own.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(found: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Conversations with the first h turns of the block's first one in the place of their own first h: h is crc32 of the id,
    modulo ``heads``. A block's first conversation meets at most two blocks of ids."""
    found = found.withColumn("h", crc_mod(F.col("conv_id"), heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    first = found.filter(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, heads - 1).alias("lead"))
    own = found.join(first, "base", "left")
    lead = F.when(F.col("h") > 0, F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(lead, rest).alias("turns"))


class Minima:
    """A sparse table: the minimum of every 2**k neighbouring values, and so of any range."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of each range, ends inclusive."""
        k = np.log2(hi - lo + 1).astype(np.int64)
        k -= (1 << k) > hi - lo + 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.levels[level][lo[at]], self.levels[level][hi[at] - (1 << level) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far a value of at least ``least`` goes on from each place: the first place from ``at`` with a smaller value."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            go = at < len(table)
            go[go] = table[at[go]] >= least[go]
            at[go] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The same to the left: the first place of those right before ``at`` that all are at least ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            table = self.levels[k]
            go = at >= 1 << k
            go[go] = table[at[go] - (1 << k)] >= least[go]
            at[go] -= 1 << k
        return at


def common_turns(items: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The turns that each sequence has in common with the next one, from the first turn on."""
    size = np.diff(off)
    both = np.minimum(size[:-1], size[1:])
    begin = np.cumsum(both) - both
    place = np.arange(both.sum()) - np.repeat(begin, both)
    unlike = np.flatnonzero((items[np.repeat(off[:-2], both) + place] != items[np.repeat(off[1:-1], both) + place]).any(axis=1))
    pair = np.repeat(np.arange(len(both)), both)[unlike]
    out = both.copy()
    first = np.unique(pair, return_index=True)
    out[first[0]] = place[unlike[first[1]]]
    return out


def path_keys(sequence: memoryview, depth: int) -> list[bytes]:
    """A key for each prefix of a sequence of digests, from that of no turn to that of ``depth``."""
    state = hashlib.blake2b(digest_size=DIGEST)
    out = [state.digest()]
    for d in range(depth):
        state.update(sequence[d * DIGEST : (d + 1) * DIGEST])
        out.append(state.digest())
    return out


def local_nodes(conv: np.ndarray, items: np.ndarray, off: np.ndarray, n_words: np.ndarray) -> dict[str, list]:
    """The rows (``NODE``) of one task's sorted sequences: nodes that lie inside, what is known of those that may go on
    elsewhere, and the ids that end at these. items: the digests, as two numbers each; off: where sequences start."""
    n = len(conv)
    size = np.diff(off)
    common = common_turns(items, off)
    shared = Minima(common)
    fresh = np.concatenate([[-1], common])  # the depth that a row shares with the row before
    count = size - fresh
    node_off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - node_off[row] + fresh[row] + 1
    left, right = shared.left(row, depth), shared.right(row, depth)
    convs = right - left + 1
    smallest = Minima(conv).of(left, right)
    up = shared.left(row, depth - 1)  # the parent's first row
    parent = np.where(depth > 0, node_off[up] + depth - 1 - fresh[up] - 1, -1)
    is_open = (left == 0) | (right == n - 1)
    last_words = np.where(depth > 0, n_words[np.minimum(off[row] + np.maximum(depth - 1, 0), max(len(n_words) - 1, 0))] if len(n_words) else 0, 0)
    children = np.bincount(parent[parent >= 0], minlength=len(row))
    closed = ~is_open
    closed_children = np.bincount(parent[(parent >= 0) & closed], minlength=len(row))
    # nodes are in order of depth first, and a node's subtree is all nodes of the interval's rows that are as deep or deeper
    leaf = np.concatenate([[0], np.cumsum(closed & (children == 0))])
    saved = np.concatenate([[0], np.cumsum(np.where(closed, (convs - 1) * last_words, 0))])
    begin, end = np.arange(len(row)), node_off[right + 1]
    # conversations that end at a node come first in its interval, in order of their ids
    same = np.flatnonzero(size[row] == depth)
    run_end = np.append(np.flatnonzero((common != size[:-1]) | (size[:-1] != size[1:])), n - 1)  # last row of each run of copies
    until = run_end[np.searchsorted(run_end, row[same])]
    texts = np.char.mod("%d", conv) if n else np.zeros(0, "U1")
    told: dict[int, bytes] = {i: ",".join(texts[a : b + 1].tolist()).encode() for i, a, b in zip(same.tolist(), row[same].tolist(), until.tolist(), strict=True)}

    raw = memoryview(items.view(np.uint8).reshape(-1))
    keys: dict[int, bytes] = {}
    for r in {0, n - 1}:
        path = path_keys(raw[off[r] * DIGEST : off[r + 1] * DIGEST], int(size[r]))
        at = np.zeros(len(path), np.int64) + r
        d = np.arange(len(path))
        first = shared.left(at, d)
        keys.update(zip((node_off[first] + d - fresh[first] - 1).tolist(), path, strict=True))
    nothing = hashlib.sha256(b"").hexdigest()
    out: dict[str, list] = {x.split()[0]: [] for x in NODE.split(", ")}
    parents = parent.tolist()
    is_open_ = is_open.tolist()
    total = len(row)
    out["kind"] = np.where(is_open, OPEN, CLOSED).tolist()
    out["key"] = [keys[i] if o else None for i, o in enumerate(is_open_)]
    out["parent_key"] = [keys.get(p) if p >= 0 else None for p in parents]
    out["conv_id"], out["depth"], out["n_convs"], out["words"] = smallest.tolist(), depth.tolist(), convs.tolist(), last_words.tolist()
    out["parent_conv_id"] = [None if p < 0 or is_open_[p] else x for p, x in zip(parents, smallest[np.maximum(parent, 0)].tolist(), strict=True)]
    out["n_children"] = np.where(is_open, closed_children, children).tolist()
    out["n_leaves"], out["saved_tokens"] = (leaf[end] - leaf[begin]).tolist(), (saved[end] - saved[begin]).tolist()
    out["ends_sha256"] = [None if o else hashlib.sha256(told[i]).hexdigest() if i in told else nothing for i, o in enumerate(is_open_)]
    out["ids"] = [None] * total
    for i in same.tolist():
        if is_open_[i]:
            for name in out:
                out[name].append({"kind": ENDS, "key": keys[i], "conv_id": int(conv[row[i]]), "ids": told[i]}.get(name))
    return out


def merged_nodes(part: dict[str, np.ndarray | list]) -> dict[str, list]:
    """Nodes of which several tasks know a part, from all of these parts: sums of what is closed, and what open ones add."""
    code: dict[bytes, int] = {}
    at = np.array([code.setdefault(k, len(code)) for k in part["key"]], np.int64)
    m = len(code)
    first = np.zeros(m, np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    add = lambda c: _sums(at, np.asarray(part[c], np.int64), m)
    depth, words = np.asarray(part["depth"])[first], np.asarray(part["words"])[first]
    convs, children, leaves, saved = (add(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    smallest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, np.asarray(part["conv_id"]))
    parent = np.array([code[part["parent_key"][i]] if part["parent_key"][i] is not None else -1 for i in first.tolist()], np.int64)
    np.add.at(children, parent[parent >= 0], 1)
    own_leaves, own_saved = (children == 0).astype(np.int64), (convs - 1) * words  # what open nodes themselves add above
    order = np.argsort(depth, kind="stable")
    borders = np.append(np.flatnonzero(np.diff(depth[order], prepend=-1)), m)
    for a, b in reversed(list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))):  # the deepest first
        own = order[a:b][parent[order[a:b]] >= 0]
        np.add.at(own_leaves, parent[own], own_leaves[own])
        np.add.at(own_saved, parent[own], own_saved[own])
    leaves, saved = leaves + own_leaves, saved + own_saved
    return {
        "key": list(code), "conv_id": smallest.tolist(), "depth": depth.tolist(), "parent_conv_id": [int(smallest[p]) if p >= 0 else None for p in parent.tolist()], "n_convs": convs.tolist(),
        "n_children": children.tolist(), "n_leaves": leaves.tolist(), "saved_tokens": saved.tolist(),
    }


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def trie(found: DataFrame, rows: int = ROWS) -> DataFrame:
    """The nodes of conversations (conv_id, turns: digest and words), a row each. ``rows``: sequences a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = found.sparkSession
    kinds = to_arrow_schema(T._parse_datatype_string(NODE))
    whole = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    own = stored(found.select("conv_id", F.unhex(whole).alias("sequence"), F.transform("turns", lambda x: x["n"]).alias("n_words")), "prefix-sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), own_schema).combine_chunks()
        if not held.num_rows:
            return
        column = held.column("sequence").combine_chunks().cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        items = np.ascontiguousarray(raw).view(np.uint64).reshape(-1, 2)
        n_words = held.column("n_words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        made = pa.table([pa.array(c, kinds.field(k).type) for k, c in local_nodes(held.column("conv_id").to_numpy(), items, (off - off[0]) // DIGEST, n_words).items()], schema=kinds)
        yield from made.to_batches(max_chunksize=10_000)

    own_schema = to_arrow_schema(own.schema)
    parts = max(parallelism(spark), -(-own.count() // rows))
    local = stored(own.repartitionByRange(parts, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").mapInArrow(run, NODE), "prefix-nodes")
    forgotten(own)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(merged_nodes(table.to_pydict()), out_schema)])

    merged_type = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    out_schema = to_arrow_schema(T._parse_datatype_string(merged_type))
    paths = local.filter(F.col("kind") == OPEN).select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")
    merged = stored(paths.groupBy(F.lit(0).alias("all")).applyInArrow(merge, merged_type), "prefix-merged")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            for k, ids in zip(batch.column("key"), batch.column("ids"), strict=True):
                k = k.as_py()
                if key is not None and k != key:
                    yield _batch({"key": [key], "ends_sha256": [state.hexdigest()]}, ends_schema)
                if k != key:
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
        if key is not None:
            yield _batch({"key": [key], "ends_sha256": [state.hexdigest()]}, ends_schema)

    ends_schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    texts = local.filter(F.col("kind") == ENDS).select("key", "conv_id", "ids")
    ends = texts.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    across = merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).select(*columns)
    closed = local.filter(F.col("kind") == CLOSED)
    inner = closed.filter("parent_key is null").select(*columns)
    outer = closed.filter("parent_key is not null").drop("parent_conv_id").join(sized(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))), "parent_key").select(*columns)
    return inner.unionByName(outer).unionByName(across)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the nodes of all conversations, rebuilt so that those of a block begin alike."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(sequences(rows)))


SQL = rf"""
WITH {CRC_SQL},
c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM c), crc_table),
r AS (
  SELECT ids.conv_id, 0 AS own, i, role, text FROM ids JOIN c ON c.conv_id = base AND i <= h
  UNION ALL SELECT ids.conv_id, 1, i, role, text FROM ids JOIN c ON c.conv_id = ids.conv_id AND i > h),
s AS MATERIALIZED (
  SELECT ids.conv_id, coalesce(q, []) AS q, coalesce(w, []) AS w FROM ids LEFT JOIN (
    SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY own, i) AS q, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY own, i) AS w
    FROM r GROUP BY 1) x ON x.conv_id = ids.conv_id),
p AS (SELECT conv_id, q, w, unnest(range(0, len(q) + 1)) AS depth FROM s),
n AS MATERIALIZED (
  SELECT list_slice(q, 1, depth) AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN w[depth] ELSE 0 END) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(q) = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL),
kids AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN kids ON n.k = kids.k),
under AS (SELECT list_slice(k, 1, d) AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN under ON f.k = under.k LEFT JOIN n up ON f.depth > 0 AND up.k = list_slice(f.k, 1, f.depth - 1)
"""
