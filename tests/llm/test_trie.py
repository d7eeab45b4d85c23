"""The trie of prefixes: brute force over all prefixes, range minima, rebuilding, odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * words
    sha = lambda who: hashlib.sha256(",".join(map(str, sorted(who))).encode()).hexdigest()
    ended = lambda k, who: [c for c in who if len(convs[c]) == len(k)]
    return sorted(((min(w), len(k), min(members[k[:-1]]) if k else None, len(w), children[k], leaves[k], saved[k], sha(ended(k, w))) for k, w in members.items()), key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def table(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("seed", "rows"), [(1, 1 << 17), (2, 7), (3, 1), (4, 20)])
def test_trie_by_brute_force(spark, seed, rows):
    """Many copies, prefixes of each other, and long runs of one turn; cut into few or many tasks."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "a b", "c  d e", "\tf\n"]))
    convs: dict[int, list] = {}
    for c in range(120):
        convs[c * 3 - 50] = [turn() for _ in range(rng.randint(1, 5))] if c % 3 else convs.get((c - 1) * 3 - 50, [turn()])[: rng.randint(1, 5)]
    for c in range(1000, 1060):  # a third are copies of one
        convs[c] = [("user", "hello there"), ("assistant", "hello")]
    convs[5000] = [("user", "again and again")] * 300
    found = pt.sequences(table(spark, convs))
    assert got(pt.trie(found, rows)) == brute(convs)


def test_rebuilt_by_brute_force(spark):
    rng = random.Random(9)
    own = {c: [(rng.choice("ua"), f"t{rng.randint(0, 3)}") for _ in range(rng.randint(1, 6))] for c in range(0, 130) if c % 7 and c not in (40, 60)}
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert got(pt.trie(pt.rebuilt(pt.sequences(table(spark, own))), 16)) == brute(want)


def test_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, columns named like results."""
    rows = [(None, 1, "user", "x", 1, "k"), (1, None, "user", "first", 2, "k"), (1, 0, None, None, 3, "k"), (1, 0, None, None, 3, "k"), (2, 5, "user", "first", 1, None), (2, 5, "assistant", "w" * 100_000, 1, None), (3, 0, "user", "", 0, "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, key string")
    convs = {1: [("user", "first"), ("", ""), ("", "")], 2: [("assistant", "w" * 100_000), ("user", "first")], 3: [("user", "")]}
    assert got(pt.trie(pt.sequences(df))) == brute(convs)
    assert pt.trie(pt.rebuilt(pt.sequences(df.limit(0)))).collect() == []


def test_minima():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.integers(0, 6, n)
        m = pt.Minima(v)
        lo = rng.integers(0, n, 50)
        hi = np.minimum(lo + rng.integers(0, n, 50), n - 1)
        assert m.of(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]
        at, d = rng.integers(0, n + 1, 50), rng.integers(0, 6, 50)
        right = [next((j for j in range(a, n) if v[j] < x), n) for a, x in zip(at, d)]
        left = [next((j + 1 for j in range(a - 1, -1, -1) if v[j] < x), 0) for a, x in zip(at, d)]
        assert m.right(at, d).tolist() == right
        assert m.left(at, d).tolist() == left
