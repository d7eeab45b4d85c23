"""The n-gram model: plain dictionaries, probabilities that add up, any chunks and slices, kept models, odd input."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import kneser_ney as kn
from gridloom.llm.substring_dedup import Sizes

START, END = "<s> ", "</s> "


class Plain:
    """The model by its formula, in dictionaries."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        seqs = [[START, *t.split(), END] for t in texts]
        grams = [Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1)) for k in range(1, order + 1)]
        self.a = [dict() for _ in range(order)]
        self.a[-1] = dict(grams[-1])
        for k in range(order - 1, 0, -1):
            before = Counter(g[1:] for g in grams[k])
            self.a[k - 1] = {g: before[g] if g[0] != START else n for g, n in grams[k - 1].items() if g != (START,)}
        self.types, self.count = len(self.a[0]), Counter(w for s in seqs for w in s[1:])
        self.d, self.follow = [], []
        for a in self.a:
            n = [sum(x == j for x in a.values()) for j in (1, 2, 3, 4)]
            self.d.append(kn.discounts_of(*n))
            follow = defaultdict(lambda: [0, 0, 0, 0])
            for g, x in a.items():
                follow[g[:-1]][0] += x
                follow[g[:-1]][min(x, 3)] += 1
            self.follow.append(dict(follow))

    def p(self, word: str, history: tuple) -> float:
        out = 1 / (self.types + 1)
        for k in range(1, min(self.order, len(history) + 1) + 1):
            h = history[len(history) - k + 1 :]
            if h in self.follow[k - 1]:
                total, *n = self.follow[k - 1][h]
                x = self.a[k - 1].get((*h, word), 0)
                out = max(x - (0, *self.d[k - 1])[min(x, 3)], 0) / total + sum(d * m for d, m in zip(self.d[k - 1], n)) / total * out
        return out

    def score(self, text: str) -> float:
        s = [START, *text.split(), END]
        return sum(math.log10(self.p(s[i], tuple(s[max(0, i - self.order + 1) : i]))) for i in range(1, len(s)))


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh")[: rng.randint(1, 1)] * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("order", "sizes"), [(2, None), (3, None), (3, Sizes(40, 30, 0, 8)), (5, Sizes(300, 100, 0, 8))])
def test_scores_by_formula(spark, order, sizes):
    """However texts are cut into chunks and n-grams into slices."""
    all_ = texts(order, 80)
    plain = Plain([t for i, t in enumerate(all_) if i % 4], order)
    df = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string").repartition(3)
    model, got = kn.learned(df, learn=F.col("doc_id") % 4 != 0, order=order, sizes=sizes)
    assert model.types == plain.types and model.tokens == sum(plain.count.values())
    assert [y for x in model.discounts for y in x] == pytest.approx([y for x in plain.d for y in x])
    got = {r.doc_id: r for r in got.collect()}
    n, v = model.tokens, model.types
    for i, t in enumerate(all_):
        tokens = [*t.split(), END]
        assert got[i].score == pytest.approx(plain.score(t), abs=1e-9)
        assert got[i].n_tokens == len(tokens) and got[i].n_known == sum(plain.count[w] > 0 for w in tokens)
        assert got[i].base_score == pytest.approx(sum(math.log10((plain.count[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)


def test_probabilities_add_up():
    plain = Plain(texts(5, 60), 3)
    for h in [(), ("a",), ("a", "b"), (START,), (START, "cc"), ("zz", "zz")]:
        words = [g[0] for g in plain.a[0]]
        assert sum(plain.p(w, h) for w in words) + plain.p("never seen", h) == pytest.approx(1)


def test_a_kept_model_scores_other_texts(spark):
    own, other = texts(1, 60), [*texts(2, 20), "", "all new words here", None]
    plain = Plain(own, 3)
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    model, scored = kn.learned(df, keep=True, sizes=Sizes(200, 50, 0, 8))
    again = {r.doc_id: r for r in kn.perplexity(df, model, sizes=Sizes(90, 50, 0, 8)).collect()}
    for r in scored.collect():
        assert (again[r.doc_id].score, again[r.doc_id].n_known, again[r.doc_id].base_score) == pytest.approx((r.score, r.n_known, r.base_score))
    names = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(other)], "name string, body string")
    got = {r.name: r for r in kn.perplexity(names, model, "name", "body").collect()}
    for i, t in enumerate(other):
        want = plain.score(t or "")
        assert got[f"k{i}"].score == pytest.approx(want)
        assert got[f"k{i}"].perplexity == pytest.approx(10 ** (-want / got[f"k{i}"].n_tokens))
    # slices are sorted hash arrays, each n-gram in one slice
    for k in (1, 2, 3):
        hashes = [np.cumsum(kn.unpacked(r.hashes), dtype=np.uint64) for r in model.slices.filter(F.col("order") == k).collect()]
        assert all((np.diff(h) > 0).all() for h in hashes)
        assert sum(map(len, hashes)) == len(plain.a[k - 1]) + (k == 1)  # the start has no number, but words follow it
    with pytest.raises(ValueError, match="kept"):
        kn.perplexity(df, kn.learned(df)[0])


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, ties, columns named like results."""
    long = " ".join(f"w{i % 1000}" for i in range(100_000))
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n\x0b ", 5), (None, "No ID", 5), (4, "Same TEXT", 5), (4, "same text", 5), (5, long, 5), (6, "x" * 100_000, 5), (7, "日本語 текст \x00", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    plain = Plain([(t or "").lower() if t and t.isascii() else t or "" for _, t, _ in rows], 3)
    got = sorted(((r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in kn.learned(df)[1].collect()))
    want = sorted((i or 0, len((t or "").split()) + 1, round(plain.score((t or "").lower() if t and t.isascii() else t or ""), 6)) for i, t, _ in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, got = kn.learned(df, learn=F.lit(None).cast("boolean"))
    assert (model.tokens, model.types) == (0, 0)
    assert {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in got.collect()} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    assert kn.learned(df.limit(0))[1].collect() == []
    with pytest.raises(ValueError, match="order"):
        kn.learned(df, order=1)


def test_slices_are_mapped():
    part = kn.Slice(np.array([3, 5, 9], np.uint64), [np.array([1, 2, 3]), np.array([4, 5, 6])])
    assert isinstance(part.hashes, np.memmap)
    at, there = part.find(np.array([5, 9, 10], np.uint64))
    assert there.tolist() == [True, True, False] and part.sums[1][at[:2]].tolist() == [5, 6]
