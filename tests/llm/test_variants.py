"""Spelling variants: brute force over edits, checksums, pivots, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import spelling_variants as sv


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(counts: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted(((-m, o) for o, m in counts.items() if near(w, o)))
        best = others[0] if others else None
        form[w] = (best[1] if best and -best[0] >= ratio * n else None, len(others))
    for w, n in counts.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out[w] = (form[w][0], root, n, form[w][1], counts[form[w][0]] if form[w][0] else None)
    return out


def made(seed: int, letters: str, n: int) -> dict[str, int]:
    """Words and words near them, with far counts."""
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        for _ in range(rng.randint(1, 5)):
            out.setdefault(w, rng.choice([2, 3, 25, 400, 9000]))
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])
            if len(w) < 7:
                break
    return out


@pytest.mark.parametrize(("letters", "n"), [("ab", 60), ("abcdeé", 250), ("abcdefghijklmnopqrstuvwxyzÿ÷", 250)])
def test_variants_by_brute_force(spark, letters, n):
    counts = made(len(letters), letters, n)
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 500, "a" * 3000: 4, "a" * 2999 + "b": 60}
    found = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.variants(found).collect()}
    assert got == brute(counts)


def test_words_by_brute_force(spark):
    import re

    texts = [(1, "Straße straßE naïveté NAÏVETÉ ÀÉÎÕÜÝÞß ×÷×÷×÷×÷ word42words abcdefg"), (2, None), (None, "ABCDEFGH abcdefgh"), (3, ""), (4, "x" * 5000 + " " + "Y" * 60), (4, "same text twice abcdefgh"), (4, "same text twice abcdefgh"), (5, "日本語текст abcdefgh\x00abcdefgh")]
    texts += [(i, " ".join("".join(random.Random(i * 100 + j).choices("abcdé", k=8)) for j in range(60))) for i in range(10, 40)]
    want: Counter = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                want[run] += 1
    got = {r.word: r.n for r in sv.counted_words(spark.createDataFrame(texts, "doc_id long, text string"), drop=31).collect()}
    assert got == want


def test_checksums():
    words = ["", "a", "héé", "x" * 47, "y" * 48, "z" * 49, "long" * 400]
    raw = "".join(words).encode()
    end = np.cumsum([len(w.encode()) for w in words])
    start = np.concatenate([[0], end[:-1]])
    seed = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(words))], np.uint32)
    got = sv.checksums(np.frombuffer(raw, np.uint8), start, end, seed)
    assert got.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in enumerate(words)]


def test_pivots_are_the_lightest_disjoint_pair():
    rng = np.random.default_rng(1)
    place = np.sort(np.array([rng.choice(9, 3, replace=False) for _ in range(300)]), axis=1)
    weight = rng.integers(0, 50, (300, 3))
    one, two = sv.pivots(weight, place)
    for i in range(300):
        pairs = [(weight[i, a] + weight[i, b]) for a in range(3) for b in range(a + 1, 3) if place[i, b] - place[i, a] >= 2]
        assert place[i, two[i]] - place[i, one[i]] >= 2
        assert weight[i, one[i]] + weight[i, two[i]] == min(pairs)


def test_grams_of_two_byte_letters():
    g = sv.Grams(pa.array(["aéb", "ÿÿ", "", "x"]))
    assert g.code.tolist() == [0x61E9, 0xE962, 0xFFFF]
    assert g.size.tolist() == [3, 2, 0, 1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n long")
    assert sv.variants(sv.counted_words(empty)).collect() == []
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert sv.counted_words(nulls).collect() == []


def test_a_hot_word_and_clashing_columns(spark):
    """A third of all words are one, and columns are named like results."""
    rows = [(i, "entente " * 50 + f"entent{'abcde'[i % 5]}e ententes", i, "x", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, word string, form long")
    got = {r.word: r for r in sv.variants(sv.counted_words(df)).collect()}
    assert got["entente"].n == 10_000
    assert got["ententes"].form == "entente" and got["ententes"].n_near == 2  # entente and ententee
    assert {got[f"entent{c}e"].root for c in "abcde"} == {"entente"}
