"""Benchmarks of several blocks and passes, and the memory of a block."""

import json
import subprocess
import sys

import pytest

from gridloom.llm import decontaminate

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_blocks_and_passes_agree(spark, monkeypatch, blocks):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    row = lambda r: (r.doc_id, r.n_words, r.n_hit, r.longest, tuple(r["items"]), r.hits and bytes(r.hits))
    want = sorted(map(row, decontaminate.find_matches(docs, items).collect()))
    assert any(w[2] for w in want)
    monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
    assert sorted(map(row, decontaminate.find_matches(docs, items, block_bytes=3000).collect())) == want


MEASURE = """
import json, resource, sys
sys.path.insert(0, {root!r})
import random
from gridloom.llm.decontaminate import BLOCK_BYTES, Items, WINDOW
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60_000)]
texts = [" ".join(rng.choices(words, k=200)) for _ in range(BLOCK_BYTES // 1300)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Items([str(i) for i in range(len(texts))], texts, WINDOW)
print(json.dumps([sum(map(len, texts)), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024]))
"""


def test_memory_of_a_block():
    root = decontaminate.__file__.rsplit("/gridloom/", 1)[0]
    done = subprocess.run([sys.executable, "-c", MEASURE.format(root=root)], capture_output=True, text=True, check=True)
    size, mb = json.loads(done.stdout.strip().splitlines()[-1])
    assert size > 0.9 * decontaminate.BLOCK_BYTES and mb < 400
