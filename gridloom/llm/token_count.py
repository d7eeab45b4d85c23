"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the token counts of frequent pre-tokens, made from counts over all texts and broadcast; its
entries are bounded by ``entries`` (default 65,536 of at most 32 bytes, some 2 MB), so it never grows with the data. Tier
two is a cache in each worker, which encodes what tier one misses. Pre-tokens are never shuffled: the frequent ones are
found from a bounded list of leaders of each partition.

The count of a text is the sum over its pre-tokens, because the model merges inside a pre-token only; special strings are
one token each and split the text, as the library does by default.

Defined results: null and empty text count 0 tokens and 0 bytes; repeated rows each get their count; other columns stay,
but one that has the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freed, text_batches
from .textbuf import LOWER, NOT_ALNUM, pieces, spans_hash, texts_of, words

MODEL_FILE = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of the broadcast table, bytes of an entry, leaders that one partition names, pre-tokens a worker keeps, and
#: characters of the longest of these.
ENTRIES, LONGEST, LEADERS, CACHE, KEPT = 65_536, 32, 8_192, 400_000, 256
#: White space as the library's pattern engine has it.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Characters that normalising only lower-cases, one by one.
_PLAIN = regex.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x9, 0xD), (0x20, 0x7E), (0xA0, 0x12F), (0x132, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))) + "]")


class WordBpe(dict):
    """Token counts of pre-tokens: a fixed table, and a cache of what the table lacks, filled by the model."""

    def __init__(self, model_json: bytes, table: dict[str, int]):
        from tokenizers import Tokenizer

        self.table = table
        super().__init__(table)
        self.tokenizer = Tokenizer.from_str(model_json.decode())
        spec = json.loads(model_json)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]"))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(letters)]
        self.letter = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
        n = len(self.tokenizer.model.tokenize("".join(map(self.letter.__getitem__, piece.encode()))))
        if len(piece) <= KEPT:
            self[piece] = n
        return n

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if _PLAIN.search(text) else text.lower()

    def count(self, text: str) -> int:
        if self.special and any(x in text for x in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        text = self.normal(text)
        if len(text) < 1 << 22:
            return sum(map(self.__getitem__, self.split.findall(text)))
        return sum(self[x.group()] for x in self.split.finditer(text))


def leaders(df: DataFrame, text_col: str = "text", most: int = LEADERS) -> DataFrame:
    """The most frequent words of each partition with their counts there, at most ``most`` a partition: (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            for part in pieces(batch, text_col):
                buf, off = texts_of(part.column(text_col))
                low = LOWER[buf]
                start, end, _ = words(low, off, NOT_ALNUM)
                short = end - start <= LONGEST
                start, end = start[short], end[short]
                found, first, count = np.unique(spans_hash(low, start, end), return_index=True, return_counts=True)
                lead = np.argsort(-count, kind="stable")[: 2 * most]
                raw = low.tobytes()
                new = np.array([raw[a:b] for a, b in zip(start[first[lead]].tolist(), end[first[lead]].tolist(), strict=True)], object)
                both = np.concatenate([key, found[lead]])
                key, at, back = np.unique(both, return_index=True, return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, count[lead]]), minlength=len(key)).astype(np.int64)
                word = np.concatenate([word, new])[at]
                if len(key) > 4 * most:
                    lead = np.sort(np.argsort(-n, kind="stable")[: 2 * most])
                    key, n, word = key[lead], n[lead], word[lead]
        lead = np.argsort(-n, kind="stable")[:most]
        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "ignore") for x in word[lead]], pa.string()), pa.array(n[lead])], names=["word", "n"])

    return df.select(text_col).mapInArrow(run, "word string, n long")


def frequent(df: DataFrame, text_col: str = "text", entries: int = ENTRIES) -> list[str]:
    """The ``entries`` words that lead most, counted over all texts."""
    total = leaders(df, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in total.orderBy(F.desc("n"), "word").limit(entries).collect()]


_loaded: dict[bytes, WordBpe] = {}


def _counter(held) -> WordBpe:
    model, names, counts = held.value
    key = hashlib.sha256(b"\0".join((hashlib.sha256(model).digest(), names.encode(), counts))).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(model, dict(zip(names.split("\n"), np.frombuffer(counts, np.uint8).tolist(), strict=True)) if names else {})
    return _loaded[key]


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", out: str = "n_tokens", entries: int = ENTRIES) -> DataFrame:
    """df with the tokens of each text as ``out`` long. ``model_path`` is read where this is called."""
    with open(model_path, "rb") as f:
        model = f.read()
    text_batches(df.sparkSession)
    df = freed(df, [out], text_col)
    first = WordBpe(model, {})
    names = [w for w in frequent(df, text_col, entries) if first.split.findall(first.normal(w)) == [w]]
    table = {w: first[w] for w in names}
    held = df.sparkSession.sparkContext.broadcast((model, "\n".join(table), np.array(list(table.values()), np.uint8).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held)
        for batch in batches:
            for part in pieces(batch, text_col):
                n = [counter.count(x.as_py() or "") for x in part.column(text_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: tokens of every document."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path(MODEL_FILE))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
