"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir), reads nothing of the documents but docs, and returns the columns of documents; the
last returns the token ids. Stages are written as Parquet and read again, in the folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, decontaminate, language_id, near_dedup, secret_scan
from gridloom.llm.common import documents, forgotten, stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the models know."""
    return language_id.kept(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminated(docs, decontaminate.benchmark(spark, sf_dir))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of secrets."""
    return secret_scan.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(byte_bpe.RANK_FILE), public_tokenizers.PATTERN
    back = byte_bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("near_dedup", dedup),
    ("decontaminate", decontaminated),
    ("secret_scan", without_secrets),
    ("byte_bpe", encoded),
]

#: Character models and hashed signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forgotten(before)
    return STAGES[-1][1](spark, docs, sf_dir)
