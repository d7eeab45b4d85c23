"""Quality rules with thresholds that follow the data.

Each text is measured in one pass. The measures of each language and source go into quantile sketches (KLL), which are
summed up before the shuffle and merge: those of a language's sources give the language's, and these the corpus's. A
measure's fence is its upper quartile plus ``REACH`` times the spread between the quartiles (a least spread keeps a measure
that is nearly constant from rejecting everything else), below likewise where a measure has a lower side. A group's own
fence counts with its n texts, its language's with ``PRIOR`` texts, and so does the corpus's in the language's: (n * own + PRIOR *
wider) / (n + PRIOR), at every size. The fences are joined to the documents by language and source, and documents beyond any
fence are rejected.

A sketch keeps all values of a group of up to ``SKETCH_K`` texts; beyond, its ranks are off by about 1 % and drawn at random, so
fences of large groups, and verdicts of texts that lie right at them, may differ a little from run to run.

Defined results: null text has no words and fails; null language or source is a group of its own; texts without words take
no part in the sketches; repeated rows count each; other columns stay, but those with a result's name are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, documents, freed, text_batches
from .textbuf import SPACE, covered, mix, per_row, pieces, spans_hash, texts_of, windows, words

WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
SKETCH_K, PRIOR, REACH = 400, 50, 3.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Measure: (expression of the counts, least spread, whether low values are rejected too).
MEASURES = {
    "symbol_share": ("n_symbols / word_chars", 0.02, False),
    "dup_line_share": ("n_dup_lines / n_lines", 0.05, False),
    "repeat_share": ("n_repeat_words / n_words", 0.05, False),
    "word_length": ("word_chars / n_words", 0.8, True),
}


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with COUNTS of each text as long columns."""
    text_batches(df.sparkSession)
    df = freed(df, COUNTS, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                n = part.num_rows
                buf, off = texts_of(part.column(text_col))
                start, end, row = words(buf, off)
                win, at = windows(spans_hash(buf, start, end), row, WINDOW)
                _, of, times = np.unique(mix(win + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
                again = covered(len(row), at[times[of] > 1], WINDOW)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (~SPACE[buf] & ((buf & 0xC0) != 0x80), SYMBOLS[buf])]
                chars, symbols = (x[off[1:]] - x[off[:-1]] for x in sums)
                lines = []
                for text in part.column(text_col).to_pylist():
                    own = [x for x in (text or "").split("\n") if x.strip(" \t\r\v\f")]
                    lines.append((len(own), len(own) - len(set(own))))
                lines = np.array(lines, np.int64).reshape(n, 2)
                found = (per_row(np.ones(len(row)), row, n), chars, symbols, lines[:, 1], per_row(again, row, n), lines[:, 0])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*part.schema.names, *COUNTS])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def measured(counts: DataFrame) -> DataFrame:
    """counts with MEASURES; null without words."""
    return counts.withColumns({k: F.when(F.col("n_words") > 0, F.expr(v[0]).cast("double")) for k, v in MEASURES.items()})


def _fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, n and <measure>_low, <measure>_high from one sketch a measure."""
    out = [F.expr("kll_sketch_get_n_double(symbol_share)").alias("n")]
    for k, (_, least, low) in MEASURES.items():
        q = [F.expr(f"kll_sketch_get_quantile_double({k}, {p}D)") for p in (0.25, 0.75)]
        spread = F.greatest(q[1] - q[0], F.lit(least)) * REACH
        out += [(q[0] - spread if low else F.lit(None).cast("double")).alias(f"{k}_low"), (q[1] + spread).alias(f"{k}_high")]
    return sketches.select(*by, *out)


def thresholds(measures: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The fences that hold for each language and source: (lang, source, n, <measure>_low, <measure>_high)."""
    names = list(MEASURES)
    own = measures.filter(F.col("n_words") > 0).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *names)
    group = own.groupBy("lang", "source").agg(*(F.kll_sketch_agg_double(k, SKETCH_K).alias(k) for k in names))
    language = group.groupBy("lang").agg(*(F.kll_merge_agg_double(k).alias(k) for k in names))
    corpus = language.agg(*(F.kll_merge_agg_double(k).alias(k) for k in names))
    sides = ["n", *(f"{k}_{side}" for k in names for side in ("low", "high"))]
    of_group = _fences(group, ["lang", "source"])
    of_lang = _fences(language, ["lang"]).select(F.col("lang").alias("l_lang"), *(F.col(c).alias(f"l_{c}") for c in sides))
    of_all = _fences(corpus, []).select(*(F.col(c).alias(f"c_{c}") for c in sides))
    joined = of_group.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).crossJoin(of_all)  # of_all is one row
    blend = lambda n, own, wider: (F.col(n) * own + PRIOR * wider) / (F.col(n) + PRIOR)
    fence = [blend("n", F.col(c), blend("l_n", F.col(f"l_{c}"), F.col(f"c_{c}"))).alias(c) for c in sides[1:]]
    return joined.select("lang", "source", "n", *fence)


def judged(measures: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measures with within, false beyond any fence, and outside, the names of the measures that are beyond."""
    names = [f"{k}_{side}" for k in MEASURES for side in ("low", "high")]
    fences = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in names))
    on = measures[lang_col].eqNullSafe(F.col("__lang")) & measures[source_col].eqNullSafe(F.col("__source"))
    beyond = [F.when((F.col(k) > F.col(f"__{k}_high")) | (F.col(k) < F.col(f"__{k}_low")), F.lit(k)) for k in MEASURES]
    joined = measures.join(fences, on, "left").withColumn("outside", F.array_compact(F.array(*beyond)))
    return joined.withColumn("within", F.size("outside") == 0).drop("__lang", "__source", *(f"__{c}" for c in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts of every document, the base rules and the adaptive verdict."""
    counts = counted(documents(spark, sf_dir).select("doc_id", "lang", "source", "text")).drop("text")
    measures = measured(checkpointed(counts))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    done = judged(measures, thresholds(measures)).withColumn("base_failed", failed)
    return done.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.col("within")).alias("kept"), "outside")
