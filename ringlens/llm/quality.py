"""Quality rules with thresholds that adapt to each language and source.

Every text gets base counts and four measures: characters per word, symbols per word, share of repeated words, and
repeated lines per line. For each (language, source) the distribution of each measure is held in a mergeable
quantile sketch: counts of logarithmic buckets, in which any quantile is within ``ACCURACY`` of its value and
which merge by adding, so partial sketches combine before the shuffle, a hot source costs a few hundred buckets, and
sketches of sources merge into those of languages and of all texts. The fences

    low = q25 - REACH * max(q75 - q25, least spread),  high = q75 + REACH * max(q75 - q25, least spread)

(no spread is taken as less than the sketch can tell apart, twice ``ACCURACY`` of q75) come from the sketch of the source, of its language where the source has under ``ENOUGH`` texts of it, or of all
texts where the language has too few. Texts outside a fence fail; so do those that fail the base rules
(under 20 words, or over 30 % of the words repeated).

Null texts have no words and fail; null languages and sources are groups of their own; null ids stay; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ringlens.llm.store import cut_lineage
from ringlens.llm.words import RunHashes, Words, text_slices

WINDOW = 8
ACCURACY = 0.01
REACH = 4.0
ENOUGH = 200
# measure, least spread, lower fence used, upper fence used; the rates are zero up to their upper quartile in most groups
MEASURES = (("word_length", 0.0, True, True), ("symbol_rate", 0.05, False, True),
            ("repeat_rate", 0.07, False, True), ("dup_line_rate", 0.1, False, True))

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside runs of ``window`` words that occur twice or more in the text."""
    count, first = len(words.starts), words.first
    result = np.zeros(len(first) - 1, dtype=np.int64)
    if count < window:
        return result
    owner = words.text_of_words()
    begin = np.flatnonzero(np.arange(count) + window <= first[1:][owner])
    keys = RunHashes(words.hashes()).of(begin, begin + window)
    texts = owner[begin]
    order = np.lexsort((keys, texts))
    same = (keys[order][1:] == keys[order][:-1]) & (texts[order][1:] == texts[order][:-1])
    twice = np.zeros(len(begin), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(count + 1, dtype=np.int64)
    np.add.at(edges, begin[twice], 1)
    np.add.at(edges, begin[twice] + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _line_counts(text: str | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)"""
    lines = [line for line in (text or "").encode().split(b"\n") if line.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    names = ("doc_id", "lang", "source", *_COUNTS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            words = Words(batch.column("text"))
            lines = np.array([_line_counts(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, 2)
            counts = (np.diff(words.first), words.per_text(words.inside & ((words.data & 0xC0) != 0x80)),
                      words.per_text(_SYMBOL[words.data]), lines[:, 0], lines[:, 1], repeated_words(words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), *(pa.array(c.astype(np.int64)) for c in counts)], names=list(names))

    texts = docs.select(F.col("doc_id").cast("bigint"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))
    return texts.mapInArrow(of, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def measured(counts: DataFrame) -> DataFrame:
    """Counts with base_failed and the measures (null without words)."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "word_length": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words,
        "repeat_rate": F.col("n_repeat_words") / words, "dup_line_rate": F.col("n_dup_lines") / lines})


def sketches(rows: DataFrame) -> DataFrame:
    """level, lang, source, measure, bucket, n: the sketches of the sources, of languages and of all texts."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m, *_ in MEASURES]))
    long = rows.where("NOT base_failed").select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*").where("value IS NOT NULL")
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / step)).otherwise(F.lit(-(1 << 40)))
    own = long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    own = cut_lineage(own.withColumn("level", F.lit(0)))
    by_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).withColumns(
        {"level": F.lit(1), "source": F.lit(None).cast("string")})
    overall = own.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumns(
        {"level": F.lit(2), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    return own.unionByName(by_lang).unionByName(overall)


def fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source and (n, low, high) of each measure, from the sketches' quartiles."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    key = ("level", "lang", "source", "measure")
    by_bucket = Window.partitionBy(*key).orderBy("bucket")  # a few hundred buckets each
    summed = sketch.withColumn("upto", F.sum("n").over(by_bucket)).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    value = F.when(F.col("bucket") == -(1 << 40), F.lit(0.0)).otherwise(2 * F.exp(F.col("bucket") * step) / (1 + math.exp(step)))
    quartiles = summed.groupBy(*key).agg(
        F.max("total").alias("n"), F.min(F.when(F.col("upto") >= 0.25 * F.col("total"), value)).alias("q25"),
        F.min(F.when(F.col("upto") >= 0.75 * F.col("total"), value)).alias("q75"))
    columns = []
    for measure, least, use_low, use_high in MEASURES:
        reach = REACH * F.greatest(F.col("q75") - F.col("q25"), F.lit(least), 2 * ACCURACY * F.col("q75"))
        low = F.col("q25") - reach if use_low else F.lit(float("-inf"))
        high = F.col("q75") + reach if use_high else F.lit(float("inf"))
        columns.append(F.max(F.when(F.col("measure") == measure, F.struct("n", low.alias("low"), high.alias("high")))).alias(measure))
    return quartiles.groupBy("level", "lang", "source").agg(*columns)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the fences' verdict per measure: one row per document."""
    rows = cut_lineage(measured(base_counts(docs)))
    limits = cut_lineage(fences(sketches(rows)))
    names = [m for m, *_ in MEASURES]
    own = rows.select("lang", "source").distinct()
    by_source, by_lang, overall = (limits.where(F.col("level") == k).drop("level") for k in range(3))
    chosen = own.alias("o") \
        .join(by_source.alias("s"), F.col("o.lang").eqNullSafe(F.col("s.lang")) & F.col("o.source").eqNullSafe(F.col("s.source")), "left") \
        .join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left") \
        .join(F.broadcast(overall.alias("a")), F.lit(True), "left")  # one row
    pick = [F.when(F.col(f"s.{m}.n") >= ENOUGH, F.col(f"s.{m}")).when(F.col(f"l.{m}.n") >= ENOUGH, F.col(f"l.{m}"))
            .otherwise(F.col(f"a.{m}")).alias(f"fence_{m}") for m in names]
    chosen = cut_lineage(chosen.select(F.col("o.lang").alias("f_lang"), F.col("o.source").alias("f_source"), *pick))
    joined = rows.join(chosen, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))
    inside = {m: F.coalesce(F.col(m).between(F.col(f"fence_{m}.low"), F.col(f"fence_{m}.high")), F.lit(True)) for m in names}
    kept = ~F.col("base_failed")
    for verdict in inside.values():
        kept = kept & verdict
    return joined.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), *(v.alias(f"{m}_inside") for m, v in inside.items()))
