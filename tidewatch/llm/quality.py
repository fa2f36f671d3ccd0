"""Operator 9: quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, chunks, encoded, lean_batches, materialize, mix64, read_table, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in COUNTS}
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        data = b"\n".join(part)
        edges = np.cumsum([0, *(len(t) + 1 for t in part)])
        raw = np.frombuffer(data + b"\n", dtype=np.uint8)
        total = lambda flags, edges=edges: np.diff(np.r_[0, np.cumsum(flags)][edges])
        out["word_chars"][lo:hi] = total(~_SPACE[raw] & ((raw & 0xC0) != 0x80))
        out["n_symbols"][lo:hi] = total(_SYMBOL[raw])
        h, starts, _ = word_hashes(data)
        first = np.searchsorted(starts, edges)
        out["n_words"][lo:hi] = np.diff(first)
        if len(h) > 2:
            text = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(first))
            gram = mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:] ^ mix64(text[2:] + np.uint64(1)))))
            at = np.flatnonzero(text[:-2] == text[2:])
            order = at[np.argsort(gram[at], kind="stable")]
            same = gram[order[1:]] == gram[order[:-1]]
            twice = np.zeros(len(h), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = twice.copy()
            covered[1:] |= twice[:-1]
            covered[2:] |= twice[:-2]
            out["n_repeat_words"][lo:hi] = np.diff(np.r_[0, np.cumsum(covered)][first])
        for i, t in enumerate(part, lo):
            lines = [x for x in t.split(b"\n") if x.strip()]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def count_column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame(_text_counts(encoded(texts)))


#: Relative error of the sketches' quantiles.
ERROR = 0.002
_GAMMA = (1 + ERROR) / (1 - ERROR)
#: The bucket of values of zero.
_ZERO = -100_000

#: Measures of a text, and of which quantile of its own group and which floor its limits are made: a document fails beyond
#: q50 + reach * (quantile - q50) + floor, or below that mirrored. Where junk is common the quartiles still are those of clean
#: texts; repeats, which clean texts have, are measured by their tail. The floor is for groups whose quantiles are zero.
MEASURES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", "q75", 0.02),
    "word_length": ("word_chars / greatest(n_words, 1)", "q75", 0.1),
    "dup_line_share": ("n_dup_lines / greatest(n_words, 1)", "q98", 0.01),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", "q95", 0.02),
}
AT = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q98": 0.98}
BELOW = ("word_length",)


def bucket(x: Column) -> Column:
    """The sketch's bucket of a value: counts of buckets add up, which merges sketches of any parts exactly."""
    return F.when(x > 1e-9, F.ceil(F.log(x) / math.log(_GAMMA)).cast("int")).otherwise(F.lit(_ZERO))


def sketches(values: DataFrame, groups: list[str]) -> DataFrame:
    """values (groups, measure, x) -> groups, measure, bucket, n: a mergeable sketch of each measure of each group."""
    return values.groupBy(*groups, "measure", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(parts: DataFrame, groups: list[str]) -> DataFrame:
    return parts.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """groups, measure, n, and a column for each quantile; within a relative error of ERROR."""
    w = Window.partitionBy(*groups, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    value = F.when(F.col("bucket") == _ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    return run.groupBy(*groups, "measure").agg(F.max("all").alias("n"), *(F.min(F.when(F.col("upto") >= q * F.col("all"), value)).alias(c) for c, q in at.items()))


def thresholds(counts: DataFrame, reach: float = 8.0, least: int = 50) -> DataFrame:
    """counts (lang, source, COUNTS, base_failed) -> lang, source, measure, low, high. Groups of fewer than `least`
    documents take the limits of their language (sketches merged over sources), or of all, where that is small too."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.expr(x).cast("double").alias("x")) for m, (x, *_) in MEASURES.items()))).alias("p")
    own = sketches(counts.where("not base_failed").select("lang", "source", pairs).select("lang", "source", "p.*"), ["lang", "source"])
    own = materialize(own, "sketches")
    at = AT
    fine = quantiles(own, ["lang", "source"], at)
    lang = quantiles(merge_sketches(own, ["lang"]), ["lang"], at)
    every = quantiles(merge_sketches(own, []), [], at)
    as_struct = lambda df, name: df.select(*(c for c in df.columns if c not in ("n", *at)), F.struct("n", *at).alias(name))
    a, b, c = as_struct(fine, "a"), as_struct(lang, "b"), as_struct(every, "c")
    b = b.withColumnsRenamed({"lang": "b_lang", "measure": "b_measure"})
    both = a.join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure"))).join(c, "measure")
    q = F.when(F.col("a.n") >= least, F.col("a")).when(F.col("b.n") >= least, F.col("b")).otherwise(F.col("c"))
    of = lambda pick: F.coalesce(*(F.when(F.col("measure") == m, pick(*x)) for m, x in MEASURES.items()))
    high = of(lambda _, name, floor: F.col("q.q50") + reach * (F.col(f"q.{name}") - F.col("q.q50")) + floor)
    low = of(lambda _, name, floor: F.col("q.q50") - reach * (F.col("q.q50") - F.col("q.q25")) - floor)
    low = F.when(F.col("measure").isin(*BELOW), low).otherwise(F.lit(-1.0))
    return both.withColumn("q", q).select("lang", "source", "measure", low.alias("low"), high.alias("high"))


def judged(counted: DataFrame, reach: float, least: int) -> DataFrame:
    """counted (any columns, lang, source, _q: struct of COUNTS) with base_failed and kept."""
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    limits = thresholds(counted.select("lang", "source", "_q.*", failed.alias("base_failed")), reach, least)
    wide = limits.groupBy("lang", "source").agg(*(F.first(F.when(F.col("measure") == m, F.struct("low", "high")), ignorenulls=True).alias(m) for m in MEASURES)).select(F.struct("*").alias("_t"))
    ok = F.lit(True)
    for m, (x, *_) in MEASURES.items():
        ok = ok & F.col(f"_m_{m}").between(F.col(f"_t.{m}.low"), F.col(f"_t.{m}.high"))
    values = counted.select("*", "_q.*").select(*counted.columns, *(F.expr(x).cast("double").alias(f"_m_{m}") for m, (x, *_) in MEASURES.items()))
    joined = values.join(wide, F.col("lang").eqNullSafe(F.col("_t.lang")) & F.col("source").eqNullSafe(F.col("_t.source")), "left")
    return joined.select(*counted.columns, failed.alias("base_failed"), (~failed & F.coalesce(ok, F.lit(True))).alias("kept"))


def quality(docs: DataFrame, reach: float = 8.0, least: int = 50) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> doc_id, the five counts, base_failed, kept; one row for each row of docs.

    Null and empty texts have no words and so fail; null languages and sources are groups of their own; repeated rows are
    judged alike; a null doc_id stays null; other columns are ignored, whatever their names.
    """
    counted = lean_batches(docs).select("doc_id", "lang", "source", count_column(F.coalesce(F.col("text"), F.lit(""))).alias("_q"))
    out = judged(materialize(counted, "quality-counts"), reach, least)
    return out.select("doc_id", *(F.col(f"_q.{c}").alias(c) for c in COUNTS), "base_failed", "kept")


def keep_good(docs: DataFrame, reach: float = 8.0, least: int = 50) -> DataFrame:
    """The documents that quality() keeps, with their columns doc_id, text, lang, source and n_chars."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    counted = lean_batches(docs).select(*names, count_column(F.coalesce(F.col("text"), F.lit(""))).alias("_q"))
    return judged(materialize(counted, "quality-counts"), reach, least).where("kept").select(*names)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
