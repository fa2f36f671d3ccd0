"""Dated documents -> units, binary bag of words, word trajectories and their spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, kernels, text
from ..sources.cache import materialize


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dense_ids(df: DataFrame, column: str, name: str, start: int = 0) -> DataFrame:
    """Rank by a string column, from `start`, without one task for all rows: a rank within each two-letter prefix, and a
    running count over the prefixes."""
    keyed = df.withColumn("_p", F.substring(column, 1, 2))
    before = keyed.groupBy("_p").count().withColumn("_b", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1 + start
    return keyed.withColumn("_r", own).join(before, "_p").withColumn(name, (F.col("_r") + F.col("_b")).cast("int")).drop("_p", "_r", "_b")


def assign_days(docs: DataFrame, days: int) -> DataFrame:
    """A relative day by position, the same number of documents each: floor(doc_id * days / number of documents). doc_id is
    the position, from 0 to the number of documents less one; any other raises, as its document would fall out of the stream."""
    n = docs.agg(F.count("*").alias("_n"))
    placed = F.when(F.col("doc_id").between(0, F.col("_n") - 1), F.floor(F.col("doc_id") * days / F.col("_n")).cast("int"))
    fault = F.raise_error(F.concat(F.lit("doc_id is no position: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.crossJoin(F.broadcast(n)).withColumn("day", placed.otherwise(fault.cast("int"))).drop("_n")


def positional_days(docs: DataFrame, per_day: DataFrame) -> DataFrame:
    """docs (pos: 0-based) with the day whose cumulative count (per_day: day, n_docs) its position falls under."""
    upto = F.sum("n_docs").over(Window.orderBy("day"))
    spans = per_day.select("day", (upto - F.col("n_docs")).alias("lo"), upto.alias("hi"))
    return docs.join(F.broadcast(spans), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).drop("lo", "hi")


def units_of(docs: DataFrame, names_apart: bool = True) -> DataFrame:
    """unit_id, doc_id, part (0 headline, 1 body), day, txt: two rows for a document, or its body alone."""
    head = F.struct(F.lit(0).alias("part"), text.headline(F.col("text")).alias("txt"))
    body = F.struct(F.lit(1).alias("part"), text.body(F.col("text")).alias("txt"))
    part = F.explode(F.array(head, body) if names_apart else F.array(body)).alias("u")
    return docs.select("doc_id", "day", part).select((F.col("doc_id") * 2 + F.col("u.part")).alias("unit_id"), "doc_id", "u.part", "day", "u.txt")


def occurrences(units: DataFrame, stopwords: Sequence[str] = text.STOPWORDS) -> DataFrame:
    """unit_id, doc_id, day, word: the binary bag of words. Repeats go within the row, so nothing is shuffled for it; the
    cleaner's rules come after the explode, where they are compiled."""
    raw = F.split(F.coalesce(F.col("txt"), F.lit("")), text.SPACE)
    own = units.select("unit_id", "doc_id", "day", F.explode(F.array_distinct(raw)).alias("word"))
    return own.where(text.keeps(F.col("word"), stopwords))


def day_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word", "day").agg(F.count("*").alias("c"))


def vocabulary(counts: DataFrame, n_units: int, min_df: int = 30, max_df: float = 0.9) -> DataFrame:
    """word_id, word, df, by_day (day -> count): words within both bounds, numbered in order. A max_df of 1 or less is a share."""
    top = max_df * n_units if max_df <= 1 else max_df
    own = counts.groupBy("word").agg(F.sum("c").alias("df"), F.map_from_entries(F.collect_list(F.struct("day", "c"))).alias("by_day"))
    return dense_ids(own.where((F.col("df") >= min_df) & (F.col("df") <= top)), "word", "word_id")


def trajectories(vocab: DataFrame, per_day: list[int], natural: bool = False) -> DataFrame:
    """word_id, word, df, y: DF(t) / N(t) * log(N / DF) for every day, zero where the word is absent or the day is empty."""
    n = sum(per_day)
    log = (F.log if natural else F.log2)(F.lit(float(n)) / F.col("df"))
    days = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(c)).alias("n")) for t, c in enumerate(per_day)))
    y = F.transform(days, lambda d: F.when(d.n > 0, F.coalesce(F.col("by_day")[d.t], F.lit(0)) / d.n * log).otherwise(0.0))
    return vocab.select("word_id", "word", "df", y.alias("y"))


def spectrum(traj: DataFrame, keep: Sequence[str] = ("word_id",)) -> DataFrame:
    """keep, dps, dp: power and period of each trajectory's strongest frequency; dp is null for a flat one. One FFT for a
    whole Arrow batch."""
    schema = ", ".join(f"`{c}` {t}" for c, t in traj.dtypes if c in keep) + ", dps double, dp int"
    names = [c for c in traj.columns if c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                power, period = kernels.dominant(np.stack(pdf["y"].to_numpy()))
                yield pdf[names].assign(dps=power, dp=pd.Series(period, index=pdf.index).where(period > 0).astype("Int32"))

    return traj.select(*dict.fromkeys([*names, "y"])).mapInPandas(run, schema)


def cutoffs(window: int = 7, deviations: float = 1.0):
    """A function of trajectory columns: mean plus `deviations` population deviations of the moving average, for a whole Arrow
    batch at a time. (As nested array expressions it would be worked out anew for every element that it is compared with.)"""

    @F.pandas_udf(T.DoubleType())
    def of(y: pd.Series) -> pd.Series:
        if not len(y):
            return pd.Series([], dtype=float)
        sums = np.cumsum(np.pad(np.stack(y.to_numpy()), ((0, 0), (1, 0))), axis=1)
        ma = (sums[:, window:] - sums[:, :-window]) / window
        return pd.Series((ma.mean(1) + deviations * ma.std(1)) * (1 + 1e-12))

    return of


def eventful(spec: DataFrame, bound: float) -> DataFrame:
    return spec.where(F.col("dps") > bound)


def period_class(spec: DataFrame, days: int) -> DataFrame:
    """Words are aperiodic beyond half the stream, rounded down; flat ones are neither."""
    return spec.withColumn("kind", F.when(F.col("dp").isNull(), "flat").when(F.col("dp") > days // 2, "aperiodic").otherwise("periodic"))


def stopwords_by_spectrum(traj: DataFrame, spec: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """word_id, word, bound: words no stronger than the strongest seed and within the seeds' range of mean trajectory."""
    both = traj.join(spec, "word_id").withColumn("m", arrays.mean(F.col("y")))
    limits = both.where(F.col("word").isin(*seeds)).agg(F.max("dps").alias("bound"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return both.crossJoin(F.broadcast(limits)).where("dps <= bound and m between lo and hi").select("word_id", "word", "bound")


def runs_of_days(series: DataFrame, key: str, longer: int = 0, closed: bool = True, days: int | None = None) -> DataFrame:
    """series (key, day: the active ones) -> key, first, last, n: gaps and islands. closed: runs that touch either end of the
    stream are lost, as they stand between no two quiet days."""
    island = F.col("day") - F.row_number().over(Window.partitionBy(key).orderBy("day"))
    out = series.withColumn("_i", island).groupBy(key, "_i").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).drop("_i")
    if closed:
        out = out.where((F.col("first") > 0) & (F.col("last") < days - 1))
    return out.where(F.col("n") >= longer)


@dataclass(frozen=True)
class Corpus:
    """A dated collection with the settings that fix its bag of words."""

    docs: DataFrame
    days: int = 30
    min_df: int = 30
    max_df: float = 0.9
    names_apart: bool = True
    stopwords: tuple[str, ...] = text.STOPWORDS

    @classmethod
    def of_documents(cls, spark: SparkSession, sf_dir: str, days: int = 30, **settings) -> Corpus:
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
        return cls(assign_days(docs, days), days, **settings)

    @cached_property
    def units(self) -> DataFrame:
        return units_of(self.docs, self.names_apart)

    @cached_property
    def words(self) -> DataFrame:
        return occurrences(self.units, self.stopwords)

    @cached_property
    def per_day(self) -> list[int]:
        """Units of each day; the driver keeps one number a day."""
        got = {r.day: r.n for r in self.docs.groupBy("day").agg(F.count("*").alias("n")).collect()}
        return [got.get(t, 0) * (2 if self.names_apart else 1) for t in range(self.days)]

    @cached_property
    def vocab(self) -> DataFrame:
        return vocabulary(day_counts(self.words), sum(self.per_day), self.min_df, self.max_df)

    @cached_property
    def traj(self) -> DataFrame:
        return trajectories(self.vocab, self.per_day)

    @cached_property
    def spectra(self) -> DataFrame:
        return spectrum(self.traj, ("word_id", "word", "df", "y"))

    def eventful(self, deviations: float) -> DataFrame:
        """The words whose power exceeds the mean of all by so many deviations, with rank (by power, ties by word), trajectory
        and spectrum; written once, as what compares words reads them several times."""
        spectra = materialize(self.spectra, "spectra")
        bound = spectra.agg((F.avg("dps") + deviations * F.stddev_pop("dps")).alias("_bound"))
        own = spectra.crossJoin(F.broadcast(bound)).where("dps > _bound").drop("_bound")
        return materialize(own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("dps").desc(), "word"))), "eventful")
