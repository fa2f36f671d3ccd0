"""Quality of detected events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_events(events: DataFrame, bursts: DataFrame, real: DataFrame) -> DataFrame:
    """event_id, real_id: the first real event, in listing order, that shares a word with the event and whose day lies in one
    of its bursts; -1 without any. events: event_id, keywords; bursts: event_id, start, end; real: real_id, day, words."""
    hit = events.join(real, F.arrays_overlap("keywords", "words")).join(bursts.withColumnRenamed("event_id", "_e"), (F.col("event_id") == F.col("_e")) & F.col("day").between(F.col("start"), F.col("end")))
    first = hit.groupBy("event_id").agg(F.min("real_id").alias("real_id"))
    return events.select("event_id").join(first, "event_id", "left").select("event_id", F.coalesce("real_id", F.lit(-1)).alias("real_id"))


def scores(matches: DataFrame, n_real: int, none_counts: bool = False) -> DataFrame:
    """precision, recall, f1. none_counts: the -1 of events without a match counts as one real event found."""
    found = F.countDistinct("real_id") if none_counts else F.countDistinct(F.when(F.col("real_id") >= 0, F.col("real_id")))
    both = matches.agg((F.sum(F.when(F.col("real_id") >= 0, 1).otherwise(0)) / F.count("*")).alias("precision"), (found / n_real).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.withColumn("f1", f1)


def redundancy(groups: DataFrame) -> DataFrame:
    """1 - groups / memberships. groups: group_id, event_id."""
    return groups.agg((1 - F.countDistinct("group_id") / F.count("*")).alias("redundancy"))


def noisiness(flags: DataFrame) -> DataFrame:
    return flags.agg(F.avg(F.col("noisy").cast("int")).alias("noisiness"))


def purity(found: DataFrame) -> DataFrame:
    """Over events, the count of their commonest label summed over all their labels. found: event_id, label (a row each)."""
    per = found.groupBy("event_id", "label").agg(F.count("*").alias("n"))
    best = per.groupBy("event_id").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))


def statistics(members: DataFrame) -> DataFrame:
    """How many events and words, and the distribution of words in an event."""
    per = members.groupBy("event_id").agg(F.count("*").alias("n"))
    q = lambda p: F.expr(f"percentile(n, {p})")
    return per.agg(F.count("*").alias("n_events"), F.sum("n").alias("n_words"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("n").alias("most"))


def report(method: str, dps: float, matches: DataFrame, groups: DataFrame, flags: DataFrame, n_real: int) -> DataFrame:
    """One row with all measures of a method."""
    one = scores(matches, n_real).crossJoin(redundancy(groups)).crossJoin(noisiness(flags))
    return one.select(F.lit(method).alias("method"), F.lit(dps).alias("dps"), "*")


def label_statistics(found: DataFrame) -> DataFrame:
    """event_id and mean, deviation, mode (least of equals) and median of a numeric label of its documents."""
    mode = found.groupBy("event_id", "label").agg(F.count("*").alias("n")).groupBy("event_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("mode"))
    rest = found.groupBy("event_id").agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("std"), F.expr("percentile(label, 0.5)").alias("median"))
    return rest.join(mode, "event_id")
