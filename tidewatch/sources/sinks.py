"""What the engine writes: summary texts and the series behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_summaries(lines: DataFrame, sentences: DataFrame, path: str) -> None:
    """A text table of events: each burst's head lines, then its sentences. lines: event_id, burst_id, line; sentences:
    event_id, burst_id, pos, text."""
    body = sentences.groupBy("event_id", "burst_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "\n").alias("body"))
    out = lines.join(body, ["event_id", "burst_id"], "left").select("event_id", "burst_id", F.concat_ws("\n", "line", "body").alias("value"))
    out.repartitionByRange("event_id", "burst_id").sortWithinPartitions("event_id", "burst_id").select("value").write.mode("overwrite").text(path)


def write_counts(counts: DataFrame, path: str, top: int = 1000) -> None:
    counts.orderBy(F.col("n").desc(), "word").limit(top).write.mode("overwrite").parquet(path)


def event_dump(found: DataFrame, headlines: DataFrame) -> DataFrame:
    """event_id, burst_id, most, least: headlines of each burst's most and least similar document."""
    own = found.join(headlines, "doc_id")
    w = Window.partitionBy("event_id", "burst_id")
    ranked = own.withColumn("a", F.row_number().over(w.orderBy(F.col("sim").desc(), "doc_id"))).withColumn("z", F.row_number().over(w.orderBy("sim", "doc_id")))
    return ranked.groupBy("event_id", "burst_id").agg(F.max(F.when(F.col("a") == 1, F.col("name"))).alias("most"), F.max(F.when(F.col("z") == 1, F.col("name"))).alias("least"))
