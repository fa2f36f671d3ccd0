"""Daily counts of a live stream; an extension, as the batch engine takes its days from a finished collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(rows: DataFrame, ts: str, feature: str, late: str = "2 days") -> DataFrame:
    """day, feature, n: tumbling days. On a stream, days close once the watermark has passed them."""
    own = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return own.groupBy(F.window(ts, "1 day").alias("w"), feature).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), feature, "n")


def follow(rows: DataFrame, ts: str, feature: str, each: Callable[[DataFrame, int], None], checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """Hand every batch of closed days to `each`, which may append them to the table that trajectories are built from."""
    return counts(rows, ts, feature, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
