"""Event trajectories, their periods and their bursty intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .corpus import spectrum

FEW_DAYS = 7


def event_trajectory(members: DataFrame, words: DataFrame, weighted: bool = True) -> DataFrame:
    """event_id, day, y: the members' mean trajectory, weighted by power (or plain)."""
    own = members.join(words.select("word_id", "dps", "y"), "word_id").select("event_id", "dps", F.posexplode("y").alias("day", "v"))
    w = F.col("dps") if weighted else F.lit(1.0)
    return own.groupBy("event_id", "day").agg(F.try_divide(F.sum(w * F.col("v")), F.sum(w)).alias("y"))


def as_vectors(series: DataFrame) -> DataFrame:
    """event_id, y: the long form folded to a vector in order of the day."""
    return series.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "y"))), lambda x: x.y).alias("y"))


def event_periods(vectors: DataFrame, days: int, above: int | None = FEW_DAYS) -> DataFrame:
    """event_id, y, dps, dp, kind: events are aperiodic beyond half the stream, rounded up; those of `above` days or less go."""
    out = spectrum(vectors, ("event_id", "y")).withColumn("kind", F.when(F.col("dp") > -(-days // 2), "aperiodic").otherwise("periodic"))
    return out if above is None else out.where(F.col("dp") > above)


def interval(loc: Column, scale: Column, days: int) -> tuple[Column, Column]:
    """First and last day, both included."""
    return F.greatest(F.floor(loc - scale), F.lit(0)).cast("int"), F.least(F.ceil(loc + scale), F.lit(days - 1)).cast("int")


def fit_bursts(events: DataFrame, window: int = 7) -> DataFrame:
    """event_id, burst_id, loc, scale: one normal curve for an aperiodic event, a mixture for a periodic one, whose widths
    are half widths at half maximum; bursts in order of their place. events: event_id, y, dp, kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for e, y, dp, kind in zip(pdf["event_id"], pdf["y"], pdf["dp"], pdf["kind"], strict=True):
                y = np.asarray(y, dtype=float)
                if kind == "aperiodic":
                    fit = kernels.aperiodic_fit(y, window)
                    found = [fit] if fit else []
                else:
                    found = [(m, kernels.HALF_WIDTH * s) for _, m, s in kernels.periodic_fit(y, int(dp), window)]
                rows += [(e, b, loc, scale) for b, (loc, scale) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["event_id", "burst_id", "loc", "scale"])

    return events.select("event_id", "y", "dp", "kind").mapInPandas(run, f"event_id {dict(events.dtypes)['event_id']}, burst_id int, loc double, scale double")


def burst_intervals(fits: DataFrame, days: int) -> DataFrame:
    start, end = interval(F.col("loc"), F.col("scale"), days)
    return fits.select("event_id", "burst_id", start.alias("start"), end.alias("end"))


def burst_curves(fits: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """event_id, burst_id, day, density: what a plot of the fits shows (normal curves, Cauchy curves for periodic events)."""
    day = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day")
    z = (F.col("day") - F.col("loc")) / F.col("scale")
    normal = F.exp(-z * z / 2) / (F.col("scale") * F.sqrt(F.lit(2 * np.pi)))
    cauchy = 1 / (np.pi * F.col("scale") * (1 + z * z))
    own = fits.join(events.select("event_id", "kind"), "event_id").where("scale > 0").select("*", day)
    return own.select("event_id", "burst_id", "day", F.when(F.col("kind") == "aperiodic", normal).otherwise(cauchy).alias("density"))
