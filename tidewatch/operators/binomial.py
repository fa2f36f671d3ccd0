"""The older detector: binomial burst probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .pairs import interval_overlap


def observed(counts: DataFrame, per_day: DataFrame) -> DataFrame:
    """word, day, c, n_docs, c_norm, p_o, p_j, n: each day's count of a word (absent days are left out), the count scaled to
    the mean day of n documents (rounded half to even), its share, and the word's mean share of the days that have it."""
    n = per_day.agg(F.bround(F.avg("n_docs")).alias("n"))
    own = counts.join(per_day, "day").crossJoin(F.broadcast(n)).where("c > 0")
    own = own.withColumn("p_o", F.col("c") / F.col("n_docs")).withColumn("c_norm", F.bround(F.col("c") / (F.col("n_docs") / F.col("n"))).cast("long"))
    mean = own.groupBy("word").agg(F.avg("p_o").alias("p_j"))
    return own.join(mean, "word").select("word", "day", "c", "n_docs", "c_norm", "p_o", "p_j", F.col("n").cast("long").alias("n"))


def thresholds(means: DataFrame, q: float = 0.999) -> DataFrame:
    """means (word, n, p_j) with r_c: the least count of n whose cumulated binomial probability reaches q."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["word", "n", "p_j"]].assign(r_c=[kernels.binomial_quantile(int(n), float(p), q) for n, p in zip(pdf["n"], pdf["p_j"], strict=True)])

    return means.select("word", "n", "p_j").mapInPandas(run, "word string, n long, p_j double, r_c long")


def probabilities(obs: DataFrame, exact: bool = False) -> DataFrame:
    """word, day, p_g: the binomial probability of the scaled count of n (exact: of the count itself of that day's number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, n = (pdf["c"], pdf["n_docs"]) if exact else (np.minimum(pdf["c_norm"], pdf["n"]), pdf["n"])
            p = [float(np.exp(kernels.log_binomial(int(m), np.array([int(x)]), float(q))[0])) for x, m, q in zip(k, n, pdf["p_j"], strict=True)]
            yield pdf[["word", "day"]].assign(p_g=p)

    return obs.mapInPandas(run, "word string, day int, p_g double")


def burstiness(obs: DataFrame, limits: DataFrame) -> DataFrame:
    """word, day, p_b: 1 above r_c; below it, where the share exceeds its mean, logistic in the distance to the middle of both;
    else (on r_c itself too) 0. limits: word, r_c."""
    own = obs.join(limits.select("word", "r_c"), "word")
    x = F.col("c_norm") - (F.col("r_c") + F.col("p_j") * F.col("n")) / 2
    p = F.when(F.col("c_norm") > F.col("r_c"), 1.0).when((F.col("c_norm") < F.col("r_c")) & (F.round("p_o", 12) > F.round("p_j", 12)), 1 / (1 + F.exp(-x))).otherwise(0.0)
    return own.select("word", "day", p.alias("p_b"))


def bursty_by_mean(p_b: DataFrame, days: int, times: float = 5.0) -> DataFrame:
    """word, m: words whose mean burstiness exceeds `times` that of all. Days a word is absent count 0."""
    per = p_b.groupBy("word").agg((F.sum("p_b") / days).alias("m"))
    mean = per.agg(F.avg("m").alias("g"))
    return per.crossJoin(F.broadcast(mean)).where(F.col("m") > times * F.col("g")).select("word", "m")


def event_probability(p_b: DataFrame, members: DataFrame) -> DataFrame:
    """event_id, p: over the days, the sum of the least burstiness of the members over the sum of all of theirs."""
    size = members.groupBy("event_id").agg(F.count("*").alias("size"))
    day = p_b.join(members, "word").groupBy("event_id", "day").agg(F.min("p_b").alias("lo"), F.sum("p_b").alias("s"), F.count("*").alias("k")).join(size, "event_id")
    return day.groupBy("event_id").agg(F.try_divide(F.sum(F.when(F.col("k") == F.col("size"), F.col("lo")).otherwise(0.0)), F.sum("s")).alias("p"))


def document_likelihood(sizes: DataFrame, members: DataFrame, union: DataFrame, n_docs: int) -> DataFrame:
    """event_id, ll: logarithms of each member's documents over the event's, and of one minus each other word's share of all.
    sizes: word, size; union: event_id, m (documents with any member)."""
    outside = sizes.agg(F.sum(F.log(1 - F.col("size") / n_docs)).alias("rest"))
    own = members.join(sizes, "word").join(union, "event_id").groupBy("event_id").agg(F.sum(F.log(F.col("size") / F.col("m"))).alias("a"), F.sum(F.log(1 - F.col("size") / n_docs)).alias("b"))
    return own.crossJoin(F.broadcast(outside)).select("event_id", (F.col("a") + F.col("rest") - F.col("b")).alias("ll"))


def overlapping_runs(runs: DataFrame, above: float = 0.9) -> DataFrame:
    """a, b, overlap of runs (run_id, first, last) that share more than `above` of the longer one."""
    a = runs.select(F.col("run_id").alias("a"), F.col("first").alias("a1"), F.col("last").alias("a2"))
    b = runs.select(F.col("run_id").alias("b"), F.col("first").alias("b1"), F.col("last").alias("b2"))
    both = a.join(b, (F.col("a") < F.col("b")) & (F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")))
    return both.select("a", "b", interval_overlap(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("overlap")).where(F.col("overlap") > above)


# --- searches over gathered tables of bursty words, which their thresholds keep few --------------------------------------


def _overlap(bow: np.ndarray, a: int, b: int) -> float:
    both = float((bow[:, a] & bow[:, b]).sum())
    return both / min(bow[:, a].sum(), bow[:, b].sum()) if both else 0.0


def series_events(p_b: np.ndarray, bow: np.ndarray, doc_day: np.ndarray, longest: int = 12, similar: float = 0.9, together: float = 0.1) -> list[tuple[tuple[int, int], list[int]]]:
    """Events of words with overlapping long bursts. p_b: days x words; bow: documents x words (bool); the end day of a burst
    is not searched for documents. An event whose words an earlier one has, or has of it, is left out."""
    runs = [(w, r) for w in range(p_b.shape[1]) for r in kernels.longest_run(p_b[:, w] > 0) if r[1] - r[0] + 2 > longest]
    out: list[tuple[tuple[int, int], list[int]]] = []
    for i, (core, (a1, a2)) in enumerate(runs):
        words = [core]
        for w, (b1, b2) in runs[i + 1 :]:
            if max(0, min(a2, b2) - max(a1, b1)) / max(a2 - a1, b2 - b1, 1) > similar:
                words.append(w)
        part = bow[(doc_day >= a1) & (doc_day < a2)]
        words = [core, *(w for w in words[1:] if _overlap(part, core, w) >= together)]
        if len(words) > 1 and not any(len(set(words) & set(o)) == min(len(set(words)), len(set(o))) for _, o in out):
            out.append(((a1, a2), words))
    return out


def greedy_events(p_b: np.ndarray, bow: np.ndarray) -> list[list[int]]:
    """Split bursty words into events: the likeliest pair, then every word that raises the likelihood, then the rest anew."""
    left = list(range(p_b.shape[1]))
    size, n = bow.sum(0).astype(float), len(bow)
    out = []

    def cost(event: list[int]) -> float:
        own = p_b[:, event]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.log(own.min(1).sum() / own.sum())
            union = float(bow[:, event].any(1).sum())
            others = [w for w in left if w not in event]
            return float(-p - np.log(size[event] / union).sum() - np.log(1 - size[others] / n).sum())

    while len(left) >= 2:
        tried = [(cost([a, b]), a, b) for x, a in enumerate(left) for b in left[x + 1 :]]
        best, a, b = min(tried, key=lambda t: (np.isnan(t[0]), t[0]))
        event, grown = [a, b], True
        while grown:
            grown = False
            for w in [w for w in left if w not in event]:
                if (c := cost([*event, w])) < best:
                    best, event, grown = c, [*event, w], True
        out.append(event)
        left = [w for w in left if w not in event]
    return out


def pairwise_probability(p_b: np.ndarray) -> np.ndarray:
    n = p_b.shape[1]
    out = np.zeros((n, n))
    for i in range(n):
        s = p_b[:, [i]] + p_b[:, i + 1 :]
        low = np.minimum(p_b[:, [i]], p_b[:, i + 1 :])
        out[i, i + 1 :] = low.sum(0) / np.maximum(s.sum(0), 1e-300)
    return out + out.T


def fast_events(p_b: np.ndarray, bow: np.ndarray, doc_day: np.ndarray, together: float = 0.2) -> list[tuple[tuple[int, int], list[int]]]:
    """Seeds are the likeliest pairs above the 95th percentile of the upper triangle; words as likely with both join, if their
    documents overlap with both in the pair's longest common burst."""
    p = pairwise_probability(p_b)
    bound = np.percentile(np.triu(p), 95)
    out = []
    while p.size and (top := p.max()) >= bound and top > 0:
        a, b = (int(x[0]) for x in np.nonzero(p == top))
        words = sorted({a, b, *np.flatnonzero((p[a] > bound) & (p[b] > bound)).tolist()})
        common = max(kernels.longest_run(p_b[:, [a, b]].min(1) > 0, closed=False), key=lambda r: r[1] - r[0], default=(0, -1))
        part = bow[(doc_day >= common[0]) & (doc_day < max(common[1], common[0] + 1))]
        words = [w for w in words if w in (a, b) and _overlap(part, a, b) >= together or _overlap(part, a, w) >= together and _overlap(part, b, w) >= together]
        if len(words) > 1:
            out.append((common, words))
            p[np.ix_(words, words)] = 0
        p[a, b] = p[b, a] = 0
    return out
