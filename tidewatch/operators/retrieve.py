"""Documents of an event's bursts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, text
from ..sources.cache import materialize

#: Rows of one Arrow batch where a row has many vectors.
FEW_ROWS = 500


def in_bursts(bursts: DataFrame, docs: DataFrame) -> DataFrame:
    """event_id, burst_id, doc_id, day of the documents within each burst. A burst is spread over its days first (as many as
    the stream has at most), so this is an equality join on the day and not a comparison of all with all."""
    days = bursts.where("start <= end").select("event_id", "burst_id", F.explode(F.sequence("start", "end")).alias("day"))
    return docs.select("doc_id", "day").join(days, "day").select("event_id", "burst_id", "doc_id", "day")


def any_keyword(members: DataFrame, occurrences: DataFrame) -> DataFrame:
    """event_id, doc_id, n_words: documents with at least one of an event's words, and how many."""
    hit = occurrences.select("doc_id", "word").join(members.select("event_id", "word"), "word")
    return hit.groupBy("event_id", "doc_id").agg(F.countDistinct("word").alias("n_words"))


def all_keywords(bursts: DataFrame, docs: DataFrame, members: DataFrame, occurrences: DataFrame, cap: int) -> DataFrame:
    """event_id, burst_id, rank, doc_id: documents of a burst with all of the event's words, the first `cap` by doc_id."""
    size = members.groupBy("event_id").agg(F.count("*").alias("n_words"))
    full = any_keyword(members, occurrences).join(size, ["event_id", "n_words"]).select("event_id", "doc_id")
    found = in_bursts(bursts, docs).join(full, ["event_id", "doc_id"])
    rank = F.row_number().over(Window.partitionBy("event_id", "burst_id").orderBy("doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap).select("event_id", "burst_id", "rank", "doc_id")


def top_k(scored: DataFrame, k: int | None = None) -> DataFrame:
    """scored (event_id, burst_id, doc_id, sim) -> with rank: the k most similar documents of each burst (ties by doc_id), or
    the rounded square root of their number."""
    w = Window.partitionBy("event_id", "burst_id")
    most = F.lit(k) if k is not None else F.round(F.sqrt(F.count("*").over(w))).cast("int")
    ranked = scored.withColumn("_k", most).withColumn("rank", F.row_number().over(w.orderBy(F.col("sim").desc(), "doc_id")))
    return ranked.where(F.col("rank") <= F.col("_k")).drop("_k")


def wmd_scores(candidates: DataFrame, headlines: DataFrame, keywords: DataFrame, vectors: DataFrame, relaxed: bool = False) -> DataFrame:
    """event_id, burst_id, doc_id, sim = 1 / (1 + Word Mover's distance of headline and keywords); without known words in
    either, 0. candidates: event_id, burst_id, doc_id; headlines: doc_id, name; keywords: event_id, word; vectors: word, vec."""
    known = vectors.select("word", "vec")
    head = headlines.select("doc_id", F.explode(F.array_distinct(text.words(F.col("name")))).alias("word")).join(known, "word").groupBy("doc_id").agg(F.collect_list("vec").alias("head"))
    keys = keywords.join(known, "word").groupBy("event_id").agg(F.collect_list("vec").alias("keys"))
    both = candidates.join(head, "doc_id", "left").join(keys, "event_id", "left")
    measure = kernels.relaxed_movers if relaxed else kernels.word_movers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sim = [1 / (1 + measure(np.stack(h), np.stack(k))) if h is not None and k is not None else 0.0 for h, k in zip(pdf["head"], pdf["keys"], strict=True)]
            yield pdf[["event_id", "burst_id", "doc_id"]].assign(sim=sim)

    kinds = dict(candidates.dtypes)
    return both.mapInPandas(run, f"event_id {kinds['event_id']}, burst_id {kinds['burst_id']}, doc_id {kinds['doc_id']}, sim double")


def wmd_top_k(candidates: DataFrame, headlines: DataFrame, keywords: DataFrame, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """The most similar documents of each burst, exactly: a lower bound of the distance ranks all candidates; the first k are
    measured, and beyond them only those whose bound allows no less than the k-th of these has. A document's headline is laid once
    beside all its bursts, which are measured together; a task gives its own first k of a burst and not every candidate. The
    driver has a number for each burst and the keywords' vectors."""
    spark, kinds = candidates.sparkSession, dict(candidates.dtypes)
    known = materialize(vectors.select("word", "vec"), "movers-vectors")
    if (known.agg(F.bool_and(F.col("vec").cast("array<float>").cast("array<double>") == F.col("vec"))).first()[0]) is True:
        known = known.select("word", F.col("vec").cast("array<float>").alias("vec"))  # the same numbers in half the room
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= FEW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FEW_ROWS)  # a row has the vectors of a whole headline
    sizes = candidates.groupBy("event_id", "burst_id").agg(F.count("*").alias("n")).orderBy("event_id", "burst_id").toPandas()
    named = spark.createDataFrame([(x.event_id, x.burst_id, p) for p, x in enumerate(sizes.itertuples())], f"event_id {kinds['event_id']}, burst_id {kinds['burst_id']}, _p int")
    most = np.full(len(sizes), k) if k is not None else np.floor(np.sqrt(sizes["n"].to_numpy(dtype=float)) + 0.5).astype(int)
    words = {e: np.stack([np.asarray(v, dtype=float) for v in x]) for e, x in keywords.join(known, "word").select("event_id", "vec").toPandas().groupby("event_id")["vec"]}
    events = [e for e in sorted(set(sizes["event_id"])) if e in words]
    keys = [words[e] for e in events]
    place = {e: i for i, e in enumerate(events)}
    event = np.array([place.get(e, -1) for e in sizes["event_id"]], dtype=int)  # of each burst; -1: no known keyword
    head = headlines.select("doc_id", F.explode(F.array_distinct(text.words(F.col("name")))).alias("word")).join(known, "word").groupBy("doc_id").agg(F.collect_list("vec").alias("head"))
    own = candidates.join(F.broadcast(named), ["event_id", "burst_id"]).groupBy("doc_id").agg(F.collect_list("_p").alias("p"))
    own = materialize(own.join(head, "doc_id", "left").select("doc_id", "p", "head"), "movers")
    form = f"_p int, doc_id {kinds['doc_id']}, sim double"

    def bounds(x: np.ndarray | None, p: np.ndarray) -> np.ndarray:
        """The most that the similarity may be."""
        e, at = np.unique(event[p], return_inverse=True)
        out = np.zeros(len(e))
        live = e >= 0
        if x is not None and live.any():
            of = [keys[i] for i in e[live]]
            out[live] = 1 / (1 + kernels.movers_bounds(x, np.concatenate(of), np.cumsum([0, *map(len, of[:-1])])))
        return out[at]

    def measured(x: np.ndarray | None, p: np.ndarray) -> np.ndarray:
        e, at = np.unique(event[p], return_inverse=True)
        out = np.zeros(len(e))
        if x is not None:
            many = np.array([len(keys[i]) if i >= 0 else 0 for i in e])
            for m in set(many.tolist()) - {0}:
                part = np.flatnonzero(many == m)
                step = max(1, (1 << 21) // (len(x) * m * max(m, x.shape[1])))
                for a in range(0, len(part), step):
                    y = np.stack([keys[e[i]] for i in part[a : a + step]])
                    cost = np.sqrt(((x[None, :, None] - y[:, None]) ** 2).sum(3))
                    out[part[a : a + step]] = 1 / (1 + kernels.many_movers(cost))
        return out[at]

    def firsts(of: Callable[[np.ndarray | None, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """The task's first documents of each burst by what `of` gives (bursts, values)."""

        def kept(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
            p, doc, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, -sim, p))
            p, doc, sim = p[order], doc[order], sim[order]
            keep = np.arange(len(p)) - np.searchsorted(p, p) < most[p]
            return [(p[keep], doc[keep], sim[keep])]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts: list[tuple[np.ndarray, ...]] = []
            held, limit = 0, 1 << 19
            for pdf in batches:
                for doc, h, ps in zip(pdf["doc_id"], pdf["head"], pdf["p"], strict=True):
                    x = None
                    if h is not None:
                        x = np.stack(h).astype(float)
                        x = x[np.lexsort(x.T[::-1])]  # the same headline has the same sums
                    p, sim = of(x, np.asarray(ps))
                    parts.append((p, np.full(len(p), doc), sim))
                    held += len(p)
                    if held > limit:
                        parts = kept(parts)
                        held = len(parts[0][0])
                        limit = max(1 << 19, 2 * held)
            if parts:
                p, doc, sim = kept(parts)[0]
                yield pd.DataFrame({"_p": p.astype(np.int32), "doc_id": doc, "sim": sim})

        return run

    def ranked(of: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("sim").desc(), "doc_id"))
        n = spark.createDataFrame([(p, int(x)) for p, x in enumerate(most)], "_p int, _k int")
        return of.withColumn("rank", rank).join(F.broadcast(n), "_p").where(F.col("rank") <= F.col("_k")).drop("_k")

    if not len(sizes):
        return candidates.withColumn("sim", F.lit(0.0)).withColumn("rank", F.lit(0)).where("false")
    def from_(least: np.ndarray) -> Callable[[np.ndarray | None, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        def of(x: np.ndarray | None, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = p[bounds(x, p) >= least[p] * (1 - 1e-9)]
            return p, measured(x, p)

        return of

    def lowest(of: DataFrame) -> np.ndarray:
        """The value of each burst's k-th document."""
        out = np.zeros(len(sizes))
        for r in of.groupBy("_p").agg(F.min("sim").alias("least")).collect():
            out[r["_p"]] = r.least
        return out

    near = lowest(ranked(own.mapInPandas(firsts(lambda x, p: (p, bounds(x, p))), form)))
    least = lowest(ranked(own.mapInPandas(firsts(from_(near)), form)))  # of the first k by their bounds
    found = ranked(own.mapInPandas(firsts(from_(least)), form))
    return found.join(F.broadcast(named), "_p").select("event_id", "burst_id", "doc_id", "sim", "rank")


def fetch(found: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """found with columns of the documents. Wanted ids are gathered once for all events and the documents scanned once."""
    wanted = found.select("doc_id").distinct()
    return found.join(docs.join(wanted, "doc_id", "left_semi").select("doc_id", *columns), "doc_id")


def extremes(scored: DataFrame) -> DataFrame:
    """event_id, burst_id, most_id, least_id: the most and the least similar document (ties by doc_id)."""
    return scored.groupBy("event_id", "burst_id").agg(F.min_by("doc_id", F.struct(-F.col("sim"), "doc_id")).alias("most_id"), F.min_by("doc_id", F.struct("sim", "doc_id")).alias("least_id"))


def nearest_to_mean(vectors: DataFrame, group: str) -> DataFrame:
    """group, id, distance: of each group (group, id, vec) the vector nearest to the group's mean (ties by id)."""
    each = vectors.select(group, "id", F.posexplode("vec").alias("k", "x"))
    mean = each.groupBy(group, "k").agg(F.avg("x").alias("m"))
    far = each.join(mean, [group, "k"]).groupBy(group, "id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("distance"))
    best = F.min(F.struct(F.round("distance", 9).alias("distance"), "id")).alias("b")
    return far.groupBy(group).agg(best).select(group, "b.id", "b.distance")


def majority(found: DataFrame, labels: DataFrame) -> DataFrame:
    """event_id, label, n: the commonest label of an event's documents (ties: the smaller)."""
    per = found.join(labels, "doc_id").groupBy("event_id", "label").agg(F.count("*").alias("n"))
    return per.groupBy("event_id").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("b")).select("event_id", "b.label", "b.n")
