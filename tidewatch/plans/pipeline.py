"""The event pipeline from end to end, as one lazy plan up to the detectors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bursts, detect, pairs, retrieve, summarize, topics
from ..operators.corpus import Corpus, eventful
from ..sources.cache import materialize

#: Power that a word must exceed, by method.
BOUNDS = {"original": 0.05, "embedded-greedy": 0.04, "cluster-based": 0.01}


@dataclass(frozen=True)
class Result:
    """events (event_id, word_id, word), bursts (event_id, burst_id, start, end), found (event_id, burst_id, rank, doc_id[, sim]),
    summary (event_id, burst_id, pos, sent_id)."""

    words: DataFrame
    events: DataFrame
    bursts: DataFrame
    found: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class EventPipeline:
    """Finds events in dated documents. method: 'original', 'embedded-greedy' or 'cluster-based'."""

    method: str = "cluster-based"
    bound: float | None = None
    window: int = 7
    min_df: int = 30
    max_df: float = 0.9
    eps: float = 0.5
    caps: tuple[int, int] = (300, 150)
    settings: summarize.Settings = field(default_factory=summarize.Settings)

    def __post_init__(self) -> None:
        if self.method not in BOUNDS:
            raise ValueError(f"method is one of {', '.join(BOUNDS)}")

    def run(self, docs: DataFrame, days: int, vectors: DataFrame | None = None) -> Result:
        """docs: doc_id, day, text. vectors: word, vec; trained on the documents where they are not given (the original method
        needs them for summaries only)."""
        original = self.method == "original"
        corpus = Corpus(docs, days, self.min_df, self.max_df, names_apart=not original)
        if vectors is None:
            tokens = docs.select("doc_id", text.clean(text.words(F.col("text"))).alias("tokens"))
            vectors = materialize(topics.word_vectors(tokens)[0], "vectors")
        bound = BOUNDS[self.method] if self.bound is None else self.bound
        own = materialize(eventful(corpus.spectra, bound), "words")
        if original:
            members = detect.detect_original(own, corpus.words, days)
        else:
            own = materialize(pairs.with_vectors(own, vectors), "words")
            if self.method == "embedded-greedy":
                members = detect.detect_embedded(own.where("vec is not null"))
            else:  # clusters see trimmed trajectories, and so does all that follows
                own = materialize(detect.trimmed(own, self.window), "words")
                members = detect.cluster_events(own, pairs.cluster_distance(own), self.eps)
        members = materialize(members.join(own.select("word_id", "word"), "word_id").select("event_id", "word_id", "word"), "events")
        series = bursts.as_vectors(bursts.event_trajectory(members, own))
        events = materialize(bursts.event_periods(series, days, None if original else bursts.FEW_DAYS), "periods")
        members = members.join(events.select("event_id"), "event_id", "left_semi")
        where = materialize(bursts.burst_intervals(bursts.fit_bursts(events, self.window), days), "bursts")
        names = docs.select("doc_id", text.headline(F.col("text")).alias("name"))
        if original:
            late = events.where("kind = 'aperiodic'").select("event_id")
            one = retrieve.all_keywords(where.join(late, "event_id", "left_semi"), docs, members, corpus.words, self.caps[0])
            many = retrieve.all_keywords(where.join(late, "event_id", "left_anti"), docs, members, corpus.words, self.caps[1])
            found = one.unionByName(many)
        else:
            inside = retrieve.in_bursts(where, docs).select("event_id", "burst_id", "doc_id")
            found = retrieve.wmd_top_k(inside, names, members, vectors)
        found = materialize(found, "found")
        lines = retrieve.fetch(found.where("rank <= 50").select("event_id", "burst_id", "doc_id"), docs, ["text"])
        lines = lines.select("event_id", "burst_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        lemma = text.words(F.col("line"))
        sentences = lines.select("event_id", "burst_id", "doc_id", F.col("i").alias("sent_no"), lemma.alias("lemma")).where(F.size("lemma") > self.settings.shortest)
        sentences = summarize.unique_sentences(sentences, ("event_id", "burst_id"))
        sentences = sentences.select("event_id", "burst_id", summarize.sentence_id(F.col("doc_id"), F.col("sent_no")).alias("sent_id"), "lemma")
        sentences = summarize.laid_by_event(sentences, "sent_id").withColumn("content", text.clean(F.col("lemma")))
        summary = summarize.summarize(sentences, members.select("event_id", "word"), vectors, self.settings)
        return Result(own, members, where, found, summary)


def of_documents(spark: SparkSession, sf_dir: str, days: int = 30, **settings) -> Result:
    """The pipeline over the documents table, with days by position."""
    from ..operators.corpus import assign_days, read_table

    return EventPipeline(**settings).run(assign_days(read_table(spark, sf_dir, "documents").select("doc_id", "text"), days), days)
