"""Operator 1: mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, encoded, lean_batches, materialize, read_table, row_keyed, word_bounds
from .permute import feistel

#: A mix has a weight for each source; more than so many would be data, not a configuration.
MOST_SOURCES = 100_000
#: Cells of the table of draws (shards x sources) that the driver keeps and sends at most; 256 shards in any case.
CELLS = 1_000_000


def weights_in_turn(n: int) -> list[int]:
    return [(3, 1, 2)[i % 3] for i in range(n)]


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), cap: int = 2) -> list[Fraction]:
    """Share of all sizes by weight; what exceeds cap times a source's size is reshared among the others, until none does."""
    out = [Fraction(0)] * len(sizes)
    rest, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Plan:
    """What the driver knows of a mix: of each source its size and target in words and its blocks; the draws of each shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[Fraction]
    block: int
    blocks: np.ndarray
    draws: np.ndarray
    seed: int


def make_plan(totals: list[tuple[str | None, int]], block: int | None, seed: int) -> Plan:
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    goal = targets(sizes, weights_in_turn(len(sizes)))
    if block is None:
        least = min((n for n in sizes if n), default=1)
        block = min(2048, max(32, least // 2000, sum(sizes) // 20_000_000))
    blocks = np.array([-(-n // block) for n in sizes], dtype=np.int64)
    # A source whose target fills less than half a block still gives one.
    quota = np.array([min(max(round(t / block), 1), 2 * b) if n else 0 for t, n, b in zip(goal, sizes, blocks.tolist(), strict=True)], dtype=np.int64)
    shards = int(min(max(256, CELLS // max(1, len(sizes))), max(1, quota.sum() // 512)))
    rng = np.random.default_rng(seed)
    draws, left = np.zeros((shards, len(sizes)), dtype=np.int64), quota.copy()
    for s in range(shards):
        n = int(left.sum() // (shards - s))
        while n:  # a multinomial draw of what is left of the quotas; what a source cannot give is drawn again
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            draws[s] += got
            left -= got
            n -= int(got.sum())
    return Plan([s for s, _ in totals], sizes, goal, block, blocks, draws, seed)


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """shard, slot, src, epoch, block: the mix, a row for each block in it. A source's slots in all shards count on, and the
    j-th takes block permutation(j mod blocks) of the source's epoch j div blocks."""
    per_shard = plan.draws.sum(1)
    total = int(per_shard.sum())
    first = np.r_[0, np.cumsum(per_shard)]
    within = np.c_[np.zeros(len(plan.draws), np.int64), np.cumsum(plan.draws, axis=1)]
    before = np.cumsum(plan.draws, axis=0) - plan.draws
    blocks, seed = plan.blocks, plan.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf["id"].to_numpy()
            shard = np.searchsorted(first, g, "right") - 1
            at = g - first[shard]
            src = (within[shard, 1:] <= at[:, None]).sum(1) if within.shape[1] < 64 else np.array([np.searchsorted(within[s], i, "right") - 1 for s, i in zip(shard, at, strict=True)])
            j = before[shard, src] + at - within[shard, src]
            epoch = j // blocks[src]
            key = np.uint64(seed) + (src.astype(np.uint64) << np.uint64(20)) + (epoch.astype(np.uint64) << np.uint64(50))
            block = feistel(j % blocks[src], blocks[src], key)
            slot = feistel(at, per_shard[shard], shard.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot, "src": src.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block})

    return spark.range(total).mapInPandas(run, "shard int, slot long, src int, epoch int, block long")


def measure(docs: DataFrame, name: str = "mix-sizes") -> DataFrame:
    """doc_id, source, size, what the row holds (a hash, by which rows are ordered on any run) and its key (see row_keyed) of
    each row. Rows that hold the same are interchangeable."""
    text, own = F.coalesce(F.col("text"), F.lit("")), [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    held = F.xxhash64(text, *own, *(F.col(c).isNull() for c in own)).alias("holds")
    return materialize(row_keyed(docs, "doc_id", "text", *own).select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), held, "_k1", "_k2"), name)


def mix(sizes: DataFrame, block: int | None = None, seed: int = 11) -> tuple[Plan, DataFrame, DataFrame]:
    """sizes (of measure) -> the plan; placed documents (sizes and src, start: where a document's words begin in its source's
    stream of blocks); and segments (src, start, shard, slot, epoch, at, length): the mix, as ranges of documents' words.

    Null sources are a source of their own, the last; null and empty texts are in no block; repeated rows are documents of
    their own; other columns never reach it.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = make_plan([(r.source, r.n) for r in totals], block, seed)
    codes = spark.createDataFrame([(s, i) for i, s in enumerate(plan.sources)], "source string, src int")
    codes = codes.withColumnRenamed("source", "_source")
    parts = 256 + sum(r.rows for r in totals) // 50_000  # each adds up its documents of a source by itself
    own = sizes.join(F.broadcast(codes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("part", F.pmod(F.xxhash64("doc_id", "holds"), F.lit(parts)).cast("int"))
    sums = own.groupBy("src", "part").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")).drop("n")
    run = F.sum("size").over(Window.partitionBy("src", "part").orderBy("doc_id", "holds", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1))
    placed = own.withColumn("run", F.coalesce(run, F.lit(0))).join(before, ["src", "part"]).withColumn("start", F.col("before") + F.col("run")).drop("before", "run", "part")
    placed = materialize(placed, "mix-placed")
    length, end = plan.block, F.col("start") + F.col("size")
    cut = placed.where("size > 0").select("src", "start", "size", F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}"))).alias("block"))
    segments = cut.join(slots(spark, plan), ["src", "block"]).select("src", "start", "shard", "slot", "epoch", (F.greatest(F.col("start"), F.col("block") * length) - F.col("start")).alias("at"), (F.least(end, (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length)).alias("length"))
    return plan, placed, segments


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, placed, segments = mix(measure(read_table(spark, sf_dir, "documents")))
    taken = segments.groupBy("src", "start").agg(F.sum("length").alias("taken"), F.count("*").alias("n_segments"))
    goal = spark.createDataFrame([(i, s, float(t)) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets, strict=True))], "src int, source_size long, target double")
    out = placed.join(F.broadcast(goal), "src").join(taken.withColumn("some", F.lit(1)), ["src", "start"], "left")
    own = lambda c: F.when(F.col("size") > 0, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source_size", "target", own("taken"), own("n_segments"))


def mixed_documents(docs: DataFrame, block: int | None = None, seed: int = 11) -> DataFrame:
    """documents -> documents as the mix takes them: a row for each document and epoch (pass over its source) of which it has
    words, with those words; a text taken as a whole stays as it is, else the taken ranges are joined by a space."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = row_keyed(lean_batches(docs), *names)
    plan, placed, segments = mix(measure(docs), block, seed)
    ranges = segments.groupBy("src", "start", "epoch").agg(F.collect_list(F.struct("at", "length")).alias("ranges"))
    taken = placed.where("size > 0").join(ranges, ["src", "start"]).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "epoch", "ranges")).alias("takes"))
    joined = docs.join(taken, ["_k1", "_k2"]).select(*names, "takes")
    nullable = {c: t for c, t in docs.dtypes}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, texts = [], []
            for i, (text, takes) in enumerate(zip(encoded(pdf["text"]), pdf["takes"], strict=True)):
                starts, ends = word_bounds(np.frombuffer(text, np.uint8))
                for take in takes:
                    spans: list[list[int]] = []
                    for at, length in sorted((r["at"], r["length"]) for r in take["ranges"]):
                        if spans and spans[-1][1] == at:
                            spans[-1][1] += length
                        else:
                            spans.append([at, at + length])
                    whole = spans == [[0, len(starts)]]
                    rows.append(i)
                    texts.append((text if whole else b" ".join(text[starts[a] : ends[b - 1]] for a, b in spans)).decode("utf-8", "surrogatepass"))
            out = pdf[names].astype(object).where(pdf[names].notna(), None).iloc[rows].reset_index(drop=True)
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    return joined.mapInPandas(cut, ", ".join(f"{c} {nullable[c]}" for c in names))
