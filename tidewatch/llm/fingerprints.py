"""Operator 5: SimHash document fingerprints, and permuted block tables that find all within a Hamming radius."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, keyed_stream, lean_batches, materialize, mix64, read_table, word_hashes

BITS = 64


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text: its terms (pairs of neighbouring words; the word itself where it is alone) vote on 64 signed
    bits by their hash, weighted by 1 + ln of how often the text has them. Without words: zero."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        h, starts, _ = word_hashes(b"\n".join(part))
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        count = np.diff(first)
        text = np.repeat(np.arange(len(part)), count)
        pair = mix64(h[:-1] + mix64(h[1:])) if len(h) > 1 else h[:0]
        inside = np.flatnonzero(text[1:] == text[:-1])
        alone = first[:-1][count == 1]
        term, owner = np.r_[pair[inside], mix64(h[alone])], np.r_[text[inside], text[alone]]
        order = np.lexsort((term, owner))
        term, owner = term[order], owner[order]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]) if len(term) else np.zeros(0, np.int64)
        weight = 1 + np.log(np.diff(np.r_[new, len(term)])).astype(np.float32)
        term, owner = term[new], owner[new]
        edges = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            votes, total = np.zeros(BITS, dtype=np.float64), 0.0
            for a in range(edges[i], edges[i + 1], 1 << 15):
                b = min(a + (1 << 15), edges[i + 1])
                bits = np.unpackbits(term[a:b].view(np.uint8), bitorder="little").reshape(-1, BITS)
                votes += weight[a:b] @ bits.astype(np.float32)
                total += float(weight[a:b].sum(dtype=np.float64))
            out[lo + i] = np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint_chain(docs: DataFrame, bins: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, a row for each row.

    The next document is the one with the next smaller doc_id (after the last, the first); rows of one doc_id go by a hash
    of their text, null doc_ids come last. Null texts are empty; an only row is its own next; other columns are ignored.

    The order is dealt in ranges of doc_id (bounds from approximate quantiles, so a hot range cannot form), each sorted on
    its own; one row more, the first of the following range, closes each.
    """
    spark = docs.sparkSession
    own = lean_batches(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    n = bins or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null").approxQuantile("d", [i / n for i in range(1, n)], 0.002))) if n > 1 else []
    above = F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>")
    own = own.withColumn("bin", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(above, lambda c: c > F.col("doc_id")))).cast("int"))
    tops = own.groupBy("bin").agg(F.max(F.struct("doc_id", "k")).alias("top"))  # a row for each range
    ring = Window.partitionBy(F.lit(0)).orderBy("bin")
    following = tops.select("bin", F.coalesce(F.lead("top").over(ring), F.first("top").over(ring)).alias("top")).select(F.col("bin").alias("for"), F.col("top.doc_id").alias("t"), F.col("top.k").alias("tk"))
    closing = own.join(F.broadcast(following), own.doc_id.eqNullSafe(F.col("t")) & (own.k == F.col("tk"))).select(F.lit(None).cast("long").alias("doc_id"), "text", "k", F.col("for").alias("bin"), F.lit(True).alias("closing")).dropDuplicates(["bin"])
    rows = own.select("bin", "doc_id", "text", "k", F.lit(False).alias("closing")).unionByName(closing.select("bin", F.col("doc_id").cast(dict(own.dtypes)["doc_id"]), "text", "k", "closing"))
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
            now = list(zip(pdf["bin"], ids, pdf["text"], pdf["closing"], strict=True))
            fps = list(fingerprints([r[2].encode("utf-8", "surrogatepass") for r in now]))
            if held is not None:
                now, fps = [held[0], *now], [held[1], *fps]
            held = (now[-1], fps[-1]) if now else None
            at = [i for i in range(len(now) - 1) if not now[i][3]]
            edited = [_edited(now[i][2], now[i + 1][2]).encode("utf-8", "surrogatepass") for i in at]
            a, c, b = np.array([fps[i] for i in at], np.uint64), np.array([fps[i + 1] for i in at], np.uint64), fingerprints(edited)
            yield pd.DataFrame({"doc_id": pd.Series([now[i][1] for i in at], dtype=object), "n_chars": [len(now[i][2]) for i in at], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited], "fp": a.view(np.int64), "edited_fp": b.view(np.int64), "near_edited": likeness(a, b), "near_next": likeness(a, c)})

    order = [F.col("bin"), F.col("closing"), F.col("doc_id").desc_nulls_last(), F.col("k").desc()]
    return rows.repartition("bin").sortWithinPartitions(*order).mapInPandas(run, schema)


def _tables(radius: int, blocks: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The blocks (first bit, width) and, for each table, the blocks of its key: if at most `radius` bits differ, at least
    blocks - radius blocks are equal, so some table's key is."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist(), strict=True)), [list(c) for c in itertools.combinations(range(blocks), blocks - radius)]


def near_counts(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """fps (fp: long, distinct) -> fp, n_near: how many other fingerprints lie within `radius` bits, without any pair leaving
    a task. A pair is counted in the first table whose key it shares."""
    parts, tables = _tables(radius, blocks)

    def key(t: int, use: list[int]):
        out = F.lit(t).cast("long")
        for b in use:
            out = F.shiftleft(out, parts[b][1]).bitwiseOR(F.shiftrightunsigned("fp", parts[b][0]).bitwiseAND((1 << parts[b][1]) - 1))
        return out

    if max(sum(parts[b][1] for b in use) for use in tables) > 56:
        raise ValueError("too few blocks for this radius")
    masks = np.array([sum(((1 << parts[b][1]) - 1) << parts[b][0] for b in use) for use in tables], dtype=np.uint64)
    filed = fps.select("fp", F.posexplode(F.array(*(key(t, use) for t, use in enumerate(tables)))).alias("t", "key"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        k, fp, t = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["t"].to_numpy()
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        n = np.zeros(len(fp), dtype=np.int64)
        wide = np.flatnonzero(np.diff(edge) > 1)
        for lo, hi in zip(edge[wide], edge[wide + 1], strict=True):
            x = fp[lo:hi]
            step = max(1, (1 << 17) // len(x))  # near pairs are tried against every earlier table
            for i in range(0, len(x), step):
                diff = x[i : i + step, None] ^ x[None, :]
                a, b = np.nonzero(np.bitwise_count(diff) <= radius)
                d = diff[a, b]
                first = (d != 0) & ~((d[:, None] & masks[None, : t[lo]]) == 0).any(1)
                n[lo : hi] += np.bincount(i + a[first], minlength=len(x))
        return pd.DataFrame({"fp": pdf["fp"], "n": n})[n > 0]

    counted = filed.repartition("key").sortWithinPartitions("key").mapInPandas(keyed_stream(compare, "key"), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))
    return fps.join(counted, "fp", "left").select("fp", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialize(fingerprint_chain(read_table(spark, sf_dir, "documents")), "chain")
    near = near_counts(own.select("fp").distinct())
    as_hex = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return own.join(near, "fp").select("doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
