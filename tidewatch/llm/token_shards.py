"""Operator 3: token ids in training order, in fixed-stride shards."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_stream, lean_batches, materialize, read_table, row_keyed
from .permute import feistel
from .tokens import crc32, default_paths, token_ids

#: The end token. Short sequences are padded with zero bytes, which are end tokens, too.
END = 0


def _starts(ids: DataFrame) -> DataFrame:
    """ids (doc_id, n, crc, _k1, _k2) -> _k1, _k2, start: the number of ids before each document, in the order of doc_id (null
    last), then of what it holds. Ranges of documents add up by themselves; the sums of ranges, one row each, are added up
    in turn, so nothing but those passes through one task."""
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("crc"), F.col("n"), F.col("_k1"), F.col("_k2")]
    ranges = materialize(ids.select("doc_id", "n", "crc", "_k1", "_k2").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("range").agg(F.sum("n").alias("s")).withColumn("before", F.sum("s").over(Window.orderBy("range")) - F.col("s"))
    run = F.sum("n").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("run", F.coalesce(run, F.lit(0))).join(sums.select("range", "before"), "range").select("_k1", "_k2", (F.col("before") + F.col("run")).alias("start"))


def training_order(docs: DataFrame, length: int = 1024, per_shard: int = 1024, key: int = 20, paths: tuple[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> shard, slot, offset, n_tokens, n_docs, first_doc_id, last_doc_id, ids_crc32, payload: every
    sequence at its place in the training order, in range partitions of whole shards, sorted by slot.

    The ids of all documents, each with an end token, are laid end to end in the order of doc_id (null last; of equal ids by
    what the rows hold), whatever files or partitions they come in, and cut into sequences of `length`; the last may be
    shorter. Sequence i of all n goes to slot feistel(i, n, key). payload has exactly `length` little-endian 16-bit ids
    (a larger id raises), a short sequence padded with the end token, so slot s lies at offset (s mod per_shard) * stride of
    shard s div per_shard and can be read from any slot on. Null and empty texts are an end token alone; repeated rows are
    kept; null doc_ids stay null; an empty table gives no shards; other columns are ignored.

    Ids are made once and kept in the shared folder; when all are counted, each document's start is known and its ids go,
    in pieces, to the shards of their sequences.
    """
    paths = paths or default_paths()
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [np.append(token_ids(t, paths), np.uint32(END)) for t in pdf["text"]]
            if max((int(x.max()) for x in own), default=0) > 0xFFFF:
                raise ValueError("a token id beyond 16 bits")
            raw = [x.astype("<u2").tobytes() for x in own]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(x) for x in own], "crc": [zlib.crc32(x) for x in raw], "ids": raw})

    made = materialize(lean_batches(docs).select("doc_id", "text").mapInPandas(encode, f"doc_id {kind}, n long, crc long, ids binary"), "token-ids", "zstd")
    made = row_keyed(made, "doc_id", "n", "crc", "ids")
    starts = materialize(_starts(made), "starts")
    total = -(-(made.agg(F.sum("n")).first()[0] or 0) // length)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, start, raw in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["start"], pdf["ids"], strict=True):
                end = start + len(raw) // 2
                for s in range(start // length, (end - 1) // length + 1):
                    lo, hi = max(start, s * length), min(end, (s + 1) * length)
                    rows.append((s, lo - s * length, i, raw[2 * (lo - start) : 2 * (hi - start)]))
            out = pd.DataFrame(rows, columns=["slot", "at", "doc_id", "ids"])
            out["slot"] = feistel(out["slot"].to_numpy(np.int64), total, key)
            yield out.assign(shard=(out["slot"] // per_shard).astype(np.int32))

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        first = np.flatnonzero(np.r_[True, np.diff(pdf["slot"].to_numpy()) != 0])
        last = np.r_[first[1:], len(pdf)]
        raw, ids, slot = [b"".join(pdf["ids"].iloc[a:b]) for a, b in zip(first, last, strict=True)], pdf["doc_id"], pdf["slot"].to_numpy()[first]
        return pd.DataFrame({
            "shard": pdf["shard"].to_numpy()[first], "slot": slot, "offset": slot % per_shard * 2 * length, "n_tokens": [len(x) // 2 for x in raw], "n_docs": last - first,
            "first_doc_id": ids.iloc[first].reset_index(drop=True), "last_doc_id": ids.iloc[last - 1].reset_index(drop=True),
            "ids_crc32": [crc32(np.frombuffer(x, "<u2")) for x in raw], "payload": [x.ljust(2 * length, b"\0") for x in raw],
        })

    placed = made.join(starts, ["_k1", "_k2"]).select("doc_id", "start", "ids").mapInPandas(pieces, f"slot long, at int, doc_id {kind}, ids binary, shard int")
    dealt = placed.repartitionByRange("shard").sortWithinPartitions("slot", "at")
    return dealt.mapInPandas(keyed_stream(assemble, "slot"), f"shard int, slot long, offset long, n_tokens int, n_docs int, first_doc_id {kind}, last_doc_id {kind}, ids_crc32 long, payload binary")


def write_shards(ordered: DataFrame) -> DataFrame:
    """Keep the training order as a table in the shared folder: its files hold ranges of whole shards, sorted by slot."""
    return materialize(ordered, "shards", "zstd")


def read_from(shards: DataFrame, slot: int, until: int | None = None) -> DataFrame:
    """Resume: the sequences from this slot on, in order; whole files outside the range are skipped by their statistics."""
    part = shards.where(F.col("slot") >= slot)
    return (part if until is None else part.where(F.col("slot") < until)).orderBy("slot")


def export_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as folder/shard-NNNNNN.bin, for folders that every executor and the driver mount, which a marker file
    that the driver writes and each task looks for makes sure. Files appear whole (renamed
    when done), so a repeated task or a resumed export rewrites the same bytes. Returns shard, path, n_bytes."""

    marker = f"{folder}/.shared-{uuid.uuid4().hex}"
    with open(marker, "wb"):
        pass

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not os.path.exists(marker):
            raise RuntimeError(f"{folder} is not the same folder here as on the driver")
        name, out, rows = None, None, []

        def close() -> None:
            if out:
                rows.append((name, f"{folder}/shard-{name:06d}.bin", out.tell()))
                out.close()
                os.replace(out.name, rows[-1][1])

        for pdf in batches:
            for shard, payload in zip(pdf["shard"], pdf["payload"], strict=True):
                if shard != name:
                    close()
                    name, out = int(shard), open(f"{folder}/.{shard}-{TaskContext.get().taskAttemptId()}", "wb")  # noqa: SIM115
                out.write(payload)
        close()
        yield pd.DataFrame(rows, columns=["shard", "path", "n_bytes"])

    return shards.repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "payload").mapInPandas(run, "shard int, path string, n_bytes long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(read_table(spark, sf_dir, "documents"))
