"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; the same class splits bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; unlike checkpoint() it computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that texts travel in: ten thousand texts, Spark's default, would fill some 100 MB on either side.
BATCH_ROWS = 1000


def lean_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches; smaller bounds stay."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps (it acts on the driver's garbage)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is one scan of files, perhaps projected or filtered: a row is then known by its file and its place in it."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in df.columns and bool(df.inputFiles())


def row_keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs and (_k1, _k2), by which rows derived from a document find it again: no two rows share them, however
    alike. They are a hash of the file's name and the row's place in it, which no split of the input, lost executor or
    second read changes; that no two files share a hash is checked. What is not a plain scan of Parquet is written first."""
    if _plain_scan(docs):
        path = F.col("_metadata.file_path")
        try:
            seen = docs.select(path.alias("f")).distinct().agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("f")).alias("m")).first()
            keyed = docs.select(*columns, F.xxhash64(path).alias("_k1"), F.col("_metadata.row_index").alias("_k2"))
            if seen.n == seen.m:
                return keyed
        except AnalysisException:  # a format that has no places
            pass
    return row_keyed(materialize(docs.select(*columns), "rows", "zstd"), *columns)


#: Rows of a table of marks (64 documents each, some 32 bytes) up to which it is broadcast; beyond, Spark chooses.
MARK_ROWS = 1 << 20


def only_marked(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of keyed (_k1, _k2, ...; see row_keyed) whose keys rows (_k1, _k2) has. Keys travel as one bit for each document,
    64 to a number, so the texts beside the keys are read and kept or left where they are, without a shuffle."""
    word = F.shiftright("_k2", 6)
    bits = rows.groupBy("_k1", word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_k2 & 63 AS INT))")).alias("_bits"))
    bits = materialize(bits, "marks")
    if bits.count() <= MARK_ROWS:
        bits = F.broadcast(bits)
    found = keyed.withColumn("_word", word).join(bits, ["_k1", "_word"])
    return found.where("getbit(_bits, CAST(_k2 & 63 AS INT)) = 1").select(*keyed.columns)


def keyed_stream(fn: Callable[[pd.DataFrame, bool], pd.DataFrame | None], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over partitions sorted by key: call fn with frames that hold whole keys only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and held[-1][key].iloc[-1] != pdf[key].iloc[0]:
                yield fn(pd.concat(held, ignore_index=True))
                held = []
            last = pdf[key].to_numpy()
            cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if last[0] != last[-1] else 0
            if cut:
                yield fn(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _POW[base] = got
    return got[:n]


class Rolling:
    """Fingerprints of any slice of a sequence of 64-bit symbols, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def fixed(self, length: int) -> np.ndarray:
        """Of every slice of this length."""
        m = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:m]) * self.inverse[:m]) if m > 0 else np.zeros(0, np.uint64)


def byte_symbols(data: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(data, dtype=np.uint8)]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a 64-bit hash, start and end in bytes) of each word of UTF-8 data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_bounds(raw)
    rolling = Rolling(_BYTE[raw])
    return rolling.of(starts, ends) ^ mix64((ends - starts).astype(np.uint64)), starts, ends


def chunks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > limit:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def encoded(column: pd.Series) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in column]
