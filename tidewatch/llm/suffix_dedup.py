"""Operator 8: byte-level dedup with a logarithmic family of suffix arrays.

The index is dealt into buckets of anchors (see repeats.py). In a bucket, documents arrive in batches. A batch gets a suffix
array: its suffixes in the order of their bytes. It is merge-scanned with each existing level, where suffixes that share
`window` bytes or more stand beside each other, becomes a level itself, and levels of about equal size merge, so that a bucket of n
passages has some log n levels.

Suffixes begin at the windows of anchors with partners, the only places where a match can. Sorting is induced from the
anchors outward: the suffixes at the anchors are sorted by their bytes, and the order of the suffixes one byte further left
is the stable order of that byte over the order before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, byte_symbols, encoded, read_table, row_keyed
from .repeats import Unit, merged, repeated_spans, runs

#: Passages of a batch of documents.
BATCH = 1024


class SuffixFamily:
    """Suffix arrays of geometrically growing sizes over the passages of a frame (see repeats.PASSAGE)."""

    def __init__(self, frame: pd.DataFrame, unit: Unit) -> None:
        texts = list(frame["passage"])
        self.unit = unit
        self.key = frame["key"].to_numpy()
        self.lo, self.hi = frame["lo"].to_numpy().astype(np.int64), frame["hi"].to_numpy().astype(np.int64)
        data = b"".join(texts)
        self.anchor = np.cumsum([0, *map(len, texts[:-1])]) + self.hi
        self.hashes = Rolling(byte_symbols(data))
        #: The suffix at each anchor, and the bytes to its left, the nearest first.
        self.suffix = [t[h:] for t, h in zip(texts, self.hi.tolist(), strict=True)]
        back = np.arange(1, int(self.hi.max()) + 1)
        raw = np.frombuffer(data, dtype=np.uint8)
        self.left = np.where(back <= self.hi[:, None], raw[np.maximum(self.anchor[:, None] - back, 0)], 0).astype(np.uint8).T.copy()
        self.repeated = np.zeros((len(frame), len(back) + 1), dtype=bool)
        self.levels: list[np.ndarray] = []

    def sort(self, members: list[int]) -> np.ndarray:
        """Members by the bytes of their suffix. (Sorting two sorted levels laid end to end merges them in linear time.)"""
        return np.array(sorted(members, key=self.suffix.__getitem__), dtype=np.int64)

    def scan(self, level: np.ndarray) -> None:
        """Mark the windows that neighbours share, in the orders that the level induces at each distance from the anchors."""
        _, at, many = np.unique(self.key[level], return_inverse=True, return_counts=True)
        order = level[many[at] > 1]
        w = self.unit.window
        for d in range(int(self.hi[order].max()) + 1 if len(order) else 0):
            if d:
                order = order[self.hi[order] >= d]  # the others have no suffix that far left
                order = order[np.argsort(self.left[d - 1][order], kind="stable")]
            own = order[self.lo[order] <= d]
            if len(own) > 1:
                start = self.anchor[own] - d
                h = self.hashes.of(start, start + w)
                same = h[1:] == h[:-1]
                if same.any():
                    self.repeated[own[1:][same], d] = True
                    self.repeated[own[:-1][same], d] = True

    def add(self, members: range) -> None:
        """A new batch: its suffix array, a merge-scan with each level, and merges while two levels are about equal."""
        new = self.sort(list(members))
        self.scan(new)
        for level in self.levels:
            near, mine = level[np.isin(self.key[level], self.key[new])], new[np.isin(self.key[new], self.key[level])]
            if len(near):
                self.scan(self.sort([*near.tolist(), *mine.tolist()]))
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self.sort([*before.tolist(), *last.tolist()]))


def scan(frame: pd.DataFrame, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last distance) of the runs of windows that two or more passages of the frame have."""
    if not len(frame):
        return (np.zeros(0, np.int64),) * 3
    family = SuffixFamily(frame, unit)
    for lo in range(0, len(frame), BATCH):
        family.add(range(lo, min(len(frame), lo + BATCH)))
    n, width = family.repeated.shape
    return runs(np.repeat(np.arange(n), width), np.tile(np.arange(width), n), family.repeated.ravel())


def remove_repeats(docs: DataFrame, window: int = 400, k: int = 100, shard: int = 2048) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (removed ranges of bytes,
    start << 32 | end).

    A byte of the UTF-8 text goes if a string of `window` bytes covers it that also starts elsewhere, in any document. Null
    texts are empty; repeated rows count as documents of their own; a null doc_id stays null; other columns are ignored.
    """
    keyed = row_keyed(docs, "doc_id", "text")
    spans = repeated_spans(keyed, Unit("bytes", window, k, shard), scan)
    schema = f"doc_id {dict(keyed.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, gone, kept, cuts = [], [], [], []
            for text, found in zip(encoded(pdf["text"]), pdf["spans"], strict=True):
                ranges = merged(found)
                n.append(len(text))
                gone.append(sum(b - a for a, b in ranges))
                ends = [0, *(b for _, b in ranges)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in ranges), len(text)], strict=True)))
                cuts.append([a << 32 | b for a, b in ranges])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n, "n_removed": gone, "n_spans": [len(x) for x in cuts], "kept": kept, "spans": cuts})

    return keyed.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "spans").mapInPandas(cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
