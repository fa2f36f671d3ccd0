"""Operator 7: substring dedup by relative Lempel-Ziv parsing.

Passages (see repeats.py) are parsed against reference blocks. A block is a run of passages, in the order of their
documents; its index has the hash of every window, sorted, with the place it starts at. Parsing a passage goes from left to
right: at a window that the index knows from another passage, a factor begins; of all places the index gives, the longest
common extension, word by word, is the factor. The next factor is sought at the boundary: from the first window that hangs
over the end of the last one, since another reference may know it. A factor of `window` words or more is a duplicate span;
shorter ones are literals and name nothing. Each passage is parsed against every block that its bucket has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, encoded, mix64, read_table, row_keyed
from .repeats import Unit, merged, repeated_spans, runs

#: Passages that one reference block holds.
BLOCK = 1024


class ReferenceBlock:
    """The windows of some passages, sorted by hash."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the index that has each hash."""
        return np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")


def longest(words: np.ndarray, at: int, end: int, places: np.ndarray, ends: np.ndarray) -> int:
    """The length of the longest of the places' common extensions with what stands at `at`, up to the passages' ends."""
    most = int(min(end - at, (ends - places).max()))
    step = np.arange(most)
    reach = places[:, None] + step
    same = (words[np.minimum(reach, len(words) - 1)] == words[at : at + most]) & (reach < ends[:, None])
    return int(np.where(same.all(1), most, same.argmin(1)).max())


def parse(frame: pd.DataFrame, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last distance) of the runs of windows inside factors of window words or more. Words are compared by
    numbers that a dictionary of the frame's words gives, so a clash of hashes never makes a factor."""
    lo, hi = frame["lo"].to_numpy().astype(np.int64), frame["hi"].to_numpy().astype(np.int64)
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.array([numbers[w] for t in frame["passage"] for w in t.split()], dtype=np.int64)
    length = hi - lo + unit.window
    begin = np.r_[0, np.cumsum(length)]
    count = hi - lo + 1
    owner = np.repeat(np.arange(len(frame)), count)
    first_window = np.r_[0, np.cumsum(count)]
    place = np.arange(first_window[-1]) - first_window[owner] + begin[owner]
    h = Rolling(mix64(words.astype(np.uint64) + np.uint64(1))).of(place, place + unit.window) ^ mix64(frame["key"].to_numpy().view(np.uint64))[owner]
    own_passage = np.repeat(np.arange(len(frame)), length)
    found = np.zeros(len(h), dtype=bool)
    for a in range(0, len(frame), BLOCK):
        b = min(len(frame), a + BLOCK)
        own = slice(first_window[a], first_window[b])
        block = ReferenceBlock(h[own], place[own])
        left, right = block.lookup(h)
        known = np.flatnonzero(right - left > ((owner >= a) & (owner < b)))
        i = 0
        while i < len(known):
            w = known[i]
            p, at = owner[w], place[w]
            places = block.places[left[w] : right[w]]
            places = places[places != at]
            n = longest(words, at, begin[p + 1], places, begin[own_passage[places] + 1])
            if n < unit.window:  # equal hashes of different words
                i += 1
                continue
            found[w : w + n - unit.window + 1] = True
            i = np.searchsorted(known, w + n - unit.window + 1)
    return runs(owner[::-1], (hi[owner] - (place - begin[owner]))[::-1], found[::-1])


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 8, shard: int = 2048) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_text, spans (ranges of removed words, start << 32 | end).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts elsewhere, in any
    document. Null and empty texts have no words and an empty kept_text; repeated rows count as documents of their own (so
    each is the other's repeat); a null doc_id stays null; other columns are ignored, whatever their names.
    """
    keyed = row_keyed(docs, "doc_id", "text")
    spans = repeated_spans(keyed, Unit("words", window, k, shard), parse)
    schema = f"doc_id {dict(keyed.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string, spans array<long>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, gone, kept, cuts = [], [], [], []
            for text, found in zip(encoded(pdf["text"]), pdf["spans"], strict=True):
                words = text.split()
                ranges = merged(found)
                n.append(len(words))
                gone.append(sum(b - a for a, b in ranges))
                for a, b in reversed(ranges):
                    del words[a:b]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                cuts.append([a << 32 | b for a, b in ranges])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "n_removed": gone, "kept_text": kept, "spans": cuts})

    return keyed.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", "spans").mapInPandas(cut, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
