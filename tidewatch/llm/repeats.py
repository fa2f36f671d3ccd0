"""Candidate search that both long-repeat operators share: which passages of at least `window` units occur twice or more.

Every window of `window` units (words or bytes) picks one anchor: its leftmost k-gram with the smallest hash, a function
of the window's content alone. So two equal windows pick anchors with equal k-grams at equal distances, and comparing the
passages around equal anchors finds every repeat. A passage is the text of all windows that pick its anchor. About 2 of
(window - k) positions become anchors, which bounds what is shuffled. Anchors whose k-gram occurs once are dropped by a
count; equal passages form a class and are settled by its size, so thousands of copies cost one row each and no pairs.
One member of each class goes to a shard of the index, and there the operator's own method compares it with the others:
relative Lempel-Ziv factors (substring_dedup.py) or suffix arrays (suffix_dedup.py).

A key is an anchor's k-gram. One with more passages than a shard should hold is split by what stands beside it: of the
windows that pick an anchor, those that reach further to its left share a longer gram to the left, the others one to the
right, so each passage goes under two longer grams, each with half of its windows. That is repeated while a key is too
large and its grams are shorter than the window; it loses no pair of equal windows, and no task holds a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, byte_symbols, chunks, encoded, keyed_stream, lean_batches, materialize, mix64, row_keyed, word_hashes

_LOW = np.uint64((1 << 24) - 1)
#: Units of one text that are anchored at a time.
_PIECE = 1 << 21
#: Passages of one bucket, on average: what a task compares at a time.
BUCKET = 4096

Match = Callable[[pd.DataFrame, "Unit"], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Unit:
    """What a window is made of. window: its units; k: those of an anchor; shard: passages of one key beyond which it is
    split."""

    kind: str
    window: int
    k: int
    shard: int = 2048

    @property
    def slack(self) -> int:
        return self.window - self.k

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.parsed(texts)[:2]

    def parsed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
        """The units' 64-bit symbols over all texts; where each text's begin (and the last ends); the bytes of a range."""
        if self.kind == "bytes":
            data = b"".join(texts)
            return byte_symbols(data), np.cumsum([0, *map(len, texts)]), lambda a, b: data[a:b]
        data = b"\n".join(texts)
        hashes, starts, ends = word_hashes(data)
        return hashes, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])), lambda a, b: data[starts[a] : ends[b - 1]]


def find_anchors(symbols: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text, position in it, k-gram hash, passage's hash, least and greatest distance from a window's start to the anchor it
    picks), an entry for each anchor."""
    n, w = len(symbols), unit.slack + 1
    if n < unit.window:
        return tuple(np.zeros(0, t) for t in ("i8", "i8", "u8", "u8", "i8", "i8"))
    rolling = Rolling(symbols)
    grams = rolling.fixed(unit.k)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(unit.window, n + 1) <= offsets[text[: len(least)] + 1])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in ("i8", "i8", "u8", "u8", "i8", "i8"))
    picked = (least[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    last = np.r_[first[1:], len(picked)] - 1
    at = picked[first]
    near, far = at - starts[last], at - starts[first]
    passage = rolling.of(at - far, at - near + unit.window) ^ mix64(((near << 32) | far).astype(np.uint64))
    t = text[at]
    return t, at - offsets[t], grams[at], passage, near, far


def _anchor_rows(unit: Unit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, k1, k2 = encoded(pdf["_text"]), pdf["_k1"].to_numpy(), pdf["_k2"].to_numpy()
            for lo, hi in chunks(texts):
                symbols, offsets = unit.symbols(texts[lo:hi])
                parts = [(find_anchors(symbols, offsets, unit), 0)]
                if len(symbols) > 2 * _PIECE:  # one very long text: by pieces, each with all windows of its own anchors
                    parts = []
                    for a in range(0, len(symbols), _PIECE):
                        begin = max(0, a - unit.slack - 1)
                        piece = symbols[begin : min(len(symbols), a + _PIECE + unit.window)]
                        found = find_anchors(piece, np.array([0, len(piece)]), unit)
                        own = (found[1] + begin >= a) & (found[1] + begin < a + _PIECE)
                        parts.append((tuple(x[own] for x in found), begin))
                for (t, pos, key, passage, near, far), begin in parts:
                    yield pd.DataFrame({"key": key.view(np.int64), "cls": passage.view(np.int64), "_k1": k1[lo:hi][t], "_k2": k2[lo:hi][t], "pos": (pos + begin).astype(np.int32), "lo": near.astype(np.int16), "hi": far.astype(np.int16)})

    return run


#: A passage: its key (now and at first), class, rows of that class, the distances of its windows, units left and right of
#: the anchor that its key covers, its document, and its bytes, which begin `hi` units before the anchor.
PASSAGE = "key long, first_key long, cls long, n long, lo short, hi short, a short, b short, _k1 long, _k2 long, passage binary"


def _passages(unit: Unit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The passages of the anchors in reps (of one document a row); those of large keys under their longer grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            large: list[bool] = []
            for text, reps, k1, k2 in zip(encoded(pdf["_text"]), pdf["reps"], pdf["_k1"], pdf["_k2"], strict=True):
                if unit.kind == "words":
                    _, starts, ends = word_hashes(text)
                for r in reps:
                    x, y = r["pos"] - r["hi"], r["pos"] - r["lo"] + unit.window
                    own = text[starts[x] : ends[y - 1]] if unit.kind == "words" else text[x:y]
                    out.append((r["key"], r["key"], r["cls"], r["n"], r["lo"], r["hi"], 0, 0, k1, k2, own))
                    large.append(r["large"])
            frame, split = pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGE.split(", ")]), np.array(large, dtype=bool)
            yield frame[~split]
            if split.any():
                yield from longer_grams(frame[split], unit)

    return run


def longer_grams(frame: pd.DataFrame, unit: Unit) -> Iterator[pd.DataFrame]:
    """Each passage under two keys: grams longer to the left and to the right, each with the windows that hold the gram."""
    texts = list(frame["passage"])
    key = frame["key"].to_numpy().view(np.uint64)
    lo, hi, a, b = (frame[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "a", "b"))
    middle = (a + unit.slack - b + 1) // 2
    for x, y in chunks(texts):
        symbols, offsets, cut = unit.parsed(texts[x:y])
        part, rolling, at = slice(x, y), Rolling(symbols), offsets[:-1] + hi[x:y]
        for left in (True, False):
            low = np.maximum(lo[part], middle[part]) if left else lo[part]
            high = hi[part] if left else np.minimum(hi[part], middle[part] - 1)
            own = np.flatnonzero(low <= high)
            more_a, more_b = (middle[part], b[part]) if left else (a[part], unit.slack - middle[part] + 1)
            gram = rolling.of((at - more_a)[own], (at + unit.k + more_b)[own])
            out = frame.iloc[x:y].iloc[own].copy()
            out["key"] = mix64(gram ^ mix64(key[part][own] + np.uint64(1 + left))).view(np.int64)
            out["lo"], out["hi"], out["a"], out["b"] = (v[own].astype(np.int16) for v in (low, high, more_a, more_b))
            out["passage"] = [cut(at[i] - high[i], at[i] - low[i] + unit.window) for i in own]
            yield out


def runs(owner: np.ndarray, d: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last distance) of each maximal run of found windows; d rises within an owner."""
    at = np.flatnonzero(found)
    if not len(at):
        return at, at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return owner[at[first]], d[at[first]], d[at[last]]


def _compared(unit: Unit, match: Match) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, first, last = match(pdf, unit)
        new = owner[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])] if len(owner) else owner
        packed = (first.astype(np.int64) << 32) | last
        lists = np.split(packed, np.flatnonzero(owner[1:] != owner[:-1]) + 1) if len(owner) else []
        alone = pdf["n"].to_numpy()[new] == 1  # a class of more is settled: all its windows occur again
        rows = [(r, x) for r, x, own in zip(new, lists, alone, strict=True) if own]
        return pd.DataFrame({"key": pdf["first_key"].to_numpy()[[r for r, _ in rows]], "cls": pdf["cls"].to_numpy()[[r for r, _ in rows]], "runs": pd.Series([x for _, x in rows], dtype=object)})

    return run


def repeated_spans(keyed: DataFrame, unit: Unit, match: Match) -> DataFrame:
    """keyed (text, _k1, _k2; see row_keyed) -> (_k1, _k2, spans): for each document with repeats the ranges of its units, as
    start << 32 | end, that windows occurring twice or more cover. A document has one span at least for each of its anchors
    in a repeat, so its list is a small part of its text. match(frame, unit): (row, first, last distance) of the runs of
    windows that occur in two or more rows of the frame, which holds whole keys; rows come in the order of documents."""
    texts = lean_batches(keyed).select(F.col("text").alias("_text"), "_k1", "_k2")
    anchors = texts.mapInPandas(_anchor_rows(unit), "key long, cls long, _k1 long, _k2 long, pos int, lo short, hi short")
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("x"), F.max("cls").alias("y")).where("n > 1")
    # A table of its own, so that the join deals both sides by itself and AQE can split the anchors of a hot key.
    keys = materialize(keys.select("key", (F.col("x") == F.col("y")).alias("alike")), "keys")
    shared = materialize(anchors.join(keys, "key"), "anchors")
    mixed = shared.where("not alike")
    classes = mixed.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "pos", "lo", "hi")).alias("r"))
    classes = materialize(classes, "classes")

    def large(of: DataFrame) -> DataFrame:
        # a table, small: shard or more rows stand behind each of its own, and its size decides how it is joined
        return materialize(of.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > unit.shard).select("key"), "large-keys")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from longer_grams(pdf, unit)

    hot = large(classes).withColumn("large", F.lit(True))
    member = F.struct("key", "cls", "n", "r.pos", "r.lo", "r.hi", F.coalesce("large", F.lit(False)).alias("large"))
    reps = classes.join(hot, "key", "left").groupBy("r._k1", "r._k2").agg(F.collect_list(member).alias("reps"))
    now = materialize(texts.join(reps, ["_k1", "_k2"]).mapInPandas(_passages(unit), PASSAGE), "passages", "zstd")
    parts, settled = None, None
    whole = F.col("a") + F.col("b") == unit.slack  # the gram is the window itself: its count settles it
    while True:
        own = now.where(whole)
        settled = own if settled is None else settled.unionByName(own)
        now = now.where(~whole)
        hot = large(now.where("a + b > 0"))  # the first keys are within the bound, or split
        last = hot.isEmpty()
        own = now if last else now.join(hot, "key", "left_anti")
        parts = own if parts is None else parts.unionByName(own)
        if last:
            break
        now = materialize(now.join(hot, "key", "left_semi").mapInPandas(split, PASSAGE), "passages", "zstd")

    n_buckets = classes.count() // BUCKET + 1
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets))).repartition("bucket").sortWithinPartitions("bucket", "_k1", "_k2")
    found = dealt.mapInPandas(keyed_stream(_compared(unit, match), "bucket"), "key long, cls long, runs array<long>")
    pack = lambda a, b: F.array(F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")))
    twice = settled.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    found = found.unionByName(settled.where("n = 1").join(twice, "key", "left_semi").select(F.col("first_key").alias("key"), "cls", pack(F.col("lo"), F.col("hi")).alias("runs")))
    found = found.groupBy("key", "cls").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    found = found.unionByName(classes.where("n > 1").select("key", "cls", pack(F.col("r.lo"), F.col("r.hi")).alias("runs")))
    spans = lambda r: F.transform(r, lambda x: F.shiftleft(F.col("pos") - x.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col("pos") - F.shiftright(x, 32) + unit.window))
    of_mixed = mixed.join(found, ["key", "cls"]).select("_k1", "_k2", spans(F.col("runs")).alias("spans"))
    alike = shared.where("alike").select("_k1", "_k2", spans(pack(F.col("lo"), F.col("hi"))).alias("spans"))
    return of_mixed.unionByName(alike).groupBy("_k1", "_k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray | list | None) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, that cover what the spans cover."""
    if spans is None or not len(spans):
        return []
    x = np.sort(np.asarray(spans, dtype=np.int64))
    start, end = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:], len(x)] - 1].tolist(), strict=True))
