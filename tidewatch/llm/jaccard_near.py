"""Near copies by the Jaccard similarity of word shingles: SimHash names the candidates, the shingles themselves decide.

Fingerprints are searched in op6's vantage-point trees (simhash_near.py), which reach as far as their triangle bounds prune.
Pairs that are similar and lie further apart come from bands of least shingles; what either names is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, keyed_stream, lean_batches, materialize, mix64, only_marked, row_keyed, word_hashes
from .components import components
from .simhash_near import _union, near_links

#: Words of a shingle and the similarity from which two texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
#: Bits up to which the trees are searched: beyond, a shard's bounds reach over most of the others.
TREE_RADIUS = 3
#: Bits in which the SimHash of two candidates may differ. At similarity 0.8 some 10 differ, with a deviation of 3.
RADIUS = 24
#: Bands of smallest shingles. Of two texts of similarity 0.8 all bands differ in one case of 2e9: (1 - 0.8^3)^30.
BANDS, ROWS = 30, 3
#: Shingles whose bits are counted at a time, and cells of a comparison.
_VOTES, _CELLS = 1 << 16, 1 << 21
#: Sets up to which a group's pairs are all counted.
_FEW = 24
_FLIP, _TIMES = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(k << 32))[:, None] for k in (1, 2))
_TIMES = _TIMES | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the lower-cased (A-Z) word shingles, sorted; a shorter text is one shingle, one without words none."""
    h = word_hashes(text.lower())[0]
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = mix64(out + h[i : i + n])
    return np.unique(out)


def simhash(h: np.ndarray) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), _VOTES):
        votes += np.unpackbits(h[lo : lo + _VOTES].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def bands(h: np.ndarray) -> np.ndarray:
    """A hash of each band: its number and the least values that ROWS orders of all shingles give to this set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(h), 2048):
        np.minimum(least, ((h[lo : lo + 2048] ^ _FLIP) * _TIMES).min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mix64(out + row)
    return out


def _set_key(h: np.ndarray) -> int:
    return int(mix64(mix64(h).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))).view(np.int64)[0])


def band_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (fp, bands, perhaps repeated) -> links (u, v) that join all fingerprints which share a band and lie within `radius` bits."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]  # copies
        key, fp = key[new], fp[new]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        first = np.repeat(edge[:-1], np.diff(edge))
        near = np.bitwise_count(fp ^ fp[first]) <= radius
        parent = np.where(near, first, np.arange(len(key)))
        for i in np.flatnonzero(np.add.reduceat(~near, edge[:-1])):  # not all are near the first: every pair
            lo, hi = edge[i], edge[i + 1]
            x, own = fp[lo:hi], parent[lo:hi] - lo
            step = max(1, _CELLS // len(x))
            for j in range(0, len(x), step):
                a, b = np.nonzero(np.bitwise_count(x[j : j + step, None] ^ x[None, :]) <= radius)
                _union(own, j + a, b)
            parent[lo:hi] = own + lo
        moved = np.flatnonzero(parent != np.arange(len(key)))
        return pd.DataFrame({"u": fp[moved].view(np.int64), "v": fp[parent[moved]].view(np.int64)})

    rows = fps.select(F.explode("bands").alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(keyed_stream(compare, "key"), "u long, v long").where("u <> v").distinct()


def candidate_groups(own: DataFrame) -> DataFrame:
    """own (s, fp, bands) -> s, cand: sets that links of the trees or of the bands join, without those that are alone."""
    links = near_links(own.select("fp").distinct(), TREE_RADIUS).union(band_links(own))
    stars = components(links)
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("cand")).union(stars.select(F.col("v").alias("fp"), F.col("v").alias("cand")).distinct())
    sets = own.select("s", "fp").distinct().join(member, "fp", "left").select("s", F.coalesce("cand", "fp").alias("cand"))
    sets = materialize(sets, "candidates")
    return sets.join(sets.groupBy("cand").agg(F.count("*").alias("n")).where("n > 1").select("cand"), "cand")


def shared_prefix(hashes: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the earlier sets that may be similar to i), for each i that has some.

    Hashes are ordered by how few of these sets have them. Two sets of the similarity share at least ceil(similarity * n) hashes,
    with n the size of either, and so one among the first n - ceil(similarity * n) + 1 of each: only these are looked up.
    Of up to _FEW sets all earlier ones are named, which is quicker.
    """
    if len(hashes) <= _FEW:
        yield from ((i, np.arange(i)) for i in range(1, len(hashes)))
        return
    size = np.array([len(h) for h in hashes])
    token, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(hashes)), size)
    order = np.lexsort((token, count[token], owner))
    token, place = token[order], np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    kept = place <= (size - np.ceil(similarity * size - 1e-9))[owner]
    token, owner = token[kept], owner[kept]
    by_token = np.argsort(token, kind="stable")  # owners ascend within a token
    start = np.flatnonzero(np.r_[True, np.diff(token[by_token]) != 0])
    first, at = np.empty(len(token), np.int64), np.empty(len(token), np.int64)
    first[by_token] = np.repeat(start, np.diff(np.r_[start, len(token)]))
    at[by_token] = np.arange(len(token))
    edge = np.searchsorted(owner, np.arange(len(hashes) + 1))
    holders, earlier = owner[by_token], at - first
    for i in np.unique(owner[earlier > 0]):
        lo, n = first[edge[i] : edge[i + 1]], earlier[edge[i] : edge[i + 1]]
        seen = np.zeros(i, dtype=bool)
        seen[holders[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        yield int(i), np.flatnonzero(seen)


def join_similar(hashes: list[np.ndarray], fps: np.ndarray, similarity: float = SIMILARITY, radius: int = RADIUS) -> np.ndarray:
    """Of each set of sorted distinct hashes the first set of its group; pairs within the radius and of the similarity are joined.
    Pairs that the prefix filter, the sizes or a shared group leave open are counted exactly, in blocks that grow."""
    size = np.array([len(h) for h in hashes])
    parent = np.arange(len(hashes))
    for i, left in shared_prefix(hashes, similarity) if len(hashes) > 1 and size.any() else ():
        least, most = np.minimum(size[left], size[i]), np.maximum(size[left], size[i])
        left = left[(parent[left] != parent[i]) & (np.bitwise_count(fps[left] ^ fps[i]) <= radius) & (least >= similarity * most - 1e-9)]
        step = 1
        while len(left):
            now, left = left[:step], left[step:]
            cat = np.concatenate([hashes[j] for j in now])
            found = hashes[i][np.minimum(np.searchsorted(hashes[i], cat), size[i] - 1)] == cat
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(size[now]) - size[now])
            for j in now[both >= similarity * (size[i] + size[now] - both) - 1e-9]:
                a, b = sorted((parent[i], parent[j]))
                parent[: i + 1][parent[: i + 1] == b] = a
            left = left[parent[left] != parent[i]]
            step = min(2 * step, max(1, _CELLS // max(1, int(most.max()))))
    return parent


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, _k1, _k2 (see row_keyed), group: texts of similarity SIMILARITY or more are joined, and what these join.

    Null texts and those without words are one group. Sets whose fingerprints the trees find within TREE_RADIUS bits, or that
    share a band and lie within RADIUS bits, are joined to candidate groups, and within these all pairs are compared exactly,
    but for those that are joined already.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t) for t in encoded(pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "_k1": pdf["_k1"], "_k2": pdf["_k2"], "s": [_set_key(h) for h in sets], "fp": [simhash(h) for h in sets], "bands": [bands(h).view(np.int64) for h in sets]})

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cand": pdf["cand"], "s": pdf["s"], "fp": pdf["fp"], "h": [shingles(t).tobytes() for t in encoded(pdf["text"])]})

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("s")  # repeated rows
        cand, s, fp = pdf["cand"].to_numpy(), pdf["s"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.r_[True, cand[1:] != cand[:-1], True])
        root = [lo + join_similar([np.frombuffer(h, np.uint64) for h in pdf["h"].iloc[lo:hi]], fp[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"s": s, "group": s[np.concatenate(root)]})

    keyed = row_keyed(lean_batches(docs), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = "_k1 long, _k2 long"
    own = materialize(keyed.mapInPandas(describe, f"doc_id long, {keys}, s long, fp long, bands array<long>"), "shingle-sets")
    one = own.join(candidate_groups(own), "s").groupBy("s", "cand").agg(F.first(F.struct("_k1", "_k2", "fp")).alias("r")).select("s", "cand", "r.*")
    one = materialize(one, "one-of-each")
    texts = only_marked(keyed.select("_k1", "_k2", "text"), one).join(one, ["_k1", "_k2"]).mapInPandas(unfold, "cand long, s long, fp long, h binary")
    found = texts.repartition("cand").sortWithinPartitions("cand", "s").mapInPandas(keyed_stream(verify, "cand"), "s long, group long")
    return own.select("doc_id", "_k1", "_k2", "s").join(found, "s", "left").select("doc_id", "_k1", "_k2", F.coalesce("group", "s").alias("group"))
