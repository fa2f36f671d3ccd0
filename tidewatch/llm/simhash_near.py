"""Operator 6: SimHash near-dedup over vantage-point trees."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, keyed_stream, lean_batches, materialize, read_table
from .components import components

SEED = 42
#: Shingles whose bits are counted at a time.
_VOTES = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of lower-cased (A-Z) word shingles, as a signed 64-bit integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), _VOTES):
        votes += np.unpackbits(h[lo : lo + _VOTES].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in encoded(texts)], dtype="int64")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a[i] and b[i]; parent keeps every node's smallest known member."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


#: Fingerprints that the upper tree is fitted on, at most. Every fingerprint is filed in it, whatever their number.
SAMPLE = 20_000
#: Fingerprints of a shard at which the upper tree stops, as far as the sample reaches; of a leaf within a shard.
SHARD, LEAF = 2048, 256


@dataclass
class Node:
    """A vantage point and a bound: nearer halves lie in one child, others in the other. A leaf has neither."""

    leaf: int = -1
    point: int = 0
    bound: int = 0
    near: Node | None = None
    far: Node | None = None


def choose(x: np.ndarray, reach: int, tries: int = 12) -> tuple[int, int] | None:
    """(vantage point, bound): of some of the values, spread over all, the one whose median ball has the fewest others within
    `reach` inside its edge, as these are searched on both sides. None where no ball leaves enough on either side."""
    best = None
    for p in x[np.linspace(0, len(x) - 1, min(tries, len(x))).astype(int)]:
        d = np.bitwise_count(x ^ p).astype(np.int64)
        upto = np.cumsum(np.bincount(d))
        for bound in {int(np.searchsorted(upto, len(x) / 2)), int(np.searchsorted(upto, len(x) / 2)) - 1}:
            inside = int(upto[bound]) if bound >= 0 else 0
            edge = inside - (int(upto[bound - reach]) if bound >= reach else 0)
            cost = max(inside, len(x) - inside + edge)
            if inside and inside < len(x) and cost < 0.9 * len(x) and (best is None or cost < best[0]):
                best = cost, int(p), bound
    return best and best[1:]


def fit(sample: np.ndarray, levels: int, reach: int) -> Node:
    """The upper tree: split while levels and values are left."""
    leaves = itertools.count()

    def grow(x: np.ndarray, left: int) -> Node:
        at = choose(x, reach) if left and len(x) >= 16 else None
        if at is None:
            return Node(next(leaves))
        near = np.bitwise_count(x ^ x.dtype.type(at[0])) <= at[1]
        return Node(-1, *at, grow(x[near], left - 1), grow(x[~near], left - 1))

    return grow(sample, levels)


def file(tree: Node, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index, own) of each value: its own leaf, and those it visits because the triangle bound allows a partner there.
    A pair apart is met once: of a node's two sides, the nearer one's values at the edge visit the other side."""
    out: list[tuple[int, np.ndarray, bool]] = []
    todo = [(tree, np.arange(len(x)), np.zeros(0, np.int64))]
    while todo:
        node, own, visit = todo.pop()
        if not len(own) and not len(visit):
            continue
        if node.near is None:
            out += [(node.leaf, own, True), (node.leaf, visit, False)]
            continue
        d, e = (np.bitwise_count(x[i] ^ x.dtype.type(node.point)).astype(np.int64) for i in (own, visit))
        near = d <= node.bound
        todo.append((node.near, own[near], visit[e <= node.bound + reach]))
        todo.append((node.far, own[~near], np.r_[visit[e > node.bound - reach], own[near & (d > node.bound - reach)]]))
    sizes = [len(i) for _, i, _ in out]
    cat = np.concatenate([i for _, i, _ in out]) if out else np.zeros(0, np.int64)
    return np.repeat([k for k, _, _ in out], sizes).astype(np.int64), cat, np.repeat([o for _, _, o in out], sizes).astype(bool)


def search(fp: np.ndarray, half: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a shard the first of its group: the tree goes on to leaves of LEAF, by the shard's half at
    radius // 2 bits, and where halves are too much alike by all 64 bits. Leaves are compared exactly."""
    parent = np.arange(len(fp))
    todo = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while todo:
        mine, visit = todo.pop()
        if not len(mine) or len(mine) + len(visit) < 2:
            continue
        split = None
        if len(mine) > LEAF:
            for x, reach in ((half, radius // 2), (fp, radius)):
                if (at := choose(x[mine], reach)) is None:
                    continue
                d, e = (np.bitwise_count(x[i] ^ x.dtype.type(at[0])).astype(np.int64) for i in (mine, visit))
                near = d <= at[1]
                a = mine[near], visit[e <= at[1] + reach]
                b = mine[~near], np.r_[visit[e > at[1] - reach], mine[near & (d > at[1] - reach)]]
                if max(sum(map(len, a)), sum(map(len, b))) < 0.9 * (len(mine) + len(visit)):
                    split = a, b
                    break
        if split:
            todo += split
            continue
        all_ = np.r_[mine, visit]
        step = max(1, (1 << 20) // len(all_))
        for i in range(0, len(mine), step):
            a, b = np.nonzero(np.bitwise_count(fp[mine[i : i + step], None] ^ fp[None, all_]) <= radius)
            _union(parent, mine[i + a], all_[b])
    return parent


def near_links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """fps (fp: long, distinct) -> links (u, v) that join all fingerprints within `radius` bits, a spanning set of them.

    Two fingerprints within `radius` bits agree within radius // 2 bits on their low or their high 32 bits, so each half has
    a vantage-point tree. Its upper levels are fitted on at most SAMPLE fingerprints and cut all of them into shards;
    fingerprints whose triangle bounds reach over a shard's edge also visit the shard beyond. Each shard goes on splitting
    by points and medians of its own. Every fingerprint is filed, in any number of shards that the bounds ask for. Links
    go to the first of each group a shard finds, so m near copies yield at most m links a shard.
    """
    n = fps.count()
    levels = max(0, math.ceil(math.log2(max(1, n) / shard)))
    rows = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect() if levels else []
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    halves = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32))
    reach = radius // 2
    trees = [fit(x, levels, reach) for x in halves(sample)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            for side, x in enumerate(halves(fp.view(np.uint64))):
                leaf, at, own = file(trees[side], x, reach)
                yield pd.DataFrame({"shard": 2 * leaf + side, "fp": fp[at], "own": own})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        shards, fp, own = pdf["shard"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
        u, v = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x = fp[lo:hi]
            parent = search(x, halves(x)[shards[lo] % 2], own[lo:hi], radius)
            moved = np.flatnonzero(parent != np.arange(hi - lo))
            u.append(x[moved])
            v.append(x[parent[moved]])
        cat = lambda z: np.concatenate(z).view(np.int64) if z else np.zeros(0, np.int64)
        return pd.DataFrame({"u": cat(u), "v": cat(v)})

    dealt = fps.mapInPandas(deal, "shard long, fp long, own boolean").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(keyed_stream(compare, "shard"), "u long, v long").where("u <> v").distinct()


def near_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fp, group (a member's fingerprint), component_id (smallest doc_id of the group).
    One row for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows share all values; a null doc_id
    stays null and is never a component_id, unless no member has one (then it is null); other columns are ignored.
    """
    own = materialize(lean_batches(docs).select("doc_id", fingerprint_column(F.coalesce(F.col("text"), F.lit(""))).alias("fp")), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(near_links(fps.select("fp"), radius))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("group")).union(stars.select(F.col("v").alias("fp"), F.col("v").alias("group")).distinct())
    group = fps.join(member, "fp", "left").select("fp", "least", F.coalesce("group", "fp").alias("group"))
    first = group.groupBy("group").agg(F.min("least").alias("component_id"))
    return own.join(group.select("fp", "group").join(first, "group"), "fp")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
