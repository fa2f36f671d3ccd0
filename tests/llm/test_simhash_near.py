"""Operator 6 against brute force."""

import random

import pytest
import xxhash

from tidewatch.llm import simhash_near
from tidewatch.llm.components import components


def brute_fp(text):
    words = ((text or "").encode().lower()).split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_documents(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    group = brute_groups(fps, 3)
    least = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    want = sorted(str((r.doc_id, f"{f:016x}", least[g])) for r, f, g in zip(rows, fps, group))
    got = simhash_near.near_groups(odd_docs).select("doc_id", simhash_near.hex_fingerprint(simhash_near.F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("radius,cell", [(3, 500), (3, 2), (2, 5), (1, 3), (4, 10), (0, 5)])
def test_links(spark, radius, cell):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(3):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    x = r.getrandbits(64)
    for b in range(0, 40, 2):  # a chain
        x ^= 3 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    links = simhash_near.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, cell)
    stars = {r.u: r.v for r in components(links).collect()}
    group = brute_groups(fps, radius)
    mine = [stars.get(s, s) for s in signed]
    assert len(set(zip(group, mine))) == len(set(group)) == len(set(mine))


def test_empty(spark):
    assert simhash_near.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("radius,dense", [(3, False), (3, True), (2, False), (0, False)])
def test_tree(monkeypatch, radius, dense):
    """The upper tree files each value once as its own; with the trees within the shards, all near pairs meet."""
    import numpy as np

    monkeypatch.setattr(simhash_near, "LEAF", 8)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 8 if dense else 300, dtype=np.uint64)
    near = np.repeat(base, 60 if dense else 3)
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
    fps = np.unique(np.r_[base, near])
    halves = [(fps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (fps >> np.uint64(32)).astype(np.uint32)]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    leaves = 0
    for x in halves:
        leaf, at, own = simhash_near.file(simhash_near.fit(x[::2], 4, radius // 2), x, radius // 2)
        assert sorted(at[own]) == list(range(len(fps)))
        leaves = max(leaves, len(set(leaf)))
        for k in set(leaf):
            here = at[leaf == k]
            for i, p in enumerate(simhash_near.search(fps[here], x[here], own[leaf == k], radius)):
                parent[find(here[i])] = find(here[p])
    assert leaves > 4
    want = brute_groups([int(f) for f in fps], radius)
    mine = [find(i) for i in range(len(fps))]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))
