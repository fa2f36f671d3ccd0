"""Operator 5 against brute force."""

import hashlib
import random

import pytest

from tidewatch.llm import fingerprints


@pytest.mark.parametrize("bins", [1, 2, 7])
def test_chain(spark, odd_docs, bins):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.select("doc_id", "text").collect()]
    got = fingerprints.fingerprint_chain(odd_docs, bins).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    sole = sorted(((i, t) for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1), reverse=True)
    by = {r.doc_id: r for r in got}
    done = 0
    for (i, t), (j, after) in zip(sole, sole[1:]):
        if any(k is not None and j < k < i for k, _ in rows):
            continue  # a repeated doc_id lies between
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = fingerprints.fingerprints([t.encode(), edited.encode()])
        assert by[i].fp & (2**64 - 1) == int(a) and by[i].edited_fp & (2**64 - 1) == int(b)
        assert by[i].near_edited == 1 - (int(a) ^ int(b)).bit_count() / 64
        done += 1
    assert done > 30


def test_last_is_followed_by_first(spark):
    docs = spark.createDataFrame([(i, f"text {i} of a few words") for i in range(50)], "doc_id long, text string").repartition(4)
    by = {r.doc_id: r for r in fingerprints.fingerprint_chain(docs, 5).collect()}
    t, after = "text 0 of a few words", "text 49 of a few words"
    assert by[0].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    one = fingerprints.fingerprint_chain(docs.where("doc_id = 7"), 3).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_half_a_text_is_nearer_than_none():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    a, b = [" ".join(word() for _ in range(300)) for _ in range(2)]
    x, y, z = fingerprints.fingerprints([a.encode(), b.encode(), (a[:900] + b[:900]).encode()])
    assert fingerprints.likeness(x, z) > fingerprints.likeness(x, y) + 0.03


@pytest.mark.parametrize("radius,blocks", [(3, 5), (3, 6), (1, 3), (2, 4)])
def test_near_counts(spark, radius, blocks):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(80)}
    for f in list(fps)[:40]:
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (f >> 63 << 64) for f in fps]
    got = {r.fp & (2**64 - 1): r.n_near for r in fingerprints.near_counts(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, blocks).collect()}
    assert got == {f: sum(0 < (f ^ g).bit_count() <= radius for g in fps) for f in fps}


def test_empty(spark):
    assert fingerprints.fingerprint_chain(spark.createDataFrame([], "doc_id long, text string")).collect() == []
