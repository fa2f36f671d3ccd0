"""The near-dedup stage against brute-force Jaccard similarity of word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import jaccard_near
from tidewatch.llm.common import materialize, only_marked, row_keyed


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute_first(rows):
    sets = [brute_set(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if like(sets[i], sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(first.get(find(i), (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return sorted(first.values())


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


@pytest.fixture(scope="module")
def edited(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    common = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.choice([3, 5, 8, 60, 100, 200]))]
        for k in range(4):  # edits at several places, on both sides of the bound
            copy = list(words)
            for at in r.sample(range(len(copy)), min(len(copy), r.randint(0, 1 + len(copy) // 30))):
                copy[at] = word()
            rows.append((10 * i + k, " ".join(copy) + (" " + common if i % 3 == 0 else ""), "en", "a", 1))
    many = [word() for _ in range(80)]  # one large group
    for i in range(100):
        copy = list(many)
        copy[r.randrange(80)] = word()
        rows.append((1000 + i, " ".join(copy), "en", "a", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def test_stage(spark, edited):
    rows = edited.collect()
    got = ids(corpus_pipeline.near_dedup(spark, edited, "").collect())
    assert got == brute_first(rows) and len(got) < len(rows) - 150


def test_odd(spark, odd_docs):
    assert ids(corpus_pipeline.near_dedup(spark, odd_docs, "").collect()) == brute_first(odd_docs.collect())
    assert jaccard_near.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_join_similar():
    """Groups of the prefix filter and of few sets equal those of all pairs, also without hashes, of one set and at the bound itself."""
    r = np.random.default_rng(1)
    for n in [0, 1, 2, 9, 24, 25, 60, 150] * 4:
        sets = [np.unique(r.integers(0, 40 + 40 * (k % 3), int(r.integers(0, 50)))).astype(np.uint64) for k in range(n)]
        sets = [s if k < 5 or r.random() < 0.4 else np.delete(sets[k - 5], slice(0, int(r.integers(0, 4)))) for k, s in enumerate(sets)]
        sets = [s for k, s in enumerate(sets) if len(s) or k == 0]
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(set(sets[i]) & set(sets[j]))
                if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert (jaccard_near.join_similar(sets, np.zeros(len(sets), np.uint64)) == want).all()


def test_trees_and_bands(spark):
    """Fingerprints within the trees' radius are candidates without a shared band; further apart, those of one band are."""
    fp = 0x0F0F_3355_1234_5678
    rows = [(1, fp, [10, 11]), (2, fp ^ 0b111, [20, 21]), (3, fp ^ (1 << 40), [30, 31])]  # the trees'
    rows += [(4, fp ^ (0xFFFF << 16), [40, 41]), (5, fp ^ (0xFFF << 16), [50, 41]), (6, ~fp, [60, 41])]  # 4 bits apart: the band's; the last is too far
    rows += [(7, fp ^ (0xFFFFFF << 8), [70, 71]), (8, fp ^ (0xFFFFFF << 8), [80, 81]), (9, fp ^ (0xFF << 48), [90, 91])]  # one fingerprint of two sets; alone
    found = jaccard_near.candidate_groups(spark.createDataFrame(rows, "s long, fp long, bands array<long>")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cand, set()).add(r.s)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [7, 8]]


def test_only_marked(spark, tmp_path):
    """The rows marked, whatever their place in a file and the number of files; texts beside the keys are not shuffled."""
    spark.range(0, 1000, 1, 3).selectExpr("id", "CAST(id AS string) AS text").write.parquet(str(tmp_path / "t"))
    keyed = row_keyed(spark.read.parquet(str(tmp_path / "t")), "id", "text")
    for want in ([], [0], [63, 64, 127, 999], list(range(0, 1000, 3)), list(range(1000))):
        rows = materialize(keyed.where(F.col("id").isin(want)).select("_k1", "_k2"), "some")
        out = only_marked(keyed, rows.union(rows))
        assert sorted(r.id for r in out.collect()) == want and out.columns == keyed.columns
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_texts_stay(spark, tmp_path):
    """The stage keeps and leaves rows without a shuffle of their texts, also where Spark may broadcast nothing by itself."""
    spark.createDataFrame([(i, f"text of number {i // 2} " * 9, "en", "a", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "")
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 2))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
