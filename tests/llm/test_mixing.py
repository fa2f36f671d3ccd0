"""Operator 1: targets, exactness of the plan, and what documents give."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from tidewatch.llm import mixing
from tidewatch.llm.permute import feistel

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        for key in (0, 9):
            assert sorted(feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert feistel(np.arange(1000), 1000, 1).tolist() != feistel(np.arange(1000), 1000, 2).tolist()
    mixed = feistel(np.array([0, 1, 2, 0, 1]), np.array([3, 3, 3, 2, 2]), np.array([5, 5, 5, 6, 6]))
    assert sorted(mixed[:3]) == [0, 1, 2] and sorted(mixed[3:]) == [0, 1]


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [Fraction(200), Fraction(250, 3), Fraction(500, 3)]
    assert mixing.targets([0, 10], [3, 1]) == [0, 15]
    assert mixing.targets([0, 0], [3, 1]) == [0, 0]
    assert mixing.targets([], []) == []


def test_documents(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text", "source").collect()
    total = Counter()
    for r in rows:
        total[r.source] += len(W.findall(r.text or ""))
    plan, placed, segments = mixing.mix(mixing.measure(odd_docs))
    assert [s for s in plan.sources] == ["a", "b", None]
    assert plan.sizes == [total[s] for s in plan.sources]
    seg = segments.collect()
    assert sorted(map(str, seg)) == sorted(map(str, mixing.mix(mixing.measure(odd_docs))[2].collect()))
    by = {(p.src, p.start): p for p in placed.collect() if p["size"]}
    assert len(by) == sum(1 for r in rows if W.search(r.text or ""))
    taken, seen = Counter(), defaultdict(set)
    for s in seg:
        p = by[(s.src, s.start)]
        words = set(range(s.at, s.at + s.length))
        assert s.at >= 0 and s.at + s.length <= p["size"] and not words & seen[(s.src, s.start, s.epoch)]
        seen[(s.src, s.start, s.epoch)] |= words
        taken[s.src] += s.length
        assert s.epoch < 2
    for i, goal in enumerate(plan.targets):
        assert abs(taken[i] - goal) <= 2 * plan.block
    slots = [(s.shard, s.slot) for s in mixing.slots(spark, plan).collect()]
    assert len(slots) == len(set(slots)) == plan.draws.sum()


def test_mixed_documents(spark, odd_docs):
    docs = odd_docs.where("doc_id <> 1 or doc_id is null")
    plan, placed, segments = mixing.mix(mixing.measure(docs))
    want = segments.groupBy().sum("length").first()[0]
    got = mixing.mixed_documents(docs).collect()
    assert sum(len(W.findall(r.text)) for r in got) == want
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        assert r.n_chars == len(r.text)
        assert any(set(W.findall(r.text)) <= set(W.findall(t)) for t in texts[r.doc_id])
    repeated = odd_docs.where("doc_id = 1")
    words = [W.findall(r.text) for r in mixing.mixed_documents(repeated).collect()]
    assert sum(map(len, words)) == mixing.mix(mixing.measure(repeated))[2].groupBy().sum("length").first()[0]


def test_draws_follow_the_quotas():
    r = random.Random(1)
    plan = mixing.make_plan([(f"s{i}", r.randint(1, 10_000_000)) for i in range(30)], 2048, 3)
    for got, goal, b in zip(plan.draws.sum(0), plan.targets, plan.blocks):
        assert got == min(round(goal / 2048), 2 * b)
    assert plan.draws.sum(1).max() - plan.draws.sum(1).min() <= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(mixing.measure(docs))[2].collect() == [] and mixing.mixed_documents(docs).collect() == []


def test_small_sources_do_not_vanish():
    plan = mixing.make_plan([("a", 5), ("b", 40_000_000), (None, 300)], 250, 1)
    assert all(d > 0 for d in plan.draws.sum(0))


def test_rows_that_differ_in_language_only(spark):
    """Rows that agree in id, text and source stay apart, each with its own language."""
    text = "some words that say little " * 20
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (1, text, "de", "a", 5), (None, text, "fr", "a", 5), (None, text, None, "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(docs).collect()
    assert {(r.doc_id, r.lang) for r in got} == {(1, "en"), (1, "de"), (None, "fr"), (None, None)}


def test_cutting_a_text_makes_no_hashes_of_its_words(spark):
    """Cutting needs where words begin and end; hashes of a large text would take many times its size."""
    assert "word_hashes" not in vars(mixing) and "word_bounds" in vars(mixing)
    docs = spark.createDataFrame([(1, " z\u00e4hl\twort  \U0001f600 " * 400, "en", "a", 5), (2, "x " * 900, "en", "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mix(mixing.measure(docs))[2].groupBy().sum("length").first()[0]
    got = mixing.mixed_documents(docs).collect()
    assert sum(len(W.findall(r.text)) for r in got) == taken and {w for r in got for w in W.findall(r.text)} <= {"z\u00e4hl", "wort", "\U0001f600", "x"}
