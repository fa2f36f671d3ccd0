"""Detectors against traces by hand and brute force."""

import numpy as np
import pytest

from tidewatch.operators import binomial, bursts, detect, evaluate, pairs, summarize


def brute_greedy(dps, cost):
    left = sorted(range(len(dps)), key=lambda i: dps[i], reverse=True)
    out = []
    while left:
        event = [left.pop(0)]
        c = 1 / dps[event[0]]
        while left:
            best, low = left[0], cost([*event, left[0]])
            for f in left[1:]:
                if (x := cost([*event, f])) < low:
                    best, low = f, x
            if not low < c:
                break
            event.append(best)
            left.remove(best)
            c = low
        out.append(event)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy(seed):
    r = np.random.default_rng(seed)
    n = 12
    dps = np.round(r.random(n) * 3 + 0.05, 1)
    d = r.random((n, n)) * 2
    d = np.triu(d, 1) + np.triu(d, 1).T
    o = np.triu(r.random((n, n)) * (r.random((n, n)) > 0.3), 1)
    o = o + o.T + np.eye(n)
    with np.errstate(all="ignore"):
        want = brute_greedy(dps, lambda e: d[np.ix_(e, e)].max() / np.float64(o[np.ix_(e, e)].min() * dps[e].sum()))
        assert detect.greedy_original(dps, d, o) == want
        v = r.normal(size=(n, 5))
        u = v / np.linalg.norm(v, axis=1, keepdims=True)

        def cost(e):
            m = u[e[:-1]].mean(0)
            return d[np.ix_(e, e)].max() / ((u[e[-1]] @ m / np.linalg.norm(m) + 1) / 2 * dps[e].sum())

        assert detect.greedy_embedded(dps, d, v) == brute_greedy(dps, cost)


def test_first_nan_stays():
    d = np.array([[0, np.nan, 0.1], [np.nan, 0, 0.1], [0.1, 0.1, 0]])
    assert detect.greedy_original(np.array([3.0, 2.0, 1.0]), d, np.ones((3, 3)))[0] == [0]


def test_medoids():
    d = np.array([[0, 1, 2, 3], [1, 0, 4, 5], [2, 4, 0, 6], [3, 5, 6, 0]], dtype=float)
    label, medoids = detect.k_medoids(d, 2)
    assert label.tolist() == [0, 1, 0, 0] and medoids.tolist() == [0, 1]
    for bad in (dict(k=0), dict(k=5), dict(k=2, init="x")):
        with pytest.raises(ValueError):
            detect.k_medoids(d, **bad)


def test_chain_is_one_cluster(spark):
    words = spark.createDataFrame([(i,) for i in range(4)], "word_id int")
    d = spark.createDataFrame([(0, 1, 0.4), (1, 2, 0.4), (0, 2, 0.8), (0, 3, 9.0), (1, 3, 9.0), (2, 3, 9.0)], "i int, j int, d double")
    assert {tuple(r) for r in detect.cluster_events(words, d).collect()} == {(0, 0), (0, 1), (0, 2)}
    assert {tuple(r) for r in detect.density_clusters(words, d, 0.5, 3).collect()} == {(1, 0), (1, 1), (1, 2)}
    assert detect.density_clusters(words, d, 0.5, 4).collect() == []


def test_components_of_random_graphs(spark):
    r = np.random.default_rng(3)
    edges = [tuple(sorted(map(int, r.choice(60, 2, replace=False)))) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    parent = list(range(92))
    for _ in range(92):
        for i, j in edges:
            parent[i] = parent[j] = min(parent[i], parent[j])
    got = {x.word_id: x.root for x in detect.label_components(spark.createDataFrame(edges, "i int, j int"), spark.range(92).selectExpr("cast(id as int) word_id")).collect()}
    assert got == dict(enumerate(parent))


def test_unknown_vectors_and_flat_words_are_far(spark):
    rows = [(0, [1.0, 0.0], [1.0, 2.0]), (1, [0.0, 0.0], [1.0, 2.0]), (2, [1.0, 1.0], None), (3, [0.0, 1.0], [1.0, 2.0])]
    d = {(r.i, r.j): r.d for r in pairs.cluster_distance(spark.createDataFrame(rows, "word_id int, y array<double>, vec array<double>")).collect()}
    assert d[0, 1] == d[0, 2] == 1e6 and d[0, 3] == 0.0


def test_kl_is_infinite_apart(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])]
    got = {(r.i, r.j): r for r in pairs.kl_pairs(spark.createDataFrame(rows, "word_id int, y array<double>")).collect()}
    assert got[0, 1].divergence == float("inf") and got[0, 2].kl_ij == 1.0 and got[0, 2].divergence == float("inf")
    assert pairs.jsd_pairs(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "word_id int, y array<double>").coalesce(1)).first().jsd == 1.0


def test_intervals_stay_in_the_stream(spark):
    fits = spark.createDataFrame([(0, 0, 2.0, 5.5), (0, 1, 28.0, 3.0)], "event_id int, burst_id int, loc double, scale double")
    assert [tuple(r)[2:] for r in bursts.burst_intervals(fits, 30).orderBy("burst_id").collect()] == [(0, 8), (25, 29)]


def test_sigmoid(spark):
    obs = spark.createDataFrame([("a", 0, 5, 10, 5, 0.5, 0.2, 10), ("a", 1, 7, 10, 7, 0.7, 0.2, 10), ("a", 2, 3, 10, 3, 0.3, 0.2, 10), ("a", 3, 1, 10, 1, 0.1, 0.2, 10)], "word string, day int, c long, n_docs long, c_norm long, p_o double, p_j double, n long")
    got = {r.day: r.p_b for r in binomial.burstiness(obs, spark.createDataFrame([("a", 5)], "word string, r_c long")).collect()}
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] == pytest.approx(1 / (1 + np.exp(-(3 - 3.5)))) and got[3] == 0.0


def test_searches_of_the_older_detector():
    p = np.zeros((30, 4))
    p[5:20, 0] = p[5:20, 1] = 0.9
    p[22:28, 2] = 0.5
    p[2:4, 3] = 0.4
    days = np.repeat(np.arange(30), 4)
    bow = np.stack([(days >= 5) & (days < 20), (days >= 5) & (days < 20) & (np.arange(120) % 2 == 0), days >= 22, days == 3], 1)
    assert binomial.series_events(p, bow, days) == [((5, 19), [0, 1])]
    assert binomial.fast_events(p, bow, days)[0][1] == [0, 1]
    assert sorted(binomial.greedy_events(p, bow)[0])[:2] == [0, 1]


def test_first_real_event_wins(spark):
    events = spark.createDataFrame([(0, ["a", "b"]), (1, ["z"])], "event_id int, keywords array<string>")
    where = spark.createDataFrame([(0, 1, 5), (0, 9, 9), (1, 0, 9)], "event_id int, start int, end int")
    real = spark.createDataFrame([(4, 9, ["b"]), (2, 3, ["a", "q"]), (1, 7, ["a"])], "real_id int, day int, words array<string>")
    found = evaluate.match_events(events, where, real)
    assert {tuple(r) for r in found.collect()} == {(0, 2), (1, -1)}
    s = evaluate.scores(found, 4).first()
    assert (s.precision, s.recall, round(s.f1, 4)) == (0.5, 0.25, 0.3333)
    assert evaluate.scores(found, 4, none_counts=True).first().recall == 0.5
    groups = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "group_id int, event_id int")
    flags = spark.createDataFrame([(0, True), (1, False)], "event_id int, noisy boolean")
    r = evaluate.report("m", 0.1, found, groups, flags, 4).first()
    assert r.redundancy == pytest.approx(1 / 3) and r.noisiness == 0.5


def test_summary(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    lemmas = [[str(x) for x in r.choice(words, 8)] for _ in range(8)]
    costs = np.array([len(x) for x in lemmas], dtype=float)
    for mode in ("coded", "paper"):
        chosen = summarize.summarize_burst(lemmas, lemmas, costs, {"w1", "w2", "w3"}, {}, summarize.Settings(budget=20, diversity=mode))
        assert chosen == sorted(set(chosen)) and 0 < costs[chosen].sum() <= 20
    assert summarize.summarize_burst(lemmas, lemmas, costs, {"none"}, {}, summarize.Settings()) == [0]
    assert summarize.summarize_burst([], [], np.zeros(0), {"x"}, {}, summarize.Settings()) == []
    with pytest.raises(ValueError):
        summarize.Settings(unit="letters")
    rows = [("N", ["NN", "VB", "A", "A", "A", "A"]), ("five", ["NN", "VB", "A", "A", "A"]), ("no verb", ["NN"] * 7)]
    assert [x.id for x in summarize.valid_sentences(spark.createDataFrame(rows, "id string, pos array<string>")).collect()] == ["N"]
