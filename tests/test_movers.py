"""Word Mover's retrieval: many pairs at once against one by one."""

import numpy as np
import pytest

from tidewatch.functions import kernels
from tidewatch.operators import retrieve


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 40])
@pytest.mark.parametrize("m", [1, 2, 4, 6])
def test_many_movers(n, m):
    r = np.random.default_rng(n * 10 + m)
    x, y = r.normal(size=(n, 8)), r.normal(size=(9, m, 8))
    y[0, 0], y[1, -1] = x[0], y[1, 0]
    cost = np.sqrt(((x[None, :, None] - y[:, None]) ** 2).sum(3))
    np.testing.assert_allclose(kernels.many_movers(cost), [kernels.word_movers(x, v) for v in y], rtol=0, atol=1e-10)
    low, relaxed = kernels.movers_bounds(x, y.reshape(-1, 8), np.arange(9) * m), np.array([kernels.relaxed_movers(x, v) for v in y])
    assert (low <= relaxed + 1e-15).all() and np.allclose(low, relaxed, atol=1e-5)


@pytest.mark.parametrize("k", [None, 4])
def test_top_k_against_brute_force(spark, k):
    r = np.random.default_rng(6)
    vec = {f"w{i}": r.normal(size=5).tolist() for i in range(30)}
    names = {d: " ".join(f"w{i}" for i in r.choice(34, 1 + d % 6, replace=False)) for d in range(60)}  # w30 to w33 are unknown
    names[7] = names[8] = "none at all"
    keys = {0: ["w1", "w2", "w3"], 1: ["w4", "w33"], 2: ["w32"]}
    found = [(e, b, d) for e in keys for b in range(2) for d in range(60) if (d + e + b) % 3]
    got = retrieve.wmd_top_k(
        spark.createDataFrame(found, "event_id int, burst_id int, doc_id long"), spark.createDataFrame(list(names.items()), "doc_id long, name string"),
        spark.createDataFrame([(e, w) for e, x in keys.items() for w in x], "event_id int, word string"), spark.createDataFrame(list(vec.items()), "word string, vec array<double>"), k)
    want = []
    for e in keys:
        for b in range(2):
            sims = []
            for d in (d for x, y, d in found if (x, y) == (e, b)):
                h, q = ([vec[w] for w in x if w in vec] for x in (names[d].split(), keys[e]))
                sims.append((-1 / (1 + kernels.word_movers(np.array(h), np.array(q))) if h and q else 0.0, d))
            want += [(e, b, d, n + 1) for n, (_, d) in enumerate(sorted((round(s, 12), d) for s, d in sims)[: k or round(len(sims) ** 0.5)])]
    rows = got.collect()
    assert {(x.event_id, x.burst_id, x.doc_id, x["rank"]) for x in rows} == set(want) and len(rows) == len(want)
