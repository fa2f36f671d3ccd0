"""Topic models: what the driver gets, and what is read again."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tidewatch.operators import topics


@pytest.fixture
def weighted(spark):
    x = np.random.default_rng(0).random((30, 20))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, v array<double>")
    return x, rows.select("doc_id", array_to_vector("v").alias("tfidf"))


def test_nmf_sums_by_blocks(weighted, monkeypatch):
    monkeypatch.setattr(topics, "WIDE", 7)
    x, own = weighted
    h = np.random.default_rng(1).random((3, 20)) + 0.1
    for _ in range(2):
        w = np.full((30, 3), 1 / 3)
        for _ in range(10):
            w *= (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        h = h * (w.T @ x) / np.maximum((w.T @ w) @ h, 1e-12)
    mix, got = topics.nmf(own, k=3, rounds=2)
    np.testing.assert_allclose(got, h, rtol=1e-9)
    assert mix.count() == 30


def test_lsi_rows_are_written_once(weighted, monkeypatch):
    written = []
    monkeypatch.setattr(topics, "materialize", lambda df, name, own=topics.materialize: written.append(name) or own(df, name))
    x, own = weighted
    got = np.array([r.vec for r in topics.lsi_vectors(own, 3).orderBy("doc_id").collect()])
    want = x @ np.linalg.svd(x)[2][:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert written == ["lsi"]


def test_word_vectors_in_parts(spark, monkeypatch):
    """Trained by as many tasks as the documents give, not by one; every word of every part has a vector."""
    monkeypatch.setattr(topics, "DOCS_A_PART", 10, raising=False)
    rows = spark.createDataFrame([(i, [f"w{i % 7}", f"w{(i + 1) % 7}", "all"] * 4) for i in range(35)], "doc_id long, tokens array<string>")
    vecs, model = topics.word_vectors(rows, size=4, rounds=1)
    assert model.getNumPartitions() == 4
    assert {r.word for r in vecs.collect()} == {"all", *(f"w{i}" for i in range(7))}
    assert topics.document_vectors(rows, model).count() == 35
