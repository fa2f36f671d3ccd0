"""The whole event pipeline on a collection with planted events."""

import random

import pytest

from tidewatch.plans.pipeline import EventPipeline
from tidewatch.streaming import daily

DAYS = 42
PLANTED = ["storm", "flood", "rescue", "river", "bridge", "levee", "evacuate", "sandbag"]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(4)
    common = [f"common{i}" for i in range(60)]
    rows = []
    for day in range(DAYS):
        for _ in range(12):
            lines = [" ".join(r.choice(common) for _ in range(9)) for _ in range(4)]
            if 18 <= day <= 24 and r.random() < 0.7:
                said = [w for w in PLANTED if r.random() < 0.8]  # equal words would cost nothing and end an event
                lines = [" ".join([line, *said]) for line in lines]
            rows.append((len(rows), day, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id long, day int, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(1)
    rows = [(w, [1.0, 0.1 * i, 0.0]) for i, w in enumerate(PLANTED)]
    rows += [(f"common{i}", [5 + 3 * r.random(), 9 * r.random(), 9 * r.random()]) for i in range(60)]
    return spark.createDataFrame(rows, "word string, vec array<double>").cache()


@pytest.mark.parametrize("method", ["cluster-based", "original"])
def test_planted_event(planted, vectors, method):
    got = EventPipeline(method, bound=0.5, min_df=20, eps=0.3).run(planted, DAYS, vectors)
    words = {}
    for r in got.events.collect():
        words.setdefault(r.event_id, set()).add(r.word)
    hits = [e for e, w in words.items() if set(PLANTED) <= w or method != "cluster-based" and len(w & set(PLANTED)) >= 2]
    assert hits
    spans = [(r.start, r.end) for r in got.bursts.collect() if r.event_id in hits]
    assert any(a <= 24 and b >= 18 for a, b in spans)
    found = [r.doc_id for r in got.found.collect() if r.event_id in hits]
    assert found and sum(200 < d < 310 for d in found) > len(found) / 2
    assert got.summary.count() > 0


def test_greedy_may_find_none(planted, vectors):
    got = EventPipeline("embedded-greedy", bound=0.5, min_df=20).run(planted, DAYS, vectors)
    assert got.words.count() == len(PLANTED) and got.summary.count() >= 0 and got.events.groupBy("event_id").count().where("count < 3").isEmpty()


def test_unknown_method():
    with pytest.raises(ValueError):
        EventPipeline("other")


def test_daily_stream(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:00:00", "ab"[h % 2]) for d in (1, 2, 9) for h in range(4)]
    spark.createDataFrame(rows, "ts string, kind string").selectExpr("cast(ts as timestamp) ts", "kind").write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
    daily.follow(stream, "ts", "kind", lambda df, _: seen.extend(map(tuple, df.collect())), f"{tmp_path}/check").awaitTermination(60)
    assert sorted((str(d), k, n) for d, k, n in seen) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 2), ("2024-01-02", "a", 2), ("2024-01-02", "b", 2)]
