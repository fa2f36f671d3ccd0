"""The pipeline, stage by stage, against brute force on planted documents."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from test_jaccard_near import brute_first, ids
from test_packing import check
from test_quality import brute as counts

W = re.compile(r"[^\x20\x09-\x0D]+")
BOILER = "All rights reserved by the site"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(130):
        lines = [" ".join(word() for _ in range(r.randint(8, 15))) for _ in range(r.randint(7, 12))]
        if i % 2:
            lines.insert(r.randint(0, 3), BOILER)
        rows.append((i, "\n".join(lines), "en", ["a", "b", None][i % 3], 1))
    for i in range(12):  # near copies and copies
        words = rows[i][1].split(" ")
        if i % 2:
            words[30] = "changed"
        rows.append((200 + i, " ".join(words), "en", "a", 1))
    rows += [(300 + i, "too short", "en", "a", 1) for i in range(5)] + [(310, "same words again " * 60, "en", "a", 1), (311, None, None, None, None), (None, rows[7][1] + " end", "en", "b", 1), (320, rows[8][1], "en", "b", 1), (320, rows[8][1], "en", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def key(rows):
    return sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in rows)


def test_stages(spark, docs):
    now = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "line", "simhash", "source", "best-fit"]

    df = stages["quality rules"](spark, docs, "")
    bad = lambda t: (c := counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]
    want = [r for r in now if not bad(r.text)]
    now = df.collect()
    assert key(now) == key(want) and len(want) < docs.count()

    df = stages["line dedup"](spark, df, "")
    pages, lines = Counter(r.source for r in now), Counter((r.source, x.strip()) for r in now for x in {y.strip() for y in r.text.split("\n")})
    drop = {k for k, n in lines.items() if n >= 3 and pages[k[0]] >= 20 and n > 0.1 * pages[k[0]] and k[1]}
    want = [r.asDict() | {"text": "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in drop)} for r in now]
    now = df.collect()
    assert key(now) == sorted(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in want)
    assert {k[1] for k in drop} == {BOILER}
    assert all(r.n_chars == len(r.text) for r in now if BOILER not in r.text and r.n_chars != 1)

    df = stages["simhash near-dedup"](spark, df, "")
    before, want = len(now), brute_first(now)  # the stage's rule: five words, similarity 0.8 or more
    now = df.collect()
    assert ids(now) == want and len(now) < before

    df = stages["source mixing"](spark, df, "")
    words = Counter()
    for r in now:
        words[r.source] += len(W.findall(r.text))
    before = {r.doc_id: r for r in now}
    now = df.collect()
    taken, per = Counter(), Counter()
    for r in now:
        taken[r.source] += len(W.findall(r.text))
        per[r.doc_id] += len(W.findall(r.text))
        assert set(W.findall(r.text)) <= set(W.findall(before[r.doc_id].text)) and r.source == before[r.doc_id].source
    assert all(n <= 2 * len(W.findall(before[i].text)) for i, n in per.items())
    total = 1.5 * sum(words.values())
    share = {"a": 3, "b": 1, None: 2}
    goal = {s: min(total * w / 6, 2 * words[s]) for s, w in share.items()}
    rest = total - sum(goal.values())
    open_ = [s for s in share if goal[s] < 2 * words[s]]
    for s in open_:
        goal[s] = min(2 * words[s], goal[s] + rest * share[s] / sum(share[x] for x in open_))
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in goal)

    df.write.mode("overwrite").format("noop").save()
    n, bound = check(stages["best-fit packing"](spark, spark.createDataFrame(now, df.schema), "").collect(), now, 2048)
    assert n <= bound + 1


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= ids
    assert set(corpus_pipeline.COLUMNS) == set(spark.read.parquet(f"{sf}/documents.parquet").columns)
    assert sorted(map(tuple, rows)) != [] and sorted((r.doc_id, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
