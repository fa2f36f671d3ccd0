"""Operators 7 and 8 against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tidewatch.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, key string, n long"


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(r.randint(0, 90))] for _ in range(25)]
    docs = []
    for i, words in enumerate(base):
        w = list(words)
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 5) : r.randint(20, 30)]
        if i % 5 == 0:
            w += ["xy"] * r.randint(0, 40)
        docs.append(w)
    for i in range(12):  # near copies
        w = list(docs[3])
        if w:
            w[r.randrange(len(w))] = word()
        docs.append(w)
    docs += [list(docs[1])] * 3
    seps = [" ", "  ", "\n", "\t "]
    rows = [(i, "".join(w + r.choice(seps) for w in x), "en", "k", 1) for i, x in enumerate(docs)]
    rows += [(100, None, None, None, None), (101, "", None, "", 0), (None, rows[4][1], "en", "k", 1), (5, rows[5][1], "en", "k", 1), (102, "\x1c\x85 a", "x", "y", 2)]
    return rows


def brute(seqs, window):
    count = Counter(s[i : i + window] for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[s[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window,k,hot,seed", [(8, 3, 20000, 0), (8, 3, 2, 1), (5, 5, 3, 2), (12, 2, 20000, 3)])
def test_words(spark, window, k, hot, seed):
    rows = corpus(seed)
    seqs = [tuple((x[1] or "").encode().split()) for x in rows]
    want = sorted(str((x[0], len(s), sum(g), b" ".join(w for w, y in zip(s, g) if not y).decode())) for x, s, g in zip(rows, seqs, brute(seqs, window)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window, k, hot).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got) == want
    assert sum(r.n_removed for r in got) > 100


@pytest.mark.parametrize("window,k,hot,seed", [(20, 6, 20000, 0), (20, 6, 2, 1), (33, 5, 3, 2)])
def test_bytes(spark, window, k, hot, seed):
    rows = corpus(seed)
    seqs = [(x[1] or "").encode() for x in rows]
    want = []
    for x, s, g in zip(rows, seqs, brute(seqs, window)):
        n_spans = sum(y and not (i and g[i - 1]) for i, y in enumerate(g))
        want.append(str((x[0], len(s), sum(g), n_spans, bytes(b for b, y in zip(s, g) if not y))))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window, k, hot).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == sorted(want)


def test_long_text_by_pieces(spark, monkeypatch):
    from tidewatch.llm import repeats

    unit = repeats.Unit("words", 8, 3)
    r = random.Random(5)
    text = " ".join(r.choice("ab") for _ in range(700)).encode()
    symbols, offsets = unit.symbols([text])
    import numpy as np
    import pandas as pd

    frame = pd.DataFrame({"_text": [text.decode()], "_k1": [1], "_k2": [2]})
    whole = pd.concat(repeats._anchor_rows(unit)([frame]))
    monkeypatch.setattr(repeats, "_PIECE", 100)
    parts = pd.concat(repeats._anchor_rows(unit)([frame]))
    assert whole.reset_index(drop=True).equals(parts.reset_index(drop=True))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def digest(seqs, window):
    """brute() by Python's own hash of each window, for whole tables."""
    count = Counter(hash(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = bytearray(len(s))
        for i in range(len(s) - window + 1):
            if count[hash(s[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out.append(gone)
    return out


def test_registered_queries(spark):
    """The contract's own sizes, 35 words and 400 bytes, over a whole table."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = [tuple(t.split()) for _, t in rows]
    want = [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(rows, words, digest(words, 35))]
    assert sorted(map(tuple, substring_dedup.op7_substring_dedup(spark, sf).collect())) == sorted(want)
    want = []
    for (i, t), g in zip(rows, digest([t for _, t in rows], 400)):
        n_spans = sum(y and not (j and g[j - 1]) for j, y in enumerate(g))
        want.append((i, len(t), sum(g), n_spans, hashlib.sha256(bytes(b for b, y in zip(t, g) if not y)).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.op8_suffix_dedup(spark, sf).collect())) == sorted(want)


def test_null_and_clashing_ids(spark):
    """Rows that agree in their ids, and in a 32-bit hash of their texts, stay apart."""
    from pyspark.sql import functions as F

    n = 400_000
    made = spark.range(n).select(F.concat_ws(" ", F.array_repeat(F.sha1(F.col("id").cast("string")), 1), F.lit("x")).alias("text")).withColumn("h", F.hash("text"))
    pair = made.groupBy("h").agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first().t[:2]
    assert pair[0] != pair[1]
    once = "only here " + " ".join(f"w{i}" for i in range(60))
    twice = "here twice " + " ".join(f"v{i}" for i in range(60))
    rows = [(None, t, None, None, None) for t in (*pair, once, twice, twice)] + [(-(2**62), once[5:] + " y", None, None, None), (7, pair[0], None, None, None), (7, pair[1], None, None, None)]
    want = brute([tuple(r[1].split()) for r in rows], 10)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), 10, 3).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == sorted((str(r[0]), len(r[1].split()), sum(g)) for r, g in zip(rows, want))


def test_odd_rows(spark, odd_docs):
    """Very long texts, nulls, repeats and extra columns with the operators' own names."""
    docs = odd_docs
    for c in ("passage", "reps", "cls", "pos", "_text", "_k1", "_k2", "key", "bucket"):
        docs = docs.withColumn(c, docs["n_chars"])
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    words = [tuple(t.split()) for _, t in rows]
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got) == sorted((str(i), len(w), sum(g)) for (i, _), w, g in zip(rows, words, digest(words, 35)))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == sorted((str(i), len(t), sum(g)) for (i, t), g in zip(rows, digest([t for _, t in rows], 400)))
