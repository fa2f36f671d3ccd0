"""Operator 10: valid, gapless and close to the bound; ids as the tokenizer file gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidewatch.llm import packing, tokens


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(tokens.default_paths()[0])
    want = Counter()
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or capacity
        for k, a in enumerate([0, *range(head, len(ids), capacity)]):
            part = ids[a : head if not k else a + capacity]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r.length for r in rows) // capacity)


def test_documents(spark, odd_docs):
    for capacity in (64, 2048):
        n, bound = check(packing.pack(odd_docs, capacity).collect(), odd_docs.select("doc_id", "text").collect(), capacity)
        assert n <= bound + 1 + (capacity == 64) * 5


def test_better_than_first_fit():
    r = random.Random(2)
    counts = Counter(r.choice([r.randint(300, 1100), r.randint(600, 700)]) for _ in range(400))
    best = packing.evolve(counts, 2048, [], 1, 5, 30).best
    used = Counter()
    for p, n in best.items():
        assert sum(p) <= 2048
        for k in p:
            used[k] += n
    assert used == counts
    rooms = []
    for k in sorted(counts.elements(), reverse=True):
        for i, x in enumerate(rooms):
            if x >= k:
                rooms[i] -= k
                break
        else:
            rooms.append(2048 - k)
    assert packing.bins(best) <= len(rooms)


def test_evolution_beats_best_fit(spark):
    """An instance of full triplets, whose bound is reachable but which best fit, longest first, misses by a tenth: generations
    run, crossovers win, elites migrate, and the evolved packing needs far fewer bins."""
    r = random.Random(3)
    counts = Counter()
    for _ in range(150):
        a, b = r.randint(500, 800), r.randint(500, 800)
        counts.update([a, b, 2048 - a - b])
    plain = packing.bins(packing.plain_best_fit(counts, 2048, random.Random(1)))
    log = []
    best = packing.plan_packing(spark, counts, log=log)
    used = Counter()
    for p, n in best.items():
        assert sum(p) <= 2048
        for k in p:
            used[k] += n
    assert used == counts
    assert plain >= 163 and packing.bins(best) <= 153
    assert all(x.generations > 0 for _, _, x in log) and sum(x.crossovers_won for _, _, x in log) > 10
    first = min(packing.bins(x.best) for e, _, x in log if e == 0)
    assert all(x.started <= first for e, _, x in log if e == 1)  # the best of all islands reached each


def test_crossover_keeps_every_piece():
    r = random.Random(4)
    counts = Counter(r.randint(1, 64) for _ in range(300))
    a, b = {}, {}
    packing.fill(Counter(counts), 64, random.Random(1), a)
    packing.fill(Counter(counts), 64, random.Random(2), b)
    for i in range(20):
        a = packing.mutate(packing.cross(a, b, counts, 64, random.Random(i)), counts, 64, random.Random(i))
        used = Counter()
        for p, n in a.items():
            assert sum(p) <= 64 and n > 0
            for k in p:
                used[k] += n
        assert used == counts


def test_tokens_match_the_tokenizer_file():
    r = random.Random(6)
    paths = tokens.default_paths()
    tok = Tokenizer.from_file(paths[0])
    alphabet = "ab c\n\t éß漢字😀1234'.,<|endoftext|>\x00​ "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["<|endoftext|> x", "it's  we'll\r\n\r\n  x", "x" * 5000]
    for t in texts:
        assert tokens.token_ids(t, paths).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_tokens_of_whole_tables(spark):
    """The ranks give the tokenizer file's ids for every text."""
    paths = tokens.default_paths()
    tok = Tokenizer.from_file(paths[0])
    for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert tokens.token_ids(t, paths).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
