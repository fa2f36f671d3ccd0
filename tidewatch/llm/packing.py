"""Operator 10: best-fit packing by a grouping genetic algorithm.

A corpus has any number of pieces but at most `capacity` lengths, so a packing is kept as patterns: how many bins hold the
same lengths. That makes the instance, every chromosome and each elite bounded (some thousand patterns) at any corpus
size; only the counts grow. Islands evolve whole-corpus packings and exchange elites; pieces then find their place by their
rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean_batches, materialize, read_table
from .tokens import crc32, default_paths, token_ids

CAPACITY = 2048
END = 0

#: (lengths in falling order) -> bins that hold them
Packing = dict[tuple[int, ...], int]


def bins(packing: Packing) -> int:
    return sum(packing.values())


def fitness(packing: Packing, capacity: int) -> tuple[int, int]:
    """Fewer bins first, then bins filled unevenly (which leaves room where it can be used); larger is better."""
    return -bins(packing), sum(sum(p) ** 2 * n for p, n in packing.items())


def _put(packing: Packing, pattern: tuple[int, ...], n: int) -> None:
    if n:
        packing[pattern] = packing.get(pattern, 0) + n


def fill(left: Counter, capacity: int, rng: random.Random, packing: Packing) -> None:
    """Open bins for all that is left: the longest piece first, then the longest that fits; where two pieces can fill the
    rest to the last token, those. Each pattern is used as often as its scarcest length allows."""
    lengths = sorted(k for k, n in left.items() if n > 0)
    left = Counter({k: left[k] for k in lengths})
    while lengths:
        use: Counter = Counter()
        room = capacity
        skip = rng.random() < 0.3
        while room:
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= use[lengths[at]]:
                at -= 1
            if at < 0:
                break
            if use and lengths[at] < room:  # an exact pair beats the longest piece and a gap
                low = lengths[0]
                for i in range(at, max(-1, at - 24), -1):
                    a, b = lengths[i], room - lengths[i]
                    if b < low:
                        continue
                    if a >= b and left.get(b, 0) > use[b] + (a == b) and left[a] > use[a]:
                        use[a] += 1
                        use[b] += 1
                        room = 0
                        break
                if not room:
                    break
            if skip and use and at > 0 and rng.random() < 0.15:
                at -= 1
                if left[lengths[at]] <= use[lengths[at]]:
                    continue
            use[lengths[at]] += 1
            room -= lengths[at]
        n = min(left[k] // c for k, c in use.items())
        _put(packing, tuple(sorted(use.elements(), reverse=True)), n)
        for k, c in use.items():
            left[k] -= c * n
            if not left[k]:
                del left[k], lengths[bisect.bisect_left(lengths, k)]


class _Open:
    """The open bins of a packing by the room they have left."""

    def __init__(self, packing: Packing, capacity: int) -> None:
        self.packing, self.capacity = packing, capacity
        self.rooms: dict[int, list[tuple[int, ...]]] = {}
        for p in packing:
            self.rooms.setdefault(capacity - sum(p), []).append(p)
        self.free = sorted(self.rooms)

    def add(self, p: tuple[int, ...], n: int) -> None:
        if p not in self.packing:
            room = self.capacity - sum(p)
            if room not in self.rooms:
                bisect.insort(self.free, room)
            self.rooms.setdefault(room, []).append(p)
        _put(self.packing, p, n)

    def put(self, k: int, most: int) -> int:
        """Put up to `most` pieces of length k, one each, into bins that they fill best; 0 if none has room."""
        at = bisect.bisect_left(self.free, k)
        if at == len(self.free):
            return 0
        room = self.free[at]
        p = self.rooms[room][-1]
        n = min(most, self.packing[p])
        self.packing[p] -= n
        if not self.packing[p]:
            del self.packing[p]
            self.rooms[room].pop()
            if not self.rooms[room]:
                del self.rooms[room], self.free[at]
        self.add(tuple(sorted((*p, k), reverse=True)), n)
        return n


def plain_best_fit(counts: Counter, capacity: int, rng: random.Random, noise: float = 0.0) -> Packing:
    """Each length in turn, the longest first but for the noise, into the bins that it fills best, new ones where none has
    room. With noise these are the varied, weaker packings that a population starts from."""
    packing: Packing = {}
    bins_ = _Open(packing, capacity)
    for k in sorted(counts, key=lambda k: -k * (1 + noise * rng.random())):
        left = counts[k]
        while left > 0:
            n = bins_.put(k, left)
            if not n:
                each = min(capacity // k, left)
                n = left // each
                bins_.add((k,) * each, n)
                n *= each
            left -= n
    return packing


def best_fit(left: Counter, capacity: int, rng: random.Random, packing: Packing) -> None:
    """Put displaced pieces, longest first, into the open bin that they fill best; bins are opened for the rest."""
    bins_ = _Open(packing, capacity)
    for k in sorted(left, reverse=True):
        while left[k] > 0 and (n := bins_.put(k, left[k])):
            left[k] -= n
    fill(left, capacity, rng, packing)


def cross(a: Packing, b: Packing, counts: Counter, capacity: int, rng: random.Random) -> Packing:
    """Inject whole well-filled bins of b, dissolve the bins of a that hold a piece twice over, best-fit the displaced."""
    share = rng.uniform(0.2, 0.6)
    full = sorted(b, key=sum, reverse=True)
    child: Packing = {}
    left = Counter(counts)

    def take(pattern: tuple[int, ...], most: int) -> None:
        use = Counter(pattern)
        n = min(most, *(left[k] // c for k, c in use.items()))
        if n > 0:
            _put(child, pattern, n)
            for k, c in use.items():
                left[k] -= c * n

    for p in full[: max(1, int(0.8 * len(full)))]:
        if rng.random() < share:
            take(p, b[p])
    for p in sorted(a, key=sum, reverse=True):
        take(p, a[p])
    best_fit(left, capacity, rng, child)
    return child


def mutate(a: Packing, counts: Counter, capacity: int, rng: random.Random) -> Packing:
    """Dissolve the worst-filled bins and some others."""
    child, left = {}, Counter()
    worst = sorted(a, key=sum)[: max(1, len(a) // 20)]
    for p, n in a.items():
        if p in worst or rng.random() < 0.05:
            for k in p:
                left[k] += n
        else:
            child[p] = n
    best_fit(left, capacity, rng, child)
    return child


@dataclass
class Island:
    """What one island found: its best packing, and how it came to it."""

    best: Packing
    started: int
    generations: int
    crossovers_won: int


def evolve(counts: Counter, capacity: int, elites: list[Packing], seed: int, size: int, rounds: int) -> Island:
    """One island: a population of the elites it was sent and of varied best-fit packings. A generation crosses two parents,
    at times mutates the child, and drops the worst; it ends at the bound on bins or after `rounds`."""
    rng = random.Random(seed)
    total = sum(k * n for k, n in counts.items())
    bound = max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    people = list(elites)
    while len(people) < size:
        people.append(plain_best_fit(counts, capacity, rng, rng.uniform(0.2, 2.0)))
    rank = lambda p: fitness(p, capacity)
    people.sort(key=rank, reverse=True)
    started, generation, won = bins(people[0]), 0, 0
    while generation < rounds and bins(people[0]) > bound:
        generation += 1
        a, b = people[0], rng.choice(people[1:] or people)
        a, b = (a, b) if rng.random() < 0.7 else (b, a)
        child = cross(a, b, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, capacity, rng)
        won += rank(child) > rank(people[0])
        people = sorted([*people, child], key=rank, reverse=True)[:size]
    return Island(people[0], started, generation, won)


def plan_packing(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 4, epochs: int = 4, size: int = 6, rounds: int = 16, seed: int = 7, log: list | None = None) -> Packing:
    """Evolve on islands (a task each); after every epoch each island's best migrates to all others. counts and elites are
    bounded by the capacity, not by the corpus. log takes (epoch, island, Island) of each."""
    elites: list[Packing] = []
    total = sum(k * n for k, n in counts.items())
    bound = max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    rank = lambda p: fitness(p, capacity)
    for epoch in range(epochs):
        payload = (Counter(counts), capacity, elites[-islands:], size, rounds)

        def island(batches: Iterator[pd.DataFrame], epoch: int = epoch, payload: tuple = payload) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [evolve(*payload[:3], seed + 1000 * epoch + int(i), *payload[3:]) for i in pdf["id"]]
                yield pd.DataFrame({"id": pdf["id"], "found": [pickle.dumps(x) for x in found]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(island, "id long, found binary").collect()
        found = {r.id: pickle.loads(r.found) for r in sorted(rows, key=lambda r: r.id)}
        if log is not None:
            log += [(epoch, i, x) for i, x in found.items()]
        elites = sorted([*elites, *(x.best for x in found.values())], key=rank)
        if bins(elites[-1]) <= bound:
            break
    return elites[-1]


def slots(packing: Packing) -> tuple[np.ndarray, ...]:
    """(key, first rank, first bin, offset): the pieces of a length with ranks from `first rank` on lie at `offset` of bins
    from `first bin` on, one each. key is length << 40 | first rank, rising."""
    length, rank, first, offset = [], [], [], []
    used: Counter = Counter()
    at = 0
    for p, n in sorted(packing.items(), reverse=True):
        place = 0
        for k in p:
            length.append(k)
            rank.append(used[k])
            first.append(at)
            offset.append(place)
            used[k] += n
            place += k
        at += n
    cols = [np.array(x, dtype=np.int64) for x in (length, rank, first, offset)]
    key = (cols[0] << 40) | cols[1]
    order = np.argsort(key)
    return tuple(x[order] for x in (key, *cols[1:]))


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and an end token; longer ones are cut into pieces
    of `capacity` tokens, of which the first may be shorter."""
    paths = paths or default_paths()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in enumerate(pdf["text"]):
                ids = np.append(token_ids(text, paths), np.uint32(END)).astype("<u4")
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                rows += [(i, k, a, b - a, crc32(ids[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            out = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy()[out.pop("row").to_numpy()] if pdf["doc_id"].notna().all() else pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).to_numpy()[out.pop("row").to_numpy()])
            yield out

    return lean_batches(docs).select("doc_id", "text").mapInPandas(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, **evolution: int) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece.

    A null or empty text is the end token alone; repeated rows are packed each; a null doc_id stays null; other columns are
    ignored. Pieces of one length are interchangeable, so ties need no rule.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, capacity, paths), "pieces")
    parts = 64 + pieces.count() // 50_000  # each ranks its pieces of a length by itself
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    per_part = materialize(pieces.groupBy("length", "part").count(), "piece-counts")
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    places = slots(plan_packing(spark, counts, capacity, **evolution)) if counts else tuple(np.zeros(1, np.int64) for _ in range(4))
    before = per_part.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = pieces.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{c} {t}" for c, t in pieces.select(names).dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rank, first, offset = places
        for pdf in batches:
            at = np.searchsorted(key, (pdf["length"].to_numpy() << 40) | pdf["rank"].to_numpy(), "right") - 1
            yield pdf[names].assign(sequence_id=first[at] + pdf["rank"].to_numpy() - rank[at], offset=offset[at])

    return ranked.select(*names, "rank").mapInPandas(place, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
