"""Operator 4: base matches against plain patterns, Viterbi against enumeration, held-out accuracy of the field."""

import itertools
import random
import re

import numpy as np

from tidewatch.llm import pii


def plain(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_base(spark):
    r = random.Random(1)
    parts = ["a", "b.c", "@", "@@", ".", "1", "255", "256", "1.2.3.4", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (243) 555-5526", "+", "-", " ", "é", "x@y.z", "\n", "(", ")", "001.002.0003.4", "00000000001.1.1.1"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_base_is_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 300_000, "+1" + " " * 500_000, "a@" * 300_000):
        pii.base_spans(text)


def test_viterbi():
    r = np.random.default_rng(2)
    emit, pair = r.normal(size=(50, pii.LABELS)).astype(np.float32), r.normal(size=(pii.LABELS, pii.LABELS)).astype(np.float32)
    seqs = [r.integers(0, 50, (n, 3)) for n in (0, 1, 2, 3, 4, 3, 1)]
    for seq, got in zip(seqs, pii.viterbi(seqs, emit, pair)):
        if len(seq):
            score = lambda ls: sum(emit[seq[i]].sum(0)[x] for i, x in enumerate(ls)) + sum(pair[a, b] for a, b in zip(ls, ls[1:])) - 1e6 * (ls[0] % 2 == 0 and ls[0] > 0)  # noqa: B023, E731
            best = max(itertools.product(range(pii.LABELS), repeat=len(seq)), key=score)
            assert abs(score(best) - score(tuple(got))) < 1e-3


def test_held_out_accuracy():
    emit, pair = pii.train()
    table = pii.labelled_table(300, seed=99)
    right = total = clean = false = 0
    for (words, labels), got in zip(table, pii.viterbi([pii.features(w) for w, _ in table], emit, pair)):
        total += sum(x > 0 for x in labels)
        right += sum(x > 0 and x == y for x, y in zip(labels, got))
        clean += sum(x == 0 for x in labels)
        false += sum(x == 0 and y > 0 for x, y in zip(labels, got))
    assert right / total > 0.93 and false / clean < 0.01


def test_documents(spark, odd_docs):
    got = pii.find_pii(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.spans == "" for r in got if r.doc_id in (2, 3, 7))
    text = "Écrire à x.1@mail2.example.com ou jo [at] site [dot] org, (243) 555-5526; 4111111111111111 et 9807915762804491. token = \"ab12\" 2024"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 1, 0)
    base, spans = set(r.base.split(",")), r.spans.split(",")
    assert base == {"email:9:30", f"card:{text.index('4111')}:{text.index('4111') + 16}"} and base <= set(spans) and r.n_added == len(spans) - 2 >= 2
    assert all(text[int(a) : int(b)].strip() for _, a, b in (s.split(":") for s in spans))


def test_windows_cover_every_trigger():
    r = random.Random(3)
    for _ in range(500):
        words = [r.choice(["a", "b1", "cc", "x@y", "(at)", "zz"]) for _ in range(r.randint(0, 25))]
        text = r.choice(["", " "]) + r.choice([" ", "\n", "  "]).join(words)
        runs = pii._windows(text)
        flat = [w for run in runs for w in run]
        assert flat == sorted(set(flat)) and all(text[a:b].strip() == text[a:b] != "" for a, b in flat)
        bounds = [m.span() for m in re.finditer(r"\S+", text)]
        want = {bounds[j] for i, (a, b) in enumerate(bounds) if re.search(r"[0-9@]|\(at\)", text[a:b]) for j in range(max(0, i - 3), min(len(bounds), i + 4))}
        assert set(flat) == want


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
