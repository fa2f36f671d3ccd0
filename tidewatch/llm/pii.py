"""Operator 4: personal data, by fixed patterns and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, read_table

KINDS = ["email", "ip", "card", "phone"]

# The base patterns. Look-behinds only spare tries that cannot succeed.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_NON_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every base match, by kind and start; linear in the text's length."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := _NON_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the random field ---------------------------------------------------------------------------------------------------

#: 0 outside; 2k+1 begins and 2k+2 continues a span of kind k.
LABELS = 1 + 2 * len(KINDS)
FEATURES = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that can be part of a span: those with a digit, an @, or that stand for @ or a dot. Elsewhere nothing is decoded.
_TRIGGER = re.compile(r"[^\x20\x09-\x0D]*(?:[0-9@]|[\[(](?:at|dot)[\])])[^\x20\x09-\x0D]*", re.I)
REACH = 3


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word[:40]:
        s = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if c.isascii() else "?"
        if not out or out[-1] != s or s not in "xX":
            out.append(s)
    return "".join(out)


@functools.lru_cache(maxsize=200_000)
def _code(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "replace"), digest_size=8).digest(), "little") % FEATURES


def _word_features(word: str) -> list[str]:
    shape = _shape(word)
    digits = sum(c.isdigit() for c in word)
    short = shape.replace("9", "9")
    while "99" in short:
        short = short.replace("99", "9")
    out = [f"s={shape[:24]}", f"c={short[:24]}", f"n={min(digits, 20)}", f"l={min(len(word), 24)}", f"e={shape[-1:]}", f"b={shape[:1]}"]
    low = word.lower()
    if low.strip("[](),.") in ("at", "dot") and low[:1] in "[(":
        out.append("w=" + low.strip("[](),."))
    if "@" in word:
        out.append("at")
    return out


def features(words: list[str]) -> np.ndarray:
    """A row of feature codes for each word: its own, its neighbours' shapes and the bias (padded with the bias)."""
    own = [_word_features(w) for w in words]
    wide = 16
    out = np.full((len(words), wide), _code("bias"), dtype=np.int32)
    for i, f in enumerate(own):
        before = own[i - 1][1] if i else "^"
        after = own[i + 1][1] if i + 1 < len(own) else "$"
        codes = [_code(x) for x in [*f, "p" + before, "q" + after, "p" + before + f[1], "q" + after + f[1]]]
        out[i, : len(codes)] = codes[:wide]
    return out


def labelled_table(n: int = 600, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """The labelled table: n short word sequences with a label for each word, drawn from templates of written-out personal
    data and of look-alikes (years, versions, prices, keys, counts) that are none. n bounds it at any corpus size."""
    r = random.Random(seed)
    low = "abcdefghijklmnopqrstuvwxyzéñäç"
    word = lambda a=1, b=9: "".join(r.choice(low) for _ in range(r.randint(a, b)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    end = lambda: r.choice(["", "", "", "", ".", ",", ";", "!!", "***", "###", "%%%", "$$$", "&&&"])
    plain = lambda: [r.choice([word(), word().capitalize(), word() + r.choice(",.!")]) for _ in range(r.randint(1, 5))]
    spans = {
        0: [lambda: [word(), "[at]", word(), "[dot]", r.choice(["com", "org", "net"]) + end()], lambda: [word(), "(at)", word(), "(dot)", r.choice(["com", "org", "net"]) + end()], lambda: [f"{word()}.{num(2)}@mail{num(1)}.example.com" + end()], lambda: [f"{word()}[at]{word()}[dot]com" + end()]],
        1: [lambda: [f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}" + end()], lambda: [f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}:{num(4)}" + end()], lambda: [":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)) + end()]],
        2: [lambda: [num(16) + end()], lambda: [num(4), num(4), num(4), num(4) + end()], lambda: ["-".join(num(4) for _ in range(4)) + end()]],
        3: [lambda: ["+" + num(1), f"({num(3)})", f"{num(3)}-{num(4)}" + end()], lambda: [f"({num(3)})", f"{num(3)}-{num(4)}" + end()], lambda: [f"{num(3)}-{num(3)}-{num(4)}" + end()], lambda: ["+" + num(2), num(3), num(3), num(4) + end()]],
    }
    none = [lambda: [str(r.randint(1900, 2099)) + end()], lambda: [f"{num(1)}.{num(1)}.{num(1)}" + end()], lambda: [f"${num(2)}.{num(2)}" + end()], lambda: ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'], lambda: [num(r.randint(1, 6)) + end()], lambda: [f"{num(4)}-{num(2)}-{num(2)}" + end()], lambda: [f"{num(2)}:{num(2)}" + end()], lambda: [word() + num(2) + end()], lambda: ["|", num(3), "|", num(2), "|"], lambda: [f"({num(2)})"], lambda: [f"{num(1)},{num(3)},{num(3)}"], lambda: ["@" + word()], lambda: [num(r.randint(8, 12))], lambda: [f"{num(3)}-{num(3)}"], lambda: [num(2) + "%"], lambda: [num(r.randint(20, 30))]]
    rows = []
    for i in range(n):
        words, labels = plain(), []
        labels += [0] * len(words)
        for _ in range(r.randint(1, 3)):
            if i % 2:
                k = r.randrange(len(KINDS))
                own = r.choice(spans[k])()
                labels += [2 * k + 1, *[2 * k + 2] * (len(own) - 1)]
            else:
                own = r.choice(none)()
                labels += [0] * len(own)
            rest = plain()
            words += [*own, *rest]
            labels += [0] * len(rest)
        rows.append((words, labels))
    return rows


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(maxsize=2)
def train(n: int = 600, seed: int = 3, rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights of features x labels, weights of label pairs), by gradient steps on the likelihood of the labelled table."""
    table = labelled_table(n, seed)
    longest = max(len(w) for w, _ in table)
    x = np.full((n, longest, 16), 0, dtype=np.int32)
    y = np.zeros((n, longest), dtype=np.int64)
    size = np.array([len(w) for w, _ in table])
    for i, (words, labels) in enumerate(table):
        x[i, : len(words)], y[i, : len(words)] = features(words), labels
    mask = np.arange(longest) < size[:, None]
    emit, pair = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    m = [np.zeros_like(emit), np.zeros_like(pair)]
    v = [np.zeros_like(emit), np.zeros_like(pair)]
    truth = np.zeros((n, longest, LABELS))
    np.put_along_axis(truth, y[..., None], 1.0, 2)
    truth *= mask[..., None]
    pairs = np.zeros((LABELS, LABELS))
    both = mask[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    for step in range(1, rounds + 1):
        score = emit[x].sum(2)
        ahead, back = np.zeros((longest, n, LABELS)), np.zeros((longest, n, LABELS))
        ahead[0] = score[:, 0]
        for t in range(1, longest):
            new = _log_sum(ahead[t - 1][:, :, None] + pair, 1) + score[:, t]
            ahead[t] = np.where(mask[:, t, None], new, ahead[t - 1])
        total = _log_sum(ahead[-1], 1)
        expected = np.zeros((LABELS, LABELS))
        for t in range(longest - 2, -1, -1):
            inner = score[:, t + 1] + back[t + 1]
            back[t] = np.where(mask[:, t + 1, None], _log_sum(pair[None] + inner[:, None, :], 2), back[t + 1])
            p = np.exp(ahead[t][:, :, None] + pair + inner[:, None, :] - total[:, None, None])
            expected += p[mask[:, t + 1]].sum(0)
        own = np.exp(ahead.transpose(1, 0, 2) + back.transpose(1, 0, 2) - total[:, None, None]) * mask[..., None]
        grad = np.zeros_like(emit)
        np.add.at(grad, x[mask], (truth - own)[mask][:, None, :].repeat(16, 1))
        for g, w, a, b in ((grad / n - decay * emit, emit, m[0], v[0]), ((pairs - expected) / n - decay * pair, pair, m[1], v[1])):
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.99 * b + 0.01 * g * g
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    for k in range(len(KINDS)):  # a span is never continued that did not begin
        inside = 2 * k + 2
        pair[[i for i in range(LABELS) if i not in (inside, inside - 1)], inside] = -1e6
    return emit.astype(np.float32), pair.astype(np.float32)


def viterbi(sequences: list[np.ndarray], emit: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """The likeliest labels of each sequence, in batches of about equal lengths."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    start = np.zeros(LABELS, np.float32)
    start[2::2] = -1e6
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    for lo in range(0, len(order), 512):
        own = order[lo : lo + 512]
        longest = len(sequences[own[-1]])
        if not longest:
            continue
        score = np.zeros((len(own), longest, LABELS), np.float32)
        size = np.array([len(sequences[i]) for i in own])
        for r, i in enumerate(own):
            score[r, : size[r]] = emit[sequences[i]].sum(1)
        best = start + score[:, 0]
        back = np.zeros((longest, len(own), LABELS), np.int8)
        for t in range(1, longest):
            path = best[:, :, None] + pair
            back[t] = path.argmax(1)
            best = np.where((t < size)[:, None], path.max(1) + score[:, t], best)
            back[t][t >= size] = np.arange(LABELS)
        label = best.argmax(1)
        labels = np.zeros((len(own), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            labels[:, t] = label
            label = np.take_along_axis(back[t], label[:, None], 1)[:, 0].astype(np.int64) if t else label
        for r, i in enumerate(own):
            out[i] = labels[r, : size[r]]
    return out


def _windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words within REACH words of one that can be part of a span. A word further off has label 0 by definition."""
    out: list[list[tuple[int, int]]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        if out and a < out[-1][-1][1]:  # already among the words after the last one
            known = {s for s, _ in out[-1]}
            if a in known:
                at = next(i for i, (s, _) in enumerate(out[-1]) if s == a)
                tail = len(out[-1]) - 1 - at
                out[-1] += _after(text, out[-1][-1][1], REACH - tail)
            continue
        left = _before(text, a, REACH)
        run = [*left, (a, b), *_after(text, b, REACH)]
        if out and left and left[0][0] <= out[-1][-1][1]:
            run = [w for w in run if w[0] >= out[-1][-1][1]]
            out[-1] += run
        else:
            out.append(run)
    return out


def _after(text: str, at: int, n: int) -> list[tuple[int, int]]:
    out = []
    while n > 0 and (m := _WORD.search(text, at)):
        out.append(m.span())
        at, n = m.end(), n - 1
    return out


_SPACES = frozenset(" \t\n\x0b\x0c\r")


def _before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    while n > 0:
        while at > 0 and text[at - 1] in _SPACES:
            at -= 1
        end = at
        while at > 0 and text[at - 1] not in _SPACES:
            at -= 1
        if at == end:
            break
        out.append((at, end))
        n -= 1
    return out[::-1]


def field_spans(texts: list[str], emit: np.ndarray, pair: np.ndarray) -> list[list[Span]]:
    """What the random field finds in each text, without outer punctuation."""
    owners, runs = [], []
    for i, text in enumerate(texts):
        if "@" in text or "[" in text or "(" in text or _DIGIT.search(text):
            for run in _windows(text):
                owners.append(i)
                runs.append(run)
    out: list[list[Span]] = [[] for _ in texts]
    for lo in range(0, len(runs), 4096):
        part = runs[lo : lo + 4096]
        decoded = viterbi([features([texts[owners[lo + j]][a:b] for a, b in run]) for j, run in enumerate(part)], emit, pair)
        for j, (run, labels) in enumerate(zip(part, decoded, strict=True)):
            text, at = texts[owners[lo + j]], 0
            while at < len(run):
                label = int(labels[at])
                if label % 2 == 0:
                    at += 1
                    continue
                stop = at + 1
                while stop < len(run) and labels[stop] == label + 1:
                    stop += 1
                a, b = run[at][0], run[stop - 1][1]
                while a < b and text[a] in "\"'<[{,;":
                    a += 1
                while b > a and text[b - 1] in "\"'>}.,;:!?":
                    b -= 1
                if a < b:
                    out[owners[lo + j]].append(((label - 1) // 2, a, b))
                at = stop
    return out


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, table_rows: int = 600) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone (base matches), base, spans (kind:start:end by kind
    and start, comma-joined; base matches and what the field adds beside them), n_added.

    Null and empty texts have no spans; repeated rows are found alike; a null doc_id stays null; other columns are ignored.
    A span of the field that overlaps a base match of any kind is left out, as that one stays.
    """
    weights = train(table_rows)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            base = [base_spans(t) for t in texts]
            rows = []
            for own, more in zip(base, field_spans(texts, *weights), strict=True):
                taken = sorted((a, b) for _, a, b in own)
                added = []
                for k, a, b in more:
                    if not any(x < b and a < y for x, y in taken):
                        added.append((k, a, b))
                rows.append((*(sum(s[0] == k for s in own) for k in range(len(KINDS))), _said(own), _said([*own, *added]), len(added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])
            out.insert(0, "doc_id", pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None))
            yield out

    return lean_batches(docs).select("doc_id", "text").mapInPandas(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
