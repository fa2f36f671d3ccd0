import random

import pytest

CLASH = ["size", "key", "fp", "group", "src", "start", "spans", "_q", "bin", "k", "reps", "host"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with the operators' own names."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "be", "gämma", "delta,", "x" * 30]) for _ in range(60_000))
    rows = [
        (1, "the one text of many words that says little " * 3, "en", "a", 10), (1, "the one text of many words that says little " * 3, "en", "a", 10),
        (2, None, None, None, None), (3, "", "de", "b", 0), (None, "a null id with some words", "en", None, 25), (None, None, "en", "b", None),
        (4, "  \t\n ", "en", "a", 5), (5, long, "en", "b", len(long)), (6, long, None, "b", len(long)), (7, "one", "en", "a", 3), (8, "one", "fr", "a", 3),
        (9, "line\nline\nline\n\nother line", "en", "b", 27), (9, "another text with the same id", "en", "b", 29),
    ]
    rows += [(20 + i, " ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.randint(40, 90))), "en", "ab"[i % 2], 1) for i in range(40)]
    return spark.createDataFrame([(*x, *range(len(CLASH))) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)).repartition(3)
