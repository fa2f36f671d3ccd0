"""Token expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Words the default cleaner drops; any list can be given instead.
STOPWORDS = ("the", "and", "that", "der", "die", "und", "les", "des", "los", "las", "que", "con")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def keeps(word: Column, stopwords: Sequence[str] = STOPWORDS, shortest: int = 3, longest: int = 15) -> Column:
    """Of an allowed length and no stopword in lower case."""
    fits = F.length(word).between(shortest, longest)
    return fits & ~F.lower(word).isin(*stopwords) if stopwords else fits


def clean(tokens: Column, stopwords: Sequence[str] = STOPWORDS, shortest: int = 3, longest: int = 15) -> Column:
    """The tokens that `keeps` keeps."""
    return F.filter(tokens, lambda w: keeps(w, stopwords, shortest, longest))


def regex_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\w+)"), 1)


def lower_split(text: Column) -> Column:
    return F.split(F.lower(text), r"\W+")


def simple_tokens(text: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-cased runs of letters of an allowed length."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1), lambda w: F.length(w).between(shortest, longest))


def first_piece(word: Column) -> Column:
    """What stands before the first punctuation of a word; null if it is all punctuation."""
    pieces = F.filter(F.split(F.regexp_replace(word, r"[!-/:-@\[-`{-~]", " "), SPACE), lambda w: w != "")
    return F.try_element_at(pieces, F.lit(1))


def headline(text: Column) -> Column:
    return F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1))


def body(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.substr(text, F.length(headline(text)) + 2)
