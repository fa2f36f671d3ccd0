"""Tagged corpora: one file a day, a token with lemma and tag on each line."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The control lines of the format, and the tags kept by default.
CONTROLS = ("#docstart", "#docend", "#titlestart", "#titleend", "#textstart", "#textend")
TAGS = ("A", "C", "D", "I", "J", "N", "P", "V", "R", "T")

Token = tuple[str, str, str]
TOKEN = "struct<form:string,lemma:string,pos:string>"
SCHEMA = f"file_day date, doc_no int, name array<{TOKEN}>, sentences array<array<{TOKEN}>>"

#: Named spans of days: first and last, both included; None is open.
DATASETS = {"full": (None, None), "dec-jan": ("2014-12-01", "2015-01-31")}


def parse_lines(lines: Iterable[str]) -> Iterator[tuple[list[Token], list[list[Token]]]]:
    """(headline, sentences) of each document. Blank lines end a sentence, lines without exactly three fields and tokens that
    are a lone # are skipped, unknown control lines raise."""
    name: list[Token] = []
    sentences: list[list[Token]] = []
    own: list[Token] = []
    part = None
    for raw in lines:
        line = raw.rstrip("\r\n")
        fields = line.strip().split("\t")
        if not line.strip():
            if part == "text" and own:
                sentences.append(own)
                own = []
        elif line.startswith("#") and fields[0] != "#":
            word = fields[0]
            if word not in CONTROLS:
                raise ValueError(f"unknown control line {word!r}")
            if word == "#docstart":
                name, sentences, own = [], [], []
            elif word == "#textend" and own:
                sentences.append(own)
                own = []
            elif word == "#docend":
                yield name, sentences
            part = {"#titlestart": "title", "#textstart": "text"}.get(word)
        elif len(fields) == 3 and fields[0] != "#" and part:
            (name if part == "title" else own).append((fields[0], fields[1], fields[2]))


def scan(spark: SparkSession, path: str, dataset: str = "full") -> DataFrame:
    """doc_id, day, file_day, name, sentences of YYYY-MM-DD.txt.tagged files. Documents are numbered in order of the file's
    day and their place in it, days from the first file's. Files outside the dataset are dropped by name before they are read;
    undecodable bytes are ignored."""
    if dataset not in DATASETS:
        raise ValueError(f"dataset is one of {', '.join(DATASETS)}")
    low, high = DATASETS[dataset]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tagged").load(path)
    day = F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1)).alias("file_day")
    own = files.select(day, "content")
    if low:
        own = own.where(F.col("file_day").between(low, high))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for when, content in zip(pdf["file_day"], pdf["content"], strict=True):
                rows = [(when, i, _dicts(n), [_dicts(s) for s in ss]) for i, (n, ss) in enumerate(parse_lines(content.decode("utf-8", "ignore").split("\n")))]
                if rows:
                    yield pd.DataFrame(rows, columns=["file_day", "doc_no", "name", "sentences"])

    docs = own.mapInPandas(run, SCHEMA)
    per_day = docs.groupBy("file_day").agg(F.count("*").alias("n"))
    order = Window.orderBy("file_day")  # a row for each file
    first = per_day.select("file_day", (F.sum("n").over(order) - F.col("n")).alias("before"), F.datediff("file_day", F.min("file_day").over(Window.partitionBy())).cast("int").alias("day"))
    return docs.join(first, "file_day").select((F.col("before") + F.col("doc_no")).alias("doc_id"), "day", "file_day", "name", "sentences")


def _dicts(tokens: list[Token]) -> list[dict]:
    return [{"form": f, "lemma": x, "pos": p} for f, x, p in tokens]


def token_documents(docs: DataFrame, forms: bool = False, tags: Sequence[str] = TAGS, names_only: bool = False) -> DataFrame:
    """doc_id, day, name, text: lemmas (or forms) of the tokens whose tag begins with one of `tags`."""
    keep = lambda x: F.filter(x, lambda t: F.substring(t.pos, 1, 1).isin(*tags))
    pick = lambda x: F.transform(keep(x), lambda t: t.form if forms else t.lemma)
    name = pick(F.col("name")).alias("name")
    return docs.select("doc_id", "day", name) if names_only else docs.select("doc_id", "day", name, pick(F.flatten("sentences")).alias("text"))


def sentence_documents(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, form, lemma, pos (arrays): every sentence, tags unfiltered."""
    s = docs.select("doc_id", F.posexplode("sentences").alias("sent_no", "s"))
    return s.select("doc_id", "sent_no", *(F.col(f"s.{c}").alias(c) for c in ("form", "lemma", "pos")))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """lemma, orientation of a tab-separated lexicon (negation, pos, lemma, orientation, source). What follows an underscore
    is a comment; a negated lemma loses its first two letters; any orientation but POS and NEG raises when it is read."""
    raw = spark.read.csv(path, sep="\t", schema="negation string, pos string, lemma string, orientation string, source string")
    bare = F.split_part("lemma", F.lit("_"), F.lit(1))
    lemma = F.when(F.col("negation") == "N", F.substr(bare, F.lit(3))).otherwise(bare)
    side = F.when(F.col("orientation").isin("POS", "NEG"), F.col("orientation")).otherwise(F.raise_error(F.concat(F.lit("unknown orientation "), F.coalesce("orientation", F.lit("null")))))
    return raw.select(lemma.alias("lemma"), side.alias("orientation"))


def real_events(spark: SparkSession, path: str, tags: Sequence[str] = ("N", "V", "A", "D")) -> DataFrame:
    """real_id, words: the set of lemmas in each <id>.txt of tagged lines."""
    lines = spark.read.text(path, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("int").alias("real_id"), F.split(F.trim("value"), "\t").alias("f"))
    own = lines.where((F.size("f") == 3) & F.substring(F.try_element_at("f", F.lit(3)), 1, 1).isin(*tags))
    return own.groupBy("real_id").agg(F.sort_array(F.collect_set(F.col("f")[1])).alias("words"))


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line."""
    return spark.read.text(path).select(F.col("value").alias("text"))
