"""Operator 2: lines that a site repeats, by the share of its pages that have them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bytes up to which the boilerplate lists are broadcast; beyond, hosts are joined by shuffle (AQE splits hot ones).
BROADCAST_BYTES = 4 << 20

_S = r"[\x20\x09-\x0D]"
_UNSEEN = rf"(?is)<(?:script|style)(?:{_S}[^>]*)?>.*?</(?:script|style){_S}*>|<!--.*?-->"
_BLOCK = rf"(?i)</?(?:html|head|title|body|header|nav|main|aside|article|section|footer|div|p|br|ul|ol|li|dl|dt|dd|h[1-6]|table|tr|td|th|form|pre|blockquote)(?:[\x20\x09-\x0D/][^>]*)?>"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def page_lines(html: Column) -> Column:
    """The text lines of a page: block tags and line ends part them, other tags vanish, outer white space and empty lines go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_S}+|{_S}+$", "")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, min_repeats: int) -> DataFrame:
    """pages (host, lines: array of trimmed lines) -> host, drop: hashes of the lines on more than max_ratio of its pages.

    Each page sends one hash for each of its distinct lines, counted before and after the shuffle, so neither a hot host nor
    a hot line meets in one task. A host's list is bounded: of lines on over max_ratio of the pages there are fewer than a
    page's mean number of lines / max_ratio.
    """
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.xxhash64(x)))
    total = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    per_line = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = per_line.where(F.col("n") >= min_repeats).join(total.where(F.col("n_pages") >= min_pages), "host").where(F.col("n") > max_ratio * F.col("n_pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("drop"))


def with_boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, min_repeats: int) -> DataFrame:
    """pages (host, lines, any) with `drop`, the hashes of its host's boilerplate lines (null: none)."""
    return joined(pages, boilerplate(pages.select("host", "lines"), max_ratio, min_pages, min_repeats))


def joined(pages: DataFrame, drop: DataFrame) -> DataFrame:
    found = materialize(drop, "boilerplate")
    size = found.agg(F.sum(F.size("drop") * 8 + F.length("host") + 64)).first()[0] or 0
    return pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")


def keeps(x: Column) -> Column:
    return F.col("drop").isNull() | ~F.array_contains("drop", F.xxhash64(x))


def dedup_pages(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 5, min_repeats: int = 3) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, host, n_lines, n_dropped, kept_text, a row for each row.

    Null and hostless urls share the host ''; null and empty pages have no lines; repeated rows count as pages of their own;
    a null page_id stays null; other columns are ignored, whatever their names.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    out = with_boilerplate(own, max_ratio, min_pages, min_repeats).withColumn("kept", F.filter("lines", keeps))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def shared_lines(docs: DataFrame, max_ratio: float, min_pages: int, min_repeats: int) -> DataFrame:
    """docs (host, lines: array of trimmed lines) -> host, drop: hashes of the lines that otherwise different documents share.

    A line has to be on more than max_ratio of its source's documents, and also when only those documents count in which
    such lines are at most half of all: in copies of a whole document they are most, and copies are left to near-dedup.
    """
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.xxhash64(x)))
    own = joined(docs.select("host", hashes.alias("lines")), boilerplate(docs, max_ratio, min_pages, min_repeats)).where("drop is not null")
    own = own.select("host", "lines", F.array_intersect("lines", "drop").alias("some")).where(2 * F.size("some") <= F.size("lines"))
    n = own.select("host", F.explode("some").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_repeats)
    total = docs.groupBy("host").agg(F.count("*").alias("n_docs"))
    return n.join(total, "host").where(F.col("n") > max_ratio * F.col("n_docs")).groupBy("host").agg(F.collect_set("line").alias("drop"))


def dedup_documents(docs: DataFrame, max_ratio: float = 0.01, min_pages: int = 5, min_repeats: int = 5) -> DataFrame:
    """documents without the lines that more than max_ratio of their source's documents share (see shared_lines); the other
    lines stay as they are, and a null text stays null. Lines are compared without outer white space; blank ones always stay."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    raw = F.split("text", "\n")
    lines = F.transform(F.coalesce(raw, F.array().cast("array<string>")), trimmed)
    own = docs.select(*names, F.concat_ws("", F.when(F.col("source").isNull(), "n").otherwise("s"), "source").alias("host"), lines.alias("lines"))
    own = joined(own, shared_lines(own.select("host", "lines"), max_ratio, min_pages, min_repeats))
    kept = F.filter(raw, lambda x: (trimmed(x) == "") | keeps(trimmed(x)))
    cut = F.col("drop").isNotNull() & F.arrays_overlap(F.transform("lines", lambda x: F.xxhash64(x)), "drop")
    text = F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_pages(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5"))


OP2_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_UNSEEN}', ' ', 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
total AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host),
per_line AS (SELECT host, line, count(*) AS n FROM (SELECT rid, host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
dropped AS (SELECT host, line FROM per_line JOIN total USING (host) WHERE n >= 3 AND n_pages >= 5 AND n > 0.1 * n_pages),
each AS (SELECT rid, i, lines[i] AS line, host FROM (SELECT rid, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM p)),
kept AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM each ANTI JOIN dropped USING (host, line) GROUP BY rid)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, md5(coalesce(t, '')) AS kept_md5
FROM p LEFT JOIN kept USING (rid)
"""
