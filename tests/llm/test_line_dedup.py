"""Operator 2 against brute force and its SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

from tidewatch.llm import line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i in range(60):
        host = ["http://A.example.com/x", "https://u:p@b.example.com:80/y?q", None, "nohost"][i % 4]
        rows.append((i, host, f"<html><head><script>x<p>y</script></head><p>Menu</p><div> body {i} <b>bold</b></div><br/><!-- c\n --><li>Foot\n{'rare' if i == 5 else i % 7}</li>", 1, 2))
    rows += [(None, None, None, 1, 2), (70, "http://a.example.com/", "", 1, 2), (70, "http://a.example.com/", "", 1, 2)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, lines int, host int").repartition(3)


def brute(rows, ratio, least, repeats):
    s = "[\x20\x09-\x0d]"
    block = re.compile(r"</?(?:html|head|title|body|header|nav|main|aside|article|section|footer|div|p|br|ul|ol|li|dl|dt|dd|h[1-6]|table|tr|td|th|form|pre|blockquote)(?:[\x20\x09-\x0d/][^>]*)?>", re.I)
    own = []
    for r in rows:
        t = re.sub(rf"(?is)<(script|style)({s}[^>]*)?>.*?</(script|style){s}*>|<!--.*?-->", " ", r.html or "")
        t = re.sub("<[^>]*>", "", block.sub("\n", t))
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r.url or "")
        own.append((r.page_id, host.group(1).lower() if host else "", [x for x in (y.strip(" \t\n\r\x0b\x0c") for y in t.split("\n")) if x]))
    total = Counter(h for _, h, _ in own)
    n = Counter((h, x) for _, h, ls in own for x in set(ls))
    out = []
    for i, h, ls in own:
        kept = [x for x in ls if not (n[(h, x)] >= repeats and total[h] >= least and n[(h, x)] > ratio * total[h])]
        out.append((i, h, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


@pytest.mark.parametrize("ratio,least,repeats", [(0.1, 5, 3), (0.5, 1, 1), (0.1, 1000, 1)])
@pytest.mark.parametrize("limit", [0, 1 << 22])
def test_pages(spark, pages, ratio, least, repeats, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    got = line_dedup.dedup_pages(pages, ratio, least, repeats).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(pages.collect(), ratio, least, repeats)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    names = ["page_id", "host", "n_lines", "n_dropped", "kept_md5"]
    want = con.execute(f"select {','.join(names)} from ({line_dedup.OP2_SQL})").fetchall()
    got = line_dedup.op2_line_dedup(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_python(spark):
    plan = line_dedup.op2_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_documents(spark, odd_docs):
    rows = [(100 + i, f"own {i}\n  Shared line \n\nend {i}", "en", "s", 30) for i in range(30)] + [(200 + i, f"Shared line\nfoo {i}", "en", None, 10) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in line_dedup.dedup_documents(docs).collect()}
    assert got[103].text == "own 3\n\nend 3" and got[103].n_chars == len(got[103].text) and got[201].text == "Shared line\nfoo 1"
    out = line_dedup.dedup_documents(odd_docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(str(tuple(r)) for r in odd_docs.select(*out.columns).collect())


def test_empty(spark):
    assert line_dedup.dedup_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert line_dedup.dedup_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []
