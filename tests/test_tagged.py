"""The tagged source and its readers."""

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import cache, tagged

TEXT = "#docstart\n#titlestart\nVolby\tvolba\tNNFP1\n.\t.\tZ:\n#titleend\n#textstart\nLidé\tčlověk\tNNMP1\nvolili\tvolit\tVpMP\n\n#\t#\tZ:\nbad line without tabs\ndnes\tdnes\tDb\n#textend\n#docend\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2014-12-02.txt.tagged").write_bytes(TEXT.encode() + b"\xff" + b"\n" + TEXT.replace("Volby", "Druhé").encode())
    (tmp_path / "2014-11-30.txt.tagged").write_text(TEXT)
    return str(tmp_path)


def test_documents(spark, folder):
    docs = tagged.scan(spark, folder)
    rows = tagged.token_documents(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.day) for r in rows] == [(0, 0), (1, 2), (2, 2)]
    assert rows[0].name == ["volba"] and rows[0].text == ["člověk", "volit", "dnes"]
    assert tagged.token_documents(docs, forms=True, tags=("N",)).where("doc_id = 2").first().text == ["Lidé"]
    assert tagged.token_documents(docs, names_only=True).columns == ["doc_id", "day", "name"]
    sentences = tagged.sentence_documents(docs).where("doc_id = 0").orderBy("sent_no").collect()
    assert [s.form for s in sentences] == [["Lidé", "volili"], ["dnes"]]
    assert tagged.scan(spark, folder, "dec-jan").count() == 2
    with pytest.raises(ValueError):
        tagged.scan(spark, folder, "other")


def test_unknown_control_line():
    with pytest.raises(ValueError):
        list(tagged.parse_lines(["#docstart", "#unknown"]))


def test_lexicon(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tN\tdobrý_^x\tPOS\tm\nN\tV\tnechtít\tNEG\tm\n")
    assert {tuple(r) for r in tagged.lexicon(spark, str(tmp_path / "a.tsv")).collect()} == {("dobrý", "POS"), ("chtít", "NEG")}
    (tmp_path / "b.tsv").write_text("A\tN\tx\tBOTH\tm\n")
    with pytest.raises(Exception, match="unknown orientation"):
        tagged.lexicon(spark, str(tmp_path / "b.tsv")).collect()


def test_real_events_and_lines(spark, tmp_path):
    (tmp_path / "3.txt").write_text("a\tb\tNN\nc\td\tZ:\ne\tf\tVp\nx\n")
    assert [tuple(r) for r in tagged.real_events(spark, str(tmp_path)).collect()] == [(3, ["b", "f"])]
    assert tagged.plain_lines(spark, str(tmp_path / "3.txt")).count() == 4


def test_cache(spark, tmp_path):
    made = []
    build = lambda: (made.append(1), spark.range(3))[1]
    path = f"file://{tmp_path}/t"
    assert cache.missing(spark, [path]) == [path]
    for _ in range(2):
        assert cache.read_or_build(spark, path, build).count() == 3
    assert made == [1] and cache.missing(spark, [path]) == [] and cache.can_read(spark, path)
    assert cache.materialize(spark.range(5).select(F.col("id") * 2), "x").count() == 5
