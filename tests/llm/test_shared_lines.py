"""The line-dedup stage on lines that a few hundredths of a source's documents have."""

import corpus_pipeline


def test_shared_lines(spark):
    own = lambda s, i: "\n".join(f"{s} {i} line {k} of its own" for k in range(8))
    rows = [(i, own("big", i) + ("\nPosted in News" if i % 20 == 0 else "") + ("\nSeldom" if i < 8 else ""), "en", "big", 1) for i in range(1000)]
    rows += [(2000 + i, own("small", i) + "\nFooter", "en", "small", 1) for i in range(9)]
    rows += [(3000 + i, own("copied", 0) + (f"\nedit {i}" if i % 2 else ""), "en", "big", 1) for i in range(60)]  # copies are near-dedup's
    rows += [(4000, "Posted in News\n Posted in News \nown", "en", "big", 1), (4001, "Posted in News\nPosted", "en", "other", 1), (4002, "Posted in News", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    want = {i: t for i, t, *_ in rows}
    for i in range(0, 1000, 20):
        want[i] = want[i].replace("\nPosted in News", "")
    for i in range(9):
        want[2000 + i] = own("small", i)
    want[4000] = "own"
    assert got == want
