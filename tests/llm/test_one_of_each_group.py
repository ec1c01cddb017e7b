"""One row of each group of similar texts, whatever the ids."""

from collections import Counter

from morphlake.llm import op4_lsh_forest_join as op4

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    out = op4.one_of_each_group(docs)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def text(word, n=40):
    return " ".join(f"{word}{i}" for i in range(n))


def test_rows_of_null_or_shared_id_are_classed_by_text(spark):
    near = lambda t, w: t.replace(f"{w}39", "other")
    clean = [(None, text(f"n{k}x")) for k in range(12)] + [(7, text(f"s{k}x")) for k in range(6)]
    copies = [(9, text("n0x")), (None, near(text("n1x"), "n1x")), (None, text("n2x")), (8, near(text("s3x"), "s3x")), (7, text("s4x"))]
    got = kept(spark, clean + copies)
    want = Counter([r for r in clean if r[1] not in (text("n0x"), text("n1x"))] + [(9, text("n0x"))])
    one = [r for r in got if r[1] in (text("n1x"), near(text("n1x"), "n1x"))]
    assert len(one) == 1 and got - Counter(one) == want


def test_the_clean_text_of_a_shared_id_stays(spark):
    for k in range(8):  # whichever of the two texts of id 5 has the smaller hash
        base, other = text(f"b{k}x"), text(f"c{k}x")
        assert kept(spark, [(1, base), (5, base.upper()), (5, other)]) == Counter([(1, base), (5, other)])


def test_texts_without_words_stay(spark):
    rows = [(None, None), (None, None), (None, ""), (None, "?!"), (2, "?!"), (2, "?!"), (2, ""), (3, "?!"), (-1, ""), (None, "é"), (None, "é")]
    assert kept(spark, rows) == Counter([(None, None), (None, None), (None, ""), (None, "?!"), (2, "?!"), (2, ""), (3, "?!"), (-1, ""), (None, "é")])
