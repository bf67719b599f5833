"""Which rows the pipeline's stages keep."""

from __future__ import annotations

from retailscope.llm import stages

DOCS = "doc_id long, text string, lang string, m map<string,int>"


def kept(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]) for r in frame.collect())


def test_near_copies_are_dropped_row_by_row(spark):
    one, two, three, four, five = ("one text of some words here", "another wholly different passage to read", "third story that nobody copies at all", "nameless words without any number", "last lines of the small table")
    rows = [
        (1, one, "a"), (None, one, "b"), (None, one, "c"),  # null ids beside an id
        (2, two, "b"), (2, two, "a"), (2, two, "a"),  # one id and text
        (4, one, "d"), (4, three, "d"),  # an id with a copy and a text of its own
        (None, four, "f"), (None, four, "e"),  # null ids alone
        (6, five, "g"), (5, five, "h"), (5, three, "i"),
    ]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], DOCS).repartition(4)
    found = stages.drop_near_copies(spark, docs, "")
    want = [(False, 1, one, "a"), (False, 2, two, "ab"), (False, 4, three, "d"), (False, 5, five, "h"), (True, 0, four, "ef")]
    got = kept(found)
    assert found.columns == docs.columns and [r[:3] for r in got] == [r[:3] for r in want]
    assert all(r[3] in w[3] for r, w in zip(got, want, strict=True)) and kept(stages.drop_near_copies(spark, docs.repartition(1), "")) == got
    assert stages.drop_near_copies(spark, docs.where("false"), "").count() == 0
    assert [r["m"] for r in found.collect()] == [{"k": 1}] * 5


def test_texts_stay_if_no_language_is_learned(spark):
    rows = [(1, "words of a text", None, None), (2, None, None, None), (3, "12 _ !!", None, None), (4, "é", None, None), (5, "日", None, None), (6, "²", None, None), (7, "½ ⅓ Ⅷ ①", None, None), (8, "", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = stages.keep_known_languages(spark, docs, "")
    assert found.columns == docs.columns and sorted(r["doc_id"] for r in found.collect()) == [1, 4, 5]
    labelled = spark.createDataFrame([(r[0], r[1], "en", None) for r in rows], DOCS)
    assert sorted(r["doc_id"] for r in stages.keep_known_languages(spark, labelled, "").collect()) == [1, 4, 5]
