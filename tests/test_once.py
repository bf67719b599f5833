"""What a filter or a window reads is worked out once a row, and quotes meet only places that read like them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from retailscope.functions import people
from retailscope.operators import answers, contacts, letters, search


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, "{}")], "store_id long, text string")
    assert plan(answers.clamped_scores(answers.validate_answers(rows, "analyst"))).count("parseJson(") == 1


def test_search_filters_fold_nothing(spark):
    hits = spark.createDataFrame([(1, "a.pl", "b", 0, "q", 1, "u", "t", "s")], "store_id long, store_domain string, brand string, query_no int, query string, pos long, url string, title string, snippet string")
    lines = plan(search.read_search_people(hits)).split("\n")
    assert not [line for line in lines if "Filter" in line and "translate(" in line]


def test_versions_are_folded_once_a_side(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a b c d e"), (2, 1, 2, "a b c d f")], "id long, store_id long, version long, body string")
    found = letters.version_similarity(rows)
    assert plan(found).count("translate(") <= 4
    assert [tuple(r) for r in found.collect()] == [(2, 1, 0.333)]


def test_role_pattern_finds_what_it_says(spark):
    upper, lower = "A-ZĄĆĘŁŃÓŚŹŻ", "a-ząćęłńóśźż"
    token = f"[{upper}][{lower}]{{1,20}}(?:-[{upper}][{lower}]{{1,20}})?"
    name = f"{token}(?:\\s+{token}){{1,2}}"
    written = {
        people.ROLE_THEN_NAME: f"([{upper}{lower}\\s-]{{3,40}})\\s*[:\\-–—]\\s*({name})",
        people.NAME_THEN_ROLE: f"({name})\\s*[,\\-–—|(]\\s*([{upper}{lower}\\s-]{{3,40}})",
    }
    rng = random.Random(5)
    pieces = ["CEO", "prezes", " - ", "-", ": ", "–", " ", "  ", "Anna Nowak", "Łukasz Żak-Lis", "Jan", ".", ", ", "owner of a very long list of many words", "7"]
    texts = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))),) for _ in range(4000)], "t string")
    for quick, plain in written.items():
        same = F.regexp_extract_all("t", F.lit(quick), F.lit(0)) == F.regexp_extract_all("t", F.lit(plain), F.lit(0))
        assert texts.filter(~same).count() == 0 and texts.filter(F.col("t").rlike(plain)).count() > 100
    assert texts.filter(F.col("t").rlike(people.ROLE_THEN_NAME) & ~F.col("t").rlike(people.BEFORE_NAME)).count() == 0


def test_quotes_of_common_words_meet_their_own_page(spark):
    quotes = spark.createDataFrame([(1, f"jan lis runs shop {n}.") for n in range(300)] + [(1, "jan lis")], "store_id long, _quote string")
    texts = spark.createDataFrame([(1, n, f"see: jan lis runs shop {n}. bye") for n in range(300)] + [(1, 999, "xjan lisa")], "store_id long, page_no long, _text string")
    found = contacts.texts_with_quotes(quotes, texts, ["page_no"]).collect()
    assert sorted((r["page_no"], r["_quote"]) for r in found) == sorted([(n, f"jan lis runs shop {n}.") for n in range(300)] + [(n, "jan lis") for n in [*range(300), 999]])
