import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.functions.dates import retry_after
from retailscope.functions.numbers import months_since, round_half_up
from retailscope.functions.people import detect_role, looks_like_person_name, name_key
from retailscope.functions.text import fold, fold_any, jaccard, shingles, version_struct, word_count, words
from retailscope.functions.urls import domain_key, domain_key_any, url_key
from retailscope.operators.links import blocks_everything, robots_match


def values(spark, inputs, *builds):
    df = spark.createDataFrame([(i,) for i in inputs], "v string")
    return [tuple(r) if len(builds) > 1 else r[0] for r in df.select(*[b(F.col("v")) for b in builds]).collect()]


def test_domain_key(spark):
    cases = {
        "HTTPS://www.Shop.PL:443/a?b#c": "shop.pl",
        "shop.pl.": "shop.pl",
        "http://user:pw@shop.pl": None,
        "ftp://shop.pl": None,
        "shop.pl:8080": None,
        "localhost": None,
        "example.com": None,
        "10.0.0.1": None,
        "a_b.pl": None,
        "-a.pl": None,
        "www.www.shop.pl": "www.shop.pl",
        " ": None,
    }
    assert values(spark, cases, domain_key) == list(cases.values())
    assert values(spark, ["https://żółw.pl/x"], domain_key_any) == ["xn--w-uga1v8h.pl"]


def test_url_key(spark):
    cases = {
        "https://WWW.Shop.pl/A/B/?x=1": "shop.pl/a/b",
        "https://pl.linkedin.com/in/X": "linkedin.com/in/x",
        "mailto:a@b.pl": None,
    }
    assert values(spark, cases, url_key) == list(cases.values())


def test_folding_and_words(spark):
    assert values(spark, ["ŁÓDŹ Żółć café"], fold, fold_any) == [("lodz zolc cafe", "lodz zolc cafe")]
    assert values(spark, ["Ala, ma -- kota 2!", " "], words) == [["ala", "ma", "kota", "2"], []]
    assert values(spark, ["a – b, 3 !"], word_count) == [3]
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["b", "c", "d", "e"])], "x array<string>, y array<string>")
    row = df.select(shingles(F.col("x")).alias("s"), jaccard(shingles(F.col("x")), shingles(F.col("y"))).alias("j")).first()
    assert row["s"] == ["a b c d", "b c d e"] and row["j"] == 0.5


def test_versions_and_months(spark):
    got = values(spark, ["v2.10", "3", "1.2.3-rc", "x"], version_struct)
    assert [tuple(g) if g else None for g in got] == [(2, 10, 0), (3, 0, 0), (1, 2, 3), None]
    df = spark.createDataFrame([(dt.date(2026, 1, 31), dt.date(2026, 2, 28))], "a date, b date")
    assert df.select(months_since(F.col("a"), F.col("b"))).first()[0] == 0


@pytest.mark.parametrize("value,want", [(2.5, 3), (-2.5, -2), (0.49, 0)])
def test_rounding_is_half_up(spark, value, want):
    assert spark.range(1).select(round_half_up(F.lit(value))).first()[0] == want


def test_retry_after(spark):
    now = F.lit(dt.datetime(2026, 9, 1, 12, 0, 0))
    cases = {"120": 120, "-5": 0, "Tue, 01 Sep 2026 12:01:00 GMT": 60, "soon": None, "": None}
    assert values(spark, cases, lambda c: retry_after(c, now)) == list(cases.values())


def test_mailboxes(spark):
    assert values(spark, ["a@shop.pl", "logo@2x.png", "test@shop.pl", "a..b@shop.pl", "x@example.com"], mail.valid_email) == [True, False, False, False, False]
    assert values(spark, ["info@x.pl", "anna.nowak@x.pl", "shop-team@x.pl", "acme@acme.pl", "b2b@x.pl", "jan+info@x.pl"], mail.is_generic_mailbox) == [True, False, True, True, False, False]


def test_people(spark):
    assert values(spark, ["Anna Nowak", "Polityka Prywatności", "Anna", "Anna Maria Kot Lis"], looks_like_person_name) == [True, False, False, False]
    assert [r and r["role"] for r in values(spark, ["Founder & CEO", "współzałożycielka", "ownership"], detect_role)] == ["CEO", "Co-Founder", None]
    assert values(spark, ["Łukasz Żak-Nowak"], name_key) == ["lukasz zak nowak"]


def test_robots_pattern_ties_only_its_tail(spark):
    cases = [("/a*b$", "/axxb", True), ("/a*b$", "/abxb", True), ("/a*b$", "/ab/c", False), ("/cart", "/cart/x", True), ("*.pdf", "/x/y.pdf?z", True), ("/a.c", "/abc", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, u string")
    assert [r[0] for r in df.select(robots_match(F.col("p"), F.col("u"))).collect()] == [c[2] for c in cases]
    texts = ["User-agent: *\nDisallow: /", "User-agent: x\nDisallow: /", "User-agent: *\nDisallow: /a\nuser-agent: *\ndisallow : /"]
    assert values(spark, texts, blocks_everything) == [True, False, True]
