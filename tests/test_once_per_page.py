"""Rules build only the issues that hold, and a page's markup and tags are read once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from retailscope.functions import html as h
from retailscope.operators import extract, grading


def test_issues_are_built_for_rules_that_hold(spark):
    sites = spark.createDataFrame([(1, 2, "https://a", True, False, None), (3, 4, "https://b", False, True, True)], "audit_id long, store_id long, origin string, robots_blocks_all boolean, has_sitemap boolean, has_robots boolean")
    found = grading.grade_site_seo(sites)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["audit_id"], r["rule_no"], r["severity"], r["evidence"][0]["url"], r["evidence"][0]["expected"]) for r in found.collect()]
    assert rows == [(1, 0, "CRITICAL", "https://a/robots.txt", None), (1, 1, "MAJOR", "https://a/sitemap.xml", "an XML sitemap")]


def test_an_attribute_is_matched_once(spark):
    tags = ['<a href="x y">', "<a href='q\"r'>", "<a HREF = z>", "<a href>", "<a data-href=1>", "<a href=''>", '<a b="href=1" href="2">', None]
    df = spark.createDataFrame([(t,) for t in tags], "t string").select(h.attribute(F.col("t"), "href").alias("v"))
    assert [r["v"] for r in df.collect()] == ["x y", 'q"r', "z", "", None, "", "2", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_checkout_markup_is_cleaned_once(spark):
    pages = spark.createDataFrame([(1, "u", "<P>zł 5&nbsp; &amp; x</P><div class='ERROR'>No <b>way</b></div>")], "page_id long, url string, html string")
    facts = extract.extract_checkout_facts(pages, "pl")
    assert facts.head()["visible_errors"] == ["No way"] and not facts.head()["has_local_currency"]
    lines = facts._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\([^\n]*noscript", lines)) == 1


def test_blanks_are_collapsed_as_before(spark):
    texts = ["a b", " a  b ", "a b", "a\t\n b", "a  　c", "\x85x y​z", "᠎a\x1cb", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(h.collapsed(F.col("t")) != F.trim(F.regexp_replace("t", "(?U)\\s+", " "))).count() == 0
