"""People whose names are none."""

from pyspark.sql import functions as F

from retailscope.operators import contacts
from retailscope.plans import contacts as plans
from retailscope.session import run_sql


def test_confirm_people_judges_names(spark, sf_dir):
    pages = run_sql(spark, sf_dir, plans.PEOPLE).withColumn("page_id", F.col("person_id")).withColumn("pos", F.lit(0))
    assert pages.filter(F.col("name").endswith("Sklep") & (F.col("source") == "jsonld")).count() > 0
    found = contacts.confirm_people(pages, run_sql(spark, sf_dir, plans.BOXES))
    assert found.filter(F.col("name").endswith("Sklep")).count() == 0 and found.count() > 0


def test_evidence_lists_hold_people(spark, sf_dir):
    from retailscope.plans.catalogue import all_queries

    lists = all_queries()["evidence_lists_with_people"].build(spark, sf_dir)
    assert {r["kind"] for r in lists.select("kind").distinct().collect()} >= {"people", "personal_emails", "profile_links"}
