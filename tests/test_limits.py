"""Cases beyond former limits, international domains and late events."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from retailscope.operators import contacts, findings, keyed, overview
from retailscope.streaming import jobs


def test_all_candidates_are_ranked(spark):
    rows = spark.range(1500).select(
        F.lit(1).alias("store_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("Person "), "id")).alias("name"), F.lit(None).cast("string").alias("role"),
        F.concat("id", F.lit("@a.shop")).alias("email"), F.lit(None).cast("string").alias("linkedin_url"), F.lit("u").alias("source_url"),
        (F.col("id") % 100 / 100).alias("confidence"), (F.col("id") % 5 == 0).alias("is_generic"),
    )
    ranked = contacts.rank_contacts(rows).orderBy("contact_rank").collect()
    assert [r["contact_rank"] for r in ranked] == list(range(1, 1501))
    order = [(r["is_generic"], r["name"] is None, -r["confidence"], r["email"]) for r in ranked]
    assert order == sorted(order)


def test_all_failed_checks_are_named(spark):
    checks = spark.range(150).select(F.lit(1).alias("audit_id"), F.lit(1).alias("page_no"), F.col("id").alias("check_no"), F.concat(F.lit("c"), "id").alias("name"), F.lit("failed").alias("status"))
    row = findings.page_check_summary(checks).head()
    assert row["failed"] == 150 and row["failed_checks"] == [f"c{i}" for i in range(150)]


def test_all_inboxes_are_shown(spark):
    boxes = spark.range(1200).select(F.col("id"), F.lit(1).alias("store_id"), F.concat("id", F.lit("@a.shop")).alias("email"), F.lit(True).alias("is_generic"))
    parts = overview.shared_inboxes(boxes)
    assert parts.count() == 3
    empty = {
        "analyses": "store_id long, id long, agent string, category string, lead_score int",
        "issues": "store_id long, id long, audit_id long, severity string",
        "letters": "store_id long, version long, status string",
    }
    frames = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    people = boxes.withColumns({"name": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "linkedin_url": F.lit(None).cast("string"), "confidence": F.lit(0.5), "is_primary": F.lit(False)})
    shown = overview.store_overview(spark.createDataFrame([(1,)], "id long"), frames["analyses"], frames["issues"], frames["letters"], people).head()
    assert shown["generic_count"] == 1200 and shown["generic_emails"] == " ".join(f"{i}@a.shop" for i in range(1200))


def test_large_first_per_key_is_cut_in_parts(spark):
    rows = spark.range(5000).select(F.lit("k").alias("k"), F.col("id"))
    got = keyed.first_per_key(rows, ["k"], [F.col("id").desc()], 1500, rank="n").orderBy("n").collect()
    assert [r["id"] for r in got] == list(range(4999, 3499, -1)) and [r["n"] for r in got] == list(range(1, 1501))


def test_numbering_shuffles_all_rows_once(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("other"), "id")
    got = keyed.number_rows(rows, ["k", "other"], [F.col("id")], F.floor(F.col("id") / 50))
    want: dict = {}
    for r in sorted(got.collect(), key=lambda r: r["id"]):
        want[r["k"], r["other"]] = want.get((r["k"], r["other"]), 0) + 1
        assert r["row_no"] == want[r["k"], r["other"]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1


def test_international_domains_are_forgotten(spark):
    columns = "id long, store_id long, email string, created_at timestamp"
    held = spark.createDataFrame([(1, 1, "a@b.pl", None), (2, 2, "c@d.pl", None)], columns)
    stores = spark.createDataFrame([(1, "xn--w-uga1v8h.pl"), (2, "other.pl")], "store_id long, store_domain string")
    requests = spark.createDataFrame([(None, "https://www.Żółw.pl/", "asked")], "email string, domain string, reason string")
    none = spark.createDataFrame([], "email string, domain string, reason string")
    kept, suppressions = contacts.forget(held, none, requests, stores)
    assert [r["id"] for r in kept.collect()] == [2]
    assert [r["domain"] for r in suppressions.collect()] == ["xn--w-uga1v8h.pl"]


def test_cooldowns_meet_under_one_key_and_the_last_batch_counts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 12)
    schema = "domain string, ts timestamp, outcome string, reason string, status int, retry_after string"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def batch(*events):
        spark.createDataFrame([(d, start + dt.timedelta(minutes=m), o, "r", 429, None) for d, m, o in events], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.write_stream(jobs.track_cooldowns(spark.readStream.schema(schema).parquet(source)), out, check).awaitTermination()
        return {r["domain"]: r["strikes"] for r in jobs.newest_cooldowns(spark, out).collect()}

    assert batch(("www.Shop.pl", 0, "refused"), ("https://shop.pl/x", 5, "refused"), ("free.pl", 1, "refused")) == {"shop.pl": 2, "free.pl": 1}
    assert batch(("shop.pl", -30, "ok")) == {"free.pl": 1}
    assert os.path.isdir(out)
