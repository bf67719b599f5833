"""Which shops, pages and measurements are due for work."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.urls import domain_key_any
from retailscope.operators.keyed import latest_per_key

# Shop statuses after which nothing more is done.
TERMINAL_STATUSES = ("APPROVED", "SKIPPED", "DUPLICATE")
STRATEGIES = ("mobile", "desktop")
# What counts as finished per step.
AUDIT_DONE = ("OK", "PARTIAL", "BLOCKED")
LETTER_DONE = ("READY", "APPROVED", "SKIPPED")


def active_stores(stores: DataFrame, run_stores: DataFrame, run_id: int) -> DataFrame:
    """Shops of a run that are not in a terminal status, best rank first."""
    members = run_stores.filter(F.col("run_id") == run_id).select(F.col("store_id").alias("id"))
    kept = stores.filter(~F.col("status").isin(*TERMINAL_STATUSES)).join(members, "id", "left_semi")
    return kept.orderBy(F.col("rank").asc_nulls_last(), F.col("id"))


def restrict_to_domains(stores: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shops whose domain was asked for, and what was asked for but is absent."""
    asked = domains.select(F.coalesce(domain_key_any(F.col("domain")), F.lower(F.trim("domain"))).alias("domain")).distinct()
    return stores.join(asked, "domain", "left_semi"), asked.join(stores, "domain", "left_anti")


def _instant(value: dt.datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def stale_measurements(
    stores: DataFrame,
    results: DataFrame,
    now: dt.datetime | Column,
    ttl_days: int = 7,
    strategies: Sequence[str] = STRATEGIES,
) -> DataFrame:
    """Shop and strategy pairs without a measurement younger than the TTL.

    A time that cannot be read is stale, one in the future is fresh.
    """
    fetched = F.try_to_timestamp(F.col("fetched_at").cast("string"))
    fresh = results.filter(fetched > _instant(now) - F.expr(f"INTERVAL {int(ttl_days)} DAYS")).select("store_id", "strategy")
    wanted = stores.select("store_id", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))
    return wanted.join(fresh, ["store_id", "strategy"], "left_anti")


def plan_requests(stale: DataFrame, order: Sequence[Column], max_n: int = 200, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``max_n`` requests in order, and the others with the reason."""
    text = reason or f"request budget spent ({max_n} per run)"
    admitted = stale.orderBy(*order).limit(max_n)
    refused = stale.join(admitted, ["store_id", "strategy"], "left_anti").withColumn("reason", F.lit(text))
    return admitted, refused


def gate_cooling_domains(stores: DataFrame, cooldowns: DataFrame, now: dt.datetime | Column) -> tuple[DataFrame, DataFrame]:
    """Shops that may be visited, and those still cooling with the time left."""
    until = F.col("blocked_until").cast("timestamp")
    standing = cooldowns.filter(until > _instant(now))
    keyed = stores.withColumn("_key", F.coalesce(domain_key_any(F.col("domain")), F.lower(F.trim("domain"))))
    free = keyed.join(standing.select(F.col("domain").alias("_key")), "_key", "left_anti").drop("_key")
    left = F.unix_millis(until) - F.unix_millis(_instant(now).cast("timestamp"))
    waits = standing.select(F.col("domain").alias("_key"), "blocked_until", "strikes", left.alias("ms_remaining"))
    cooling = keyed.join(waits, "_key").drop("_key")
    return free, cooling


def pending_audits(stores: DataFrame, audits: DataFrame) -> DataFrame:
    """Shops whose newest audit is missing or did not end well enough."""
    newest = latest_per_key(audits.select("store_id", "id", "status"), ["store_id"], ["id"])
    return stores.join(newest.filter(F.col("status").isin(*AUDIT_DONE)), "store_id", "left_anti")


def pending_analyses(stores: DataFrame, analyses: DataFrame, audits: DataFrame) -> DataFrame:
    """Shops whose newest classification is missing, not OK, or older than the newest audit."""
    reading = latest_per_key(
        analyses.select("store_id", "id", F.col("status").alias("_status"), F.col("created_at").alias("_read_at")),
        ["store_id"], ["id"],
    ).drop("id")
    audit = latest_per_key(
        audits.select("store_id", "id", F.col("finished_at").alias("_audited_at")), ["store_id"], ["id"]
    ).drop("id")
    joined = stores.join(reading, "store_id", "left").join(audit, "store_id", "left")
    superseded = F.coalesce(F.col("_audited_at") > F.col("_read_at"), F.lit(False))
    done = F.coalesce(F.col("_status") == "OK", F.lit(False)) & ~superseded
    return joined.filter(~done).select(*stores.columns)


def pending_contacts(stores: DataFrame, contacts: DataFrame) -> DataFrame:
    return stores.join(contacts.select("store_id"), "store_id", "left_anti")


def pending_letters(stores: DataFrame, letters: DataFrame) -> DataFrame:
    newest = latest_per_key(letters.select("store_id", "version", "status"), ["store_id"], ["version"])
    return stores.join(newest.filter(F.col("status").isin(*LETTER_DONE)), "store_id", "left_anti")


def domains_frame(spark, domains: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "domain string")
