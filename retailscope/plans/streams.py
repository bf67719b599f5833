"""Streaming queries over the event and customer files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.plans import feed, runs, standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, table
from retailscope.sources.feed import normalise_store_feed
from retailscope.streaming import jobs

registry = Registry()


def stream_of(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    """A stand-in relation over a table read as a stream of files."""
    source = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    escaped = text.replace("{", "{{").replace("}", "}}").replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(escaped, **{name: source})


REFUSALS = """
SELECT concat('d', CAST(user_id AS VARCHAR(20)), '.shop') AS domain, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'ok' ELSE 'refused' END AS outcome, 'rate_limited' AS reason,
       CASE WHEN event_type = 'error' THEN 429 ELSE 403 END AS status, CASE WHEN value > 80 THEN CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR(20)) END AS retry_after FROM {events}
"""


COOLDOWNS = """
WITH RECURSIVE e AS (
  SELECT domain, epoch_us(ts) // 1000 AS ts, outcome, CASE WHEN retry_after IS NOT NULL THEN least(CAST(retry_after AS BIGINT) * 1000, 86400000) END AS asked, row_number() OVER (PARTITION BY domain ORDER BY epoch_us(ts) // 1000, outcome) AS n FROM refusals
), fold AS (
  SELECT DISTINCT domain, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS strikes, CAST(0 AS BIGINT) AS until FROM e
  UNION ALL
  SELECT domain, n, CAST(s AS BIGINT), CAST(CASE WHEN s = 0 THEN 0 ELSE ts + greatest(coalesce(asked, 0), least(3600000 * pow(2, s - 1), 86400000)) END AS BIGINT) FROM (
    SELECT e.domain, e.n, e.ts, e.asked, CASE WHEN outcome = 'ok' THEN 0 WHEN f.until > e.ts THEN f.strikes + 1 ELSE 1 END AS s FROM fold f JOIN e ON e.domain = f.domain AND e.n = f.n + 1)
)
SELECT domain, until AS blocked_until_ms, CAST(strikes AS INT) AS strikes FROM fold QUALIFY n = max(n) OVER (PARTITION BY domain) AND until > 0
"""


@registry.add("track_cooldowns", st.with_tables(COOLDOWNS, refusals=REFUSALS))
def track_cooldowns(spark, sf):
    folder = jobs.stream_folder(spark, "cooldowns")
    query = jobs.write_stream(jobs.track_cooldowns(stream_of(spark, sf, "events", REFUSALS)), os.path.join(folder, "out"), os.path.join(folder, "check"))
    query.awaitTermination()
    return jobs.newest_cooldowns(spark, os.path.join(folder, "out")).select("domain", "blocked_until_ms", "strikes")


@registry.add("stream_run_report", runs.registry.queries["run_report"].sql)
def stream_run_report(spark, sf):
    folder = jobs.stream_folder(spark, "report")
    out = os.path.join(folder, "out")
    jobs.stream_final_attempts(stream_of(spark, sf, "events", st.STEP_LOGS), out, os.path.join(folder, "check")).awaitTermination()
    return jobs.read_streamed_report(spark, out).drop("step_rank")


@registry.add(
    "stream_feed_ingest",
    st.with_tables(f"SELECT pos, domain FROM ({feed.LABELLED}) WHERE feed_label = 'new'", raw_feed=feed.RAW_FEED, known=feed.KNOWN),
)
def stream_feed_ingest(spark, sf):
    folder = jobs.stream_folder(spark, "feed")
    out = os.path.join(folder, "out")
    shops = normalise_store_feed(stream_of(spark, sf, "customer", feed.RAW_FEED)).select(*feed.SHOP_COLUMNS)
    jobs.ingest_feed_incrementally(shops, run_sql(spark, sf, feed.KNOWN), out, os.path.join(folder, "check")).awaitTermination()
    return spark.read.parquet(out).select("pos", "domain")


RUN_EVENTS = """
SELECT user_id AS run_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type IN ('view', 'click') THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM {events}
"""


@registry.add(
    "detect_abandoned_runs",
    st.with_tables(
        """SELECT run_id, epoch_us(ts) // 1000 AS last_seen_ms FROM (SELECT *, lead(ts) OVER (PARTITION BY run_id ORDER BY ts) AS nxt, max(ts) OVER () AS latest FROM e)
        WHERE status = 'RUNNING' AND (nxt IS NULL OR nxt > ts + INTERVAL 2 HOUR) AND ts + INTERVAL 2 HOUR <= latest - INTERVAL 10 MINUTE""",
        e=RUN_EVENTS,
    ),
)
def detect_abandoned_runs(spark, sf):
    folder = jobs.stream_folder(spark, "lost")
    out = os.path.join(folder, "out")
    lost = jobs.detect_abandoned_runs(stream_of(spark, sf, "events", RUN_EVENTS))
    jobs.write_stream(lost, out, os.path.join(folder, "check")).awaitTermination()
    return spark.read.parquet(out).select("run_id", F.unix_millis("last_seen").alias("last_seen_ms"))
