"""Readers of landed files: each file set is written from the tables, then read."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from retailscope.operators import walls
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql
from retailscope.sources import catalog, feed, upserts
from retailscope.streaming.jobs import stream_folder

registry = Registry()


def landing(spark, name: str) -> str:
    """A new folder for landed files on the session's shared storage."""
    return os.path.join(stream_folder(spark, name), "landed")


RESPONSES = """
SELECT c_custkey AS k, concat('{"domains": [{"name": "Shop', CAST(c_custkey AS VARCHAR(20)), '.pl", "merchant_name": " ', c_name, '", "rank": ', CASE WHEN c_nationkey < 10 THEN concat('"', CAST(c_nationkey AS VARCHAR(9)), '.5"') ELSE CAST(c_nationkey AS VARCHAR(9)) END,
  ', "theme": ', CASE WHEN c_mktsegment = 'BUILDING' THEN '"Dawn"' ELSE concat('{"name": "Craft", "version": "', CAST(c_nationkey AS VARCHAR(9)), '.0"}') END,
  ', "apps": [{"name": "Mail ', CAST(c_nationkey AS VARCHAR(9)), '", "state": "active", "categories": ["Ads", {"name": "Forms"}, "unknown"]}], "categories": [{"name": "x"}, "', c_mktsegment, '"]}, ',
  '{"name": null, "platform_domain": "p', CAST(c_custkey AS VARCHAR(20)), '.host.pl", "estimated_sales": ', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)), '}], "has_next_page": ', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END, '}') AS value
FROM {customer}
"""


@registry.add(
    "read_store_feed",
    """SELECT concat('Shop', c_custkey, '.pl') AS name, CAST(NULL AS VARCHAR) AS platform_domain, 0 AS pos, concat(' ', c_name) AS merchant_name, CASE WHEN c_nationkey < 10 THEN concat(c_nationkey, '.5') ELSE CAST(c_nationkey AS VARCHAR) END AS rank, CAST(NULL AS VARCHAR) AS estimated_sales,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Dawn' ELSE 'Craft' END AS theme_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN concat(c_nationkey, '.0') END AS theme_version, concat('x,', c_mktsegment) AS categories, concat('Mail ', c_nationkey, ':Ads,Forms') AS apps, c_acctbal > 0 AS has_next_page FROM customer
    UNION ALL SELECT NULL, concat('p', c_custkey, '.host.pl'), 1, NULL, NULL, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), NULL, NULL, '', NULL, c_acctbal > 0 FROM customer""",
)
def read_store_feed(spark, sf):
    path = landing(spark, "feed")
    run_sql(spark, sf, RESPONSES).select("value").write.text(path)
    pages = spark.read.json(path).select("has_next_page", F.explode("domains").alias("d"))
    flags = pages.select(F.coalesce("d.name", "d.platform_domain").alias("_shop"), "has_next_page")
    shops = feed.read_store_feed(spark, path).withColumn("_shop", F.coalesce("name", "platform_domain"))
    listed = F.array_join(F.transform("apps", lambda a: F.concat(a["name"], F.lit(":"), F.array_join(a["categories"], ","))), ";")
    return shops.join(flags, "_shop").select(
        "name", "platform_domain", "pos", "merchant_name", "rank", "estimated_sales", "theme_name", "theme_version", F.array_join("categories", ",").alias("categories"), listed.alias("apps"), "has_next_page"
    )


ENTRIES = """
SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc, p_partkey AS k, concat('"theme ', CAST(p_partkey AS VARCHAR(20)), '": {"displayName": "', p_name, '", "architecture": "', CASE WHEN p_size > 40 THEN 'vintage' ELSE 'os2' END, '", "latest": {"version": "9.', CAST(p_size AS VARCHAR(9)), '", "releasedAt": ', CASE WHEN p_size > 5 THEN '"2024-05-06"' ELSE 'null' END, '}',
  CASE WHEN p_size < 10 THEN ', "releases": []' WHEN p_size < 12 THEN '' ELSE concat(', "releases": [{"version": "', CAST(p_size AS VARCHAR(9)), '.0", "releasedAt": "2026-01-', CASE WHEN p_size < 20 THEN '01' ELSE '20' END, '"}, {"version": "1.0", "releasedAt": "2025-01-01"}]') END, '}') AS entry
FROM {part}
"""


@registry.add(
    "read_theme_catalog",
    """WITH t AS (SELECT concat('theme ', p_partkey) AS theme_key, p_name AS display_name, CASE WHEN p_size > 40 THEN 'vintage' ELSE 'os2' END AS architecture, p_size, concat('2026-01-', CASE WHEN p_size < 20 THEN '01' ELSE '20' END) AS day FROM part)
    SELECT theme_key, display_name, architecture, CASE WHEN p_size < 12 THEN concat('9.', p_size) ELSE concat(p_size, '.0') END AS latest_version, CASE WHEN p_size <= 5 THEN NULL WHEN p_size < 12 THEN '2024-05-06' ELSE day END AS latest_released_at,
    pos, CASE pos WHEN 0 THEN concat(p_size, '.0') WHEN 1 THEN '1.0' END AS version, CASE pos WHEN 0 THEN day WHEN 1 THEN '2025-01-01' END AS released_at
    FROM (SELECT *, unnest(CASE WHEN p_size < 12 THEN [NULL] ELSE [0, 1] END) AS pos FROM t)""",
)
def read_theme_catalog(spark, sf):
    """A document holds 200 themes and is a file of its own."""
    path = landing(spark, "catalog")
    entries = run_sql(spark, sf, ENTRIES).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("entry")), ", ").alias("entries"))
    whole = entries.select("doc", F.concat(F.lit('{"updatedAt": "2026-09-01", "themes": {'), "entries", F.lit("}}")).alias("value"))
    whole.repartition("doc").write.partitionBy("doc").text(path)
    rows = catalog.read_theme_catalog(spark, os.path.join(path, "*"))
    return rows.withColumn("latest_released_at", F.col("latest_released_at").cast("string")).withColumn("released_at", F.col("released_at").cast("string"))


RELEASE_ROWS = """
SELECT l_orderkey AS theme_key, l_linenumber AS line, concat(CASE WHEN l_returnflag = 'A' THEN 'v' ELSE '' END, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '.0') AS tag_name, concat(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)), 'T08:00:00Z') AS published_at, l_tax > 0.07 AS prerelease, l_discount > 0.09 AS draft FROM {lineitem}
"""


@registry.add(
    "parse_release_feed",
    st.with_tables(
        """WITH n AS (SELECT *, row_number() OVER (PARTITION BY theme_key ORDER BY line, tag_name, published_at, prerelease, draft) AS p FROM r),
        f AS (SELECT theme_key, regexp_replace(tag_name, '^v', '') AS version, arg_min(substr(published_at, 1, 10), p) AS released_at, min(p) AS p FROM n WHERE NOT prerelease AND NOT draft GROUP BY 1, 2)
        SELECT theme_key, version, released_at, row_number() OVER (PARTITION BY theme_key ORDER BY released_at DESC, p) - 1 AS pos FROM f""",
        r=RELEASE_ROWS,
    ),
)
def parse_release_feed(spark, sf):
    """One release document per order, an item per line of it."""
    item = F.struct("line", "tag_name", "published_at", "prerelease", "draft")
    documents = run_sql(spark, sf, RELEASE_ROWS).groupBy("theme_key").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("releases_json"))
    return catalog.parse_release_feed(documents).withColumn("released_at", F.col("released_at").cast("string"))


SNAPSHOTS = "SELECT event_id, CASE WHEN value > 50 THEN 2 ELSE 1 END AS run_id, event_type AS source, props AS payload FROM {events}"


@registry.add("append_snapshots", st.with_tables("SELECT * FROM s", s=SNAPSHOTS))
def append_snapshots(spark, sf):
    """Two runs land one after the other; the history holds both."""
    path = landing(spark, "snapshots")
    rows = run_sql(spark, sf, SNAPSHOTS)
    for run in (1, 2):
        upserts.append_snapshots(rows.filter(F.col("run_id") == run), path)
    return spark.read.parquet(path).select("event_id", "run_id", "source", "payload")


FETCHES = "SELECT event_id, user_id, CASE event_type WHEN 'error' THEN CASE WHEN value > 60 THEN 429 WHEN value > 30 THEN 503 ELSE 403 END WHEN 'click' THEN 404 WHEN 'signup' THEN NULL ELSE 200 END AS status FROM {events}"


@registry.add("fetch_outcomes", st.with_tables("SELECT event_id, user_id, status, CASE WHEN status = 200 THEN 'ok' ELSE 'refused' END AS outcome FROM f WHERE status <> 404", f=FETCHES))
def fetch_outcomes(spark, sf):
    return walls.fetch_outcomes(run_sql(spark, sf, FETCHES))
