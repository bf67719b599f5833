"""Feed, theme and app queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retailscope.operators import ingest, stack
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, table
from retailscope.sources import catalog, feed

registry = Registry()

RAW_FEED = """
SELECT c_custkey AS pos,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN concat(' HTTPS://WWW.', replace(c_name, '#', '-'), '.Shop/path?x=1 ')
            WHEN 'BUILDING' THEN concat(replace(c_name, '#', '-'), '.shop.')
            WHEN 'FURNITURE' THEN concat('http://', replace(c_name, '#', '_'), '.shop')
            WHEN 'HOUSEHOLD' THEN concat('shop', CAST(c_nationkey AS VARCHAR(9)), '.test:8080/a')
            ELSE 'localhost' END AS name,
       CASE WHEN c_acctbal > 5000 THEN concat('p', CAST(c_nationkey AS VARCHAR(9)), '.host.test') ELSE 'n/a' END AS platform_domain,
       CASE WHEN c_nationkey < 5 THEN 'Unknown' ELSE concat('  ', c_name, ' ') END AS merchant_name,
       c_mktsegment AS title, concat(' Shop', CASE WHEN c_nationkey < 9 THEN 'A' ELSE 'B' END) AS platform,
       CASE WHEN c_nationkey = 3 THEN 'none' WHEN c_nationkey < 15 THEN 'de' ELSE 'fr' END AS country_code,
       CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR(20)) || '.5' END AS rank,
       CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR(20)) AS estimated_sales,
       CASE WHEN c_nationkey = 7 THEN '' ELSE CAST(c_nationkey AS VARCHAR(9)) END AS estimated_visits,
       CAST(c_nationkey AS VARCHAR(9)) AS product_count,
       c_mktsegment AS theme_name, CASE WHEN c_nationkey < 4 THEN ' Unknown ' ELSE '1.2' END AS theme_version
FROM {customer}
"""

HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^https?://', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '\.$', '')"


def _key(column: str) -> str:
    bare = f"regexp_replace({HOST.format(c=column)}, '^www\\.', '')"
    return (
        f"CASE WHEN NOT (regexp_matches(trim({column}), '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(lower(trim({column})), '^https?://')) "
        f"AND regexp_full_match({bare}, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+') "
        f"AND {bare} NOT IN ('localhost', 'example.com', 'example.org', 'example.net') THEN {bare} END"
    )


def _text(column: str) -> str:
    return f"CASE WHEN trim({column}) <> '' AND lower(trim({column})) NOT IN ('unknown', 'n/a', 'none') THEN trim({column}) END"


SHOP_ROWS = f"""
SELECT pos, domain, 'https://' || domain AS url, coalesce({_text('merchant_name')}, {_text('title')}) AS name,
       upper({_text('country_code')}) AS country, lower({_text('platform')}) AS platform,
       CAST(floor(try_cast(rank AS DOUBLE) + 0.5) AS BIGINT) AS rank,
       CAST(floor(try_cast(estimated_sales AS DOUBLE) + 0.5) AS BIGINT) AS revenue_estimate,
       CAST(floor(try_cast(estimated_visits AS DOUBLE) + 0.5) AS BIGINT) AS traffic_estimate,
       CAST(product_count AS BIGINT) AS products_count,
       {_text('theme_name')} AS theme_name, {_text('theme_version')} AS theme_version, domain IS NOT NULL AS usable
FROM (SELECT *, coalesce({_key('name')}, {_key('platform_domain')}) AS domain FROM raw_feed) f
"""
SHOP_COLUMNS = "pos domain url name country platform rank revenue_estimate traffic_estimate products_count theme_name theme_version usable".split()


def shop_rows(spark, sf):
    return feed.normalise_store_feed(run_sql(spark, sf, RAW_FEED)).select(*SHOP_COLUMNS)


registry.add("normalise_store_feed", st.with_tables(SHOP_ROWS, raw_feed=RAW_FEED))(shop_rows)


@registry.add(
    "feed_counts",
    st.with_tables(
        f"SELECT CAST(count(*) FILTER (usable) AS BIGINT) AS mapped, CAST(count(*) FILTER (NOT usable) AS BIGINT) AS skipped FROM ({SHOP_ROWS})",
        raw_feed=RAW_FEED,
    ),
)
def feed_counts(spark, sf):
    return feed.feed_counts(shop_rows(spark, sf))


@registry.add(
    "check_feed_filter",
    st.with_tables(
        """SELECT count(country_code) AS with_country, CAST(count(*) FILTER (upper(country_code) <> 'DE') AS BIGINT) AS wrong_country,
        count(platform) AS with_platform, CAST(count(*) FILTER (lower(platform) <> ' shopa') AS BIGINT) AS wrong_platform,
        count(*) FILTER (upper(country_code) <> 'DE') <= count(country_code) * 0.5 AS country_applied,
        count(*) FILTER (lower(platform) <> ' shopa') <= count(platform) * 0.5 AS platform_applied FROM raw_feed""",
        raw_feed=RAW_FEED,
    ),
)
def check_feed_filter(spark, sf):
    return feed.check_feed_filter(run_sql(spark, sf, RAW_FEED), "DE", " ShopA")


# Known shops: every domain the feed derives for the suppliers' nations.
KNOWN = """
SELECT DISTINCT concat('shop', CAST(s_nationkey AS VARCHAR(9)), '.test') AS domain FROM {supplier} WHERE s_acctbal > 3000
"""
LABELLED = f"""
SELECT f.*, CASE WHEN f.domain IS NULL THEN 'unusable'
                 WHEN k.domain IS NOT NULL OR f.pos <> min(f.pos) OVER (PARTITION BY f.domain) THEN 'duplicate'
                 ELSE 'new' END AS feed_label
FROM ({SHOP_ROWS}) f LEFT JOIN known k ON k.domain = f.domain
"""


@registry.add(
    "split_new_and_duplicate",
    st.with_tables(f"SELECT pos, domain, feed_label FROM ({LABELLED})", raw_feed=RAW_FEED, known=KNOWN),
)
def split_new_and_duplicate(spark, sf):
    shops = shop_rows(spark, sf)
    return ingest.split_new_and_duplicate(shops, run_sql(spark, sf, KNOWN)).select("pos", "domain", "feed_label")


BATCH = f"""
SELECT * FROM (SELECT l.*, sum(CASE WHEN feed_label = 'new' THEN 1 ELSE 0 END) OVER (ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new_before
               FROM ({LABELLED.replace(f'FROM ({SHOP_ROWS}) f', f'FROM (SELECT * FROM ({SHOP_ROWS}) WHERE pos >= 40) f')}) l)
WHERE coalesce(new_before, 0) < 60
"""


def _batch(spark, sf):
    return ingest.next_batch(shop_rows(spark, sf), run_sql(spark, sf, KNOWN), cursor=40, n=60)


@registry.add(
    "next_feed_batch",
    st.with_tables(f"SELECT pos, domain, feed_label FROM ({BATCH})", raw_feed=RAW_FEED, known=KNOWN),
)
def next_feed_batch(spark, sf):
    return _batch(spark, sf).select("pos", "domain", "feed_label")


@registry.add(
    "next_feed_cursor",
    st.with_tables(
        f"""SELECT max(pos) + 1 AS cursor_after, CAST(count(*) FILTER (feed_label = 'new') AS BIGINT) AS created,
        CAST(count(*) FILTER (feed_label = 'duplicate') AS BIGINT) AS duplicates,
        CAST(count(*) FILTER (feed_label = 'unusable') AS BIGINT) AS unusable,
        arg_max(rank, pos) FILTER (feed_label = 'new' AND rank IS NOT NULL) AS last_rank FROM ({BATCH})""",
        raw_feed=RAW_FEED,
        known=KNOWN,
    ),
)
def next_feed_cursor(spark, sf):
    return ingest.batch_cursor(_batch(spark, sf), cursor=40)


APP_LINES = """
SELECT l_orderkey AS store_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
       concat(CASE WHEN l_tax > 0.04 THEN ' App ' ELSE 'APP ' END, CAST(CAST(floor(l_discount * 30) AS BIGINT) AS VARCHAR(9))) AS name,
       CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'R' THEN 'removed' ELSE NULL END AS state,
       CASE WHEN l_quantity < 8 THEN 'unknown' WHEN l_quantity < 20 THEN ' Ads' WHEN l_quantity < 30 THEN 'Wishlists'
            WHEN l_quantity < 40 THEN 'Order Tracking' ELSE concat('cat ', l_linestatus) END AS category
FROM {lineitem}
"""
APP_ROWS = """
SELECT store_id, trim(name) AS name, CASE WHEN trim(category) NOT IN ('unknown', '') THEN trim(category) END AS category
FROM app_lines WHERE coalesce(lower(state), 'active') = 'active'
QUALIFY row_number() OVER (PARTITION BY store_id, lower(trim(name)) ORDER BY line, part_id, supp_id) = 1
"""


def app_rows(spark, sf):
    lines = run_sql(spark, sf, APP_LINES)
    # one feed record per order, whose lines are its apps
    records = lines.groupBy("store_id").agg(
        F.array_sort(
            F.collect_list(F.struct("line", "part_id", "supp_id", "name", "state", F.array("category").alias("categories")))
        ).alias("apps")
    )
    return feed.explode_store_apps(records, "store_id").drop("pos")


registry.add("explode_store_apps", st.with_tables(APP_ROWS, app_lines=APP_LINES))(app_rows)

GROUPED = """
SELECT l_suppkey AS store_id, l_orderkey AS id,
       CASE WHEN l_quantity < 8 THEN NULL WHEN l_quantity < 15 THEN ' ADS' WHEN l_quantity < 20 THEN 'wishlists'
            WHEN l_quantity < 26 THEN 'Order tracking' WHEN l_quantity < 30 THEN 'analytics'
            ELSE concat(' other ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9))) END AS category
FROM {lineitem}
"""
APP_STORES = "SELECT s_suppkey AS store_id, CAST(floor(s_acctbal) AS BIGINT) AS apps_count FROM {supplier}"
GROUP_CASE = """CASE lower(trim(category)) WHEN 'ads' THEN 'marketing' WHEN 'wishlists' THEN 'loyalty'
    WHEN 'order tracking' THEN 'tracking' WHEN 'analytics' THEN 'analytics' ELSE 'other' END"""


@registry.add(
    "map_app_groups",
    st.with_tables(f"SELECT {GROUP_CASE} AS app_group, count(*) AS n FROM apps GROUP BY 1", apps=GROUPED),
)
def map_app_groups(spark, sf):
    return stack.map_app_groups(run_sql(spark, sf, GROUPED)).groupBy("app_group").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "app_stack",
    st.with_tables(
        f"""SELECT s.store_id, coalesce(total, 0) AS total, coalesce(uncategorised, 0) AS uncategorised,
        coalesce(n_marketing, 0) AS n_marketing, coalesce(n_other, 0) AS n_other, coalesce(n_reviews, 0) AS n_reviews,
        greatest(coalesce(total, 0), coalesce(apps_count, 0)) AS counted,
        CASE WHEN greatest(coalesce(total, 0), coalesce(apps_count, 0)) <= 0 THEN NULL
             WHEN greatest(coalesce(total, 0), coalesce(apps_count, 0)) <= 5 THEN 'low'
             WHEN greatest(coalesce(total, 0), coalesce(apps_count, 0)) <= 12 THEN 'medium'
             WHEN greatest(coalesce(total, 0), coalesce(apps_count, 0)) <= 20 THEN 'high' ELSE 'very_high' END AS size,
        concat_ws(',', CASE WHEN n_marketing > 0 THEN 'marketing' END, CASE WHEN n_analytics > 0 THEN 'analytics' END,
                  CASE WHEN n_loyalty > 0 THEN 'loyalty' END, CASE WHEN n_tracking > 0 THEN 'tracking' END,
                  CASE WHEN n_other > 0 THEN 'other' END) AS groups_present
        FROM stores s LEFT JOIN (SELECT store_id, count(*) AS total,
            CAST(count(*) FILTER (category IS NULL) AS BIGINT) AS uncategorised,
            CAST(count(*) FILTER (g = 'marketing') AS BIGINT) AS n_marketing, CAST(count(*) FILTER (g = 'analytics') AS BIGINT) AS n_analytics,
            CAST(count(*) FILTER (g = 'loyalty') AS BIGINT) AS n_loyalty, CAST(count(*) FILTER (g = 'tracking') AS BIGINT) AS n_tracking,
            CAST(count(*) FILTER (g = 'reviews') AS BIGINT) AS n_reviews, CAST(count(*) FILTER (g = 'other') AS BIGINT) AS n_other
            FROM (SELECT *, {GROUP_CASE} AS g FROM apps) GROUP BY store_id) c ON c.store_id = s.store_id""",
        apps=GROUPED,
        stores=APP_STORES,
    ),
)
def app_stack(spark, sf):
    out = stack.app_stack(run_sql(spark, sf, GROUPED), run_sql(spark, sf, APP_STORES))
    return out.select(
        "store_id", "total", "uncategorised", "n_marketing", "n_other", "n_reviews", "counted", "size",
        F.array_join("groups_present", ",").alias("groups_present"),
    )


@registry.add(
    "other_app_categories",
    st.with_tables(
        f"SELECT store_id, trim(category) AS category, count(*) AS n FROM apps WHERE {GROUP_CASE} = 'other' AND category IS NOT NULL GROUP BY 1, 2",
        apps=GROUPED,
    ),
)
def other_app_categories(spark, sf):
    return stack.other_categories(run_sql(spark, sf, GROUPED))


ENTRIES = """
SELECT lower(concat('theme ', CAST(p_partkey AS VARCHAR(20)))) AS theme_key, concat('Theme ', CAST(p_partkey AS VARCHAR(20))) AS display_name,
       CASE p_type WHEN 'ECONOMY' THEN 'vintage' WHEN 'PROMO' THEN 'theme_blocks' WHEN 'LARGE' THEN NULL ELSE 'os2' END AS architecture,
       concat(CAST(p_size AS VARCHAR(9)), '.1') AS latest_version
FROM {part}
"""
RELEASES = """
SELECT theme_key, version, released_at, CAST(row_number() OVER (PARTITION BY theme_key ORDER BY released_at DESC, version) - 1 AS BIGINT) AS pos
FROM (SELECT concat('theme ', CAST(l_partkey AS VARCHAR(20))) AS theme_key,
             concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), '.', CAST(l_linenumber AS VARCHAR(9))) AS version,
             max(CAST(l_shipdate AS DATE)) AS released_at
      FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1, 2) r
"""
THEMED = """
SELECT o_orderkey AS store_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Homemade' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '  '
            ELSE concat(' Theme ', CAST(o_custkey AS VARCHAR(20))) END AS theme_name,
       CASE WHEN o_orderstatus = 'F' THEN NULL
            ELSE concat('v', CAST(CAST(floor(o_totalprice / 9000) AS BIGINT) AS VARCHAR(9)), '.', CAST(month(o_orderdate) AS VARCHAR(9))) END AS theme_version
FROM {orders}
"""
THEMED_PLAIN = THEMED.replace("concat('v', ", "concat('', ")


def _stale(themed: str) -> str:
    number = r"CAST(regexp_extract({v}, '^v?(\d+)(\.(\d+))?', 1) AS BIGINT) * 1000000 + coalesce(try_cast(regexp_extract({v}, '^v?(\d+)(\.(\d+))?', 3) AS BIGINT), 0)"
    cur, rel, latest = number.format(v="s.version"), number.format(v="r.version"), number.format(v="e.latest_version")
    return st.with_tables(
        f"""
        , shops AS (SELECT store_id, nullif(trim(theme_name), '') AS name, nullif(trim(theme_version), '') AS version FROM themed),
        heads AS (SELECT theme_key, arg_min(version, pos) AS newest, count(*) AS history FROM releases GROUP BY 1),
        ent AS (SELECT e.theme_key, display_name, architecture, coalesce(newest, latest_version) AS latest_version, coalesce(history, 0) AS history
                FROM entries e LEFT JOIN heads USING (theme_key)),
        facts AS (
            SELECT s.store_id, s.name, s.version, e.theme_key, display_name, architecture, e.latest_version, history,
                   CASE WHEN history > 0 AND s.version IS NOT NULL THEN
                     (SELECT count(*) FROM releases r WHERE r.theme_key = e.theme_key AND {rel} > {cur}) END AS gap,
                   CASE WHEN history > 0 THEN (SELECT arg_min(released_at, pos) FROM releases r WHERE r.theme_key = e.theme_key AND r.version = s.version) END AS released_at,
                   history = 0 AND s.version IS NOT NULL AND {latest} > {cur} AS behind
            FROM shops s LEFT JOIN ent e ON e.theme_key = lower(s.name)),
        aged AS (SELECT *, greatest((2026 - year(released_at)) * 12 + 9 - month(released_at) - CASE WHEN 1 < day(released_at) THEN 1 ELSE 0 END, 0) AS age FROM facts),
        lev AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(
                    CASE WHEN gap <= 0 THEN 0 WHEN gap <= 3 THEN 1 WHEN gap <= 8 THEN 2 WHEN gap <= 16 THEN 3 ELSE 4 END,
                    CASE WHEN age IS NULL OR released_at IS NULL THEN 0 WHEN age <= 6 THEN 0 WHEN age <= 12 THEN 1 WHEN age <= 24 THEN 2 WHEN age <= 48 THEN 3 ELSE 4 END)
                  WHEN behind THEN 1 END AS sig FROM aged),
        fin AS (SELECT *, CASE WHEN architecture = 'vintage' THEN greatest(coalesce(sig, 0), 3)
                   WHEN architecture = 'theme_blocks' THEN coalesce(sig, 0) ELSE sig END AS lvl FROM lev)
        SELECT store_id, coalesce(display_name, name) AS theme_name, version AS current_version, latest_version, gap AS version_gap,
               CASE WHEN released_at IS NOT NULL THEN age END AS age_months, architecture,
               CASE lvl WHEN 0 THEN 'fresh' WHEN 1 THEN 'slightly_outdated' WHEN 2 THEN 'outdated' WHEN 3 THEN 'very_outdated' WHEN 4 THEN 'severely_outdated' END AS freshness,
               theme_key IS NOT NULL AS catalogued FROM fin""".replace(", shops", "WITH shops", 1),
        entries=ENTRIES,
        releases=RELEASES,
        themed=themed,
    )


STALE_COLUMNS = "store_id theme_name current_version latest_version version_gap age_months architecture freshness catalogued".split()


def _staleness(spark, sf, themed):
    return stack.theme_staleness(
        run_sql(spark, sf, themed), run_sql(spark, sf, ENTRIES), run_sql(spark, sf, RELEASES), dt.date(2026, 9, 1)
    ).select(*STALE_COLUMNS)


@registry.add("theme_staleness", _stale(THEMED))
def theme_staleness(spark, sf):
    return _staleness(spark, sf, THEMED)


@registry.add("theme_staleness_exact_release", _stale(THEMED_PLAIN))
def theme_staleness_exact_release(spark, sf):
    return _staleness(spark, sf, THEMED_PLAIN)


OLD_CATALOG = "SELECT p_partkey AS theme_key, p_brand AS version, CAST(p_size AS BIGINT) AS releases FROM {part} WHERE p_type <> 'LARGE'"
NEW_CATALOG = """SELECT p_partkey AS theme_key, CASE WHEN p_retailprice < 1500 THEN p_brand ELSE p_type END AS version,
CAST(CASE WHEN p_size < 45 THEN p_size ELSE 1 END AS BIGINT) AS releases, CASE WHEN p_size = 20 THEN 'HTTP 404' END AS error
FROM {part} WHERE p_type <> 'SMALL'"""


@registry.add(
    "diff_snapshots",
    st.with_tables(
        """SELECT coalesce(o.theme_key, n.theme_key) AS theme_key, o.version AS version_before,
        CASE WHEN n.theme_key IS NULL OR n.error IS NOT NULL THEN o.version ELSE n.version END AS version_after,
        CASE WHEN n.theme_key IS NULL OR n.error IS NOT NULL THEN o.releases ELSE n.releases END AS releases,
        n.theme_key IS NOT NULL AND n.error IS NULL AND (o.version IS DISTINCT FROM n.version OR o.releases IS DISTINCT FROM n.releases) AS changed, n.error
        FROM o FULL JOIN n ON o.theme_key = n.theme_key""",
        o=OLD_CATALOG,
        n=NEW_CATALOG,
    ),
)
def diff_snapshots(spark, sf):
    return ingest.diff_snapshots(run_sql(spark, sf, OLD_CATALOG), run_sql(spark, sf, NEW_CATALOG), "theme_key")


RELEASE_ITEMS = """
SELECT concat('theme ', CAST(o_custkey AS VARCHAR(20))) AS theme_key, o_orderkey AS pos,
       concat(CASE WHEN o_orderstatus = 'F' THEN 'v' WHEN o_orderstatus = 'O' THEN 'V' ELSE '' END, CAST(month(o_orderdate) AS VARCHAR(9))) AS tag_name,
       CASE WHEN o_totalprice < 20000 THEN NULL ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 'T10:00:00Z') END AS published_at,
       o_orderpriority = '5-LOW' AS prerelease, CASE WHEN o_orderpriority = '2-HIGH' THEN false ELSE NULL END AS draft
FROM {orders}
"""


@registry.add(
    "clean_releases",
    st.with_tables(
        """SELECT theme_key, version, CAST(released_at AS VARCHAR) AS released_at, row_number() OVER (PARTITION BY theme_key ORDER BY released_at DESC, p) - 1 AS pos
        FROM (SELECT theme_key, regexp_replace(tag_name, '^[vV]', '') AS version, arg_min(substr(published_at, 1, 10), pos) AS released_at, min(pos) AS p
              FROM items WHERE NOT prerelease AND published_at IS NOT NULL GROUP BY 1, 2)""",
        items=RELEASE_ITEMS,
    ),
)
def clean_releases(spark, sf):
    return catalog.clean_releases(run_sql(spark, sf, RELEASE_ITEMS)).withColumn("released_at", F.col("released_at").cast("string"))
