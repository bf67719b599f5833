"""Shop relations read from the provided tables.

The provided tables hold no shops, so each relation of the domain is a plain
projection of one of them. The text is SQL that Spark and an ANSI engine read
alike; ``{table}`` names a provided table.
"""

from __future__ import annotations

STORES = """
SELECT c_custkey AS id,
       concat(lower(replace(c_name, '#', '-')), '.shop') AS domain,
       CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS rank,
       CAST(round(c_acctbal * 100) AS BIGINT) AS revenue_estimate,
       CASE WHEN c_acctbal > 500 THEN CAST(floor(c_acctbal * 17) AS BIGINT) END AS traffic_estimate,
       CAST(c_nationkey AS BIGINT) AS products_count,
       c_nationkey AS nation_key,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'NEW' WHEN 'BUILDING' THEN 'AUDITED'
            WHEN 'FURNITURE' THEN 'ANALYZED' WHEN 'HOUSEHOLD' THEN 'SKIPPED' ELSE 'FAILED' END AS status
FROM {customer}
"""

ANALYSES = """
SELECT o_orderkey AS id, o_custkey AS store_id, o_orderkey AS audit_id,
       CASE WHEN o_orderstatus = 'P' THEN 'store_analyst' ELSE 'lead_classifier' END AS agent,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'OUTDATED_THEME' WHEN '2-HIGH' THEN 'POOR_UX'
            WHEN '3-MEDIUM' THEN 'LOW_CONVERSION_DESIGN' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'SKIP' END AS category,
       CAST(floor(o_totalprice / 5100) AS INT) AS lead_score,
       CASE WHEN o_orderkey > 5000 THEN 'v2' ELSE 'v1' END AS prompt_version,
       o_orderdate AS created_at
FROM {orders}
"""

ISSUES = """
SELECT event_id AS id, user_id AS store_id, CAST(floor(event_id / 1000) AS BIGINT) AS audit_id,
       CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'MAJOR' ELSE 'MINOR' END AS severity,
       CASE WHEN value < 20 THEN 'home' WHEN value < 60 THEN 'product' WHEN value < 120 THEN 'cart' ELSE 'checkout' END AS page,
       CASE WHEN value < 40 THEN 'SEO' ELSE 'UX' END AS category,
       concat('Finding ', props) AS title,
       CASE WHEN event_type = 'view' THEN NULL ELSE concat('seen by ', event_type) END AS detail,
       props AS evidence_text,
       'audit' AS source,
       ts AS created_at
FROM {events}
"""

LETTERS = """
SELECT o_orderkey AS id, o_custkey AS store_id, o_orderkey AS contact_id, o_orderkey AS version,
       CASE o_orderstatus WHEN 'F' THEN 'SKIPPED' WHEN 'O' THEN 'READY' ELSE 'APPROVED' END AS status,
       concat('Offer ', o_orderpriority) AS subject,
       concat('Dear shop, order ', CAST(o_orderkey AS VARCHAR(20))) AS body,
       CAST(floor(o_totalprice / 4000) AS INT) AS word_count,
       o_orderpriority AS category,
       o_orderdate AS created_at
FROM {orders}
"""

CONTACTS = """
SELECT o_orderkey AS id, o_custkey AS store_id,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE concat('Person ', CAST(CAST(floor(o_totalprice / 700) AS BIGINT) AS VARCHAR(20))) END AS name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CEO' WHEN '2-HIGH' THEN 'Founder'
            WHEN '3-MEDIUM' THEN 'Owner' END AS role,
       CASE WHEN o_totalprice < 400000
            THEN concat('box', CAST(CAST(floor(o_totalprice / 300) AS BIGINT) AS VARCHAR(20)), '@mail',
                        CAST(CAST(floor(o_totalprice / 40000) AS BIGINT) AS VARCHAR(20)), '.shop') END AS email,
       CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW')
            THEN concat('https://www.linkedin.com/',
                        CASE WHEN o_orderstatus = 'F' THEN 'company/c' ELSE 'in/p' END,
                        CAST(o_orderkey AS VARCHAR(20))) END AS linkedin_url,
       'role_text' AS source,
       concat('https://shop/', CAST(o_orderkey AS VARCHAR(20))) AS source_url,
       floor(o_totalprice / 5100) / 100 AS confidence,
       o_orderpriority = '4-NOT SPECIFIED' AS is_generic,
       o_orderstatus = 'P' AS is_primary,
       o_orderdate AS created_at
FROM {orders}
"""

RUN_STORES = """
SELECT o_custkey AS store_id, CAST(year(o_orderdate) AS BIGINT) AS run_id
FROM {orders} GROUP BY o_custkey, year(o_orderdate)
"""

RUNS = """
SELECT o_orderkey AS id,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status,
       o_orderdate AS started_at
FROM {orders}
"""

SUPPRESSIONS = """
SELECT s_suppkey AS id,
       CASE WHEN s_acctbal < 4000 THEN concat('box', CAST(s_suppkey * 7 AS VARCHAR(20)), '@mail',
            CAST(CAST(floor(s_suppkey * 7 * 300 / 40000) AS BIGINT) AS VARCHAR(20)), '.shop') END AS email,
       CASE WHEN s_acctbal >= 4000 AND s_acctbal < 7000 THEN concat('mail', CAST(s_nationkey AS VARCHAR(20)), '.shop')
            WHEN s_acctbal >= 7000 THEN lower(replace(replace(s_name, 'Supplier', 'customer'), '#', '-')) || '.shop' END AS domain,
       'erasure_request' AS reason
FROM {supplier}
"""

STEP_LOGS = """
SELECT event_id AS id, CAST(floor(event_id / 2500) AS BIGINT) AS run_id, user_id AS store_id,
       CASE WHEN value < 10 THEN 'fetch_stores' WHEN value < 30 THEN 'audit' WHEN value < 60 THEN 'pagespeed'
            WHEN value < 100 THEN 'ai_analysis' ELSE 'contact_search' END AS step,
       CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SKIPPED' WHEN 'signup' THEN 'RUNNING' ELSE 'OK' END AS status,
       CASE WHEN event_type = 'purchase' THEN 0 ELSE CAST(floor(value) AS INT) % 4 + 1 END AS attempt,
       ts AS started_at,
       CASE WHEN event_type = 'signup' THEN NULL ELSE ts END AS finished_at,
       CAST(floor(value * 1000) AS BIGINT) AS duration_ms,
       CASE WHEN event_type = 'error' THEN concat('HTTP ', CAST(400 + CAST(floor(value) AS INT) % 9 AS VARCHAR(5))) END AS error,
       CASE WHEN value < 30 THEN replace(replace(props, 'k', 'tokensIn'), '}', ', "qcTokensOut": 3}')
            WHEN value < 60 THEN concat('{"usage": [', replace(props, 'k', 'tokensIn'), ', {"tokensOut": 5}, 7]}')
            WHEN value < 100 THEN concat(props, ' broken') ELSE replace(props, 'k', 'searchTokensIn') END AS meta_json
FROM {events}
"""


def with_tables(sql: str, **relations: str) -> str:
    """SQL for the comparison engine: relations as CTEs over the plain tables."""
    from retailscope.session import TABLES

    def plain(text: str) -> str:
        for name in TABLES:
            text = text.replace("{" + name + "}", name)
        return text

    ctes = ", ".join(f"{name} AS ({plain(text)})" for name, text in relations.items())
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE '):]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
