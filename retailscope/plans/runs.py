"""Run log, work selection and status queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retailscope.operators import runs, selection, states
from retailscope.operators.keyed import id_slice
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql
from retailscope.sources import speed

registry = Registry()

FINAL = """
SELECT * FROM step_logs WHERE status <> 'RUNNING'
QUALIFY row_number() OVER (PARTITION BY run_id, step, store_id ORDER BY attempt DESC, id DESC) = 1
"""


def _tok(name: str) -> str:
    upper = name[0].upper() + name[1:]
    number = lambda path: (
        f"CASE WHEN json_type(m, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(m, '{path}') AS DOUBLE) ELSE 0 END"
    )
    listed = (
        "list_sum(list_transform(CAST(json_extract(m, '$.usage') AS JSON[]), "
        f"lambda e: CASE WHEN json_type(e, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(e, '$.{name}') AS DOUBLE) ELSE 0 END))"
    )
    plain = " + ".join(number(f"$.{k}") for k in (name, f"qc{upper}", f"search{upper}"))
    return f"CAST(CASE WHEN m IS NULL THEN 0 WHEN json_type(m, '$.usage') = 'ARRAY' THEN {listed} ELSE {plain} END AS BIGINT)"


USED = f"""
SELECT *, {_tok('tokensIn')} AS tokens_in, {_tok('tokensOut')} AS tokens_out
FROM (SELECT *, CASE WHEN json_valid(meta_json) THEN CAST(meta_json AS JSON) END AS m FROM {{rel}})
"""


def logs(spark, sf):
    return run_sql(spark, sf, st.STEP_LOGS)


@registry.add("parse_usage_meta", st.with_tables(f"SELECT id, tokens_in, tokens_out FROM ({USED.format(rel='step_logs')})", step_logs=st.STEP_LOGS))
def parse_usage_meta(spark, sf):
    return runs.parse_usage_meta(logs(spark, sf)).select("id", "tokens_in", "tokens_out")


@registry.add("final_attempts", st.with_tables(f"SELECT id, run_id, step, store_id, status FROM ({FINAL})", step_logs=st.STEP_LOGS))
def final_attempts(spark, sf):
    return runs.final_attempts(logs(spark, sf)).select("id", "run_id", "step", "store_id", "status")


COUNTS = """CAST(count(*) FILTER (status = 'OK') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'FAILED') AS BIGINT) AS failed,
CAST(count(*) FILTER (status NOT IN ('OK', 'FAILED')) AS BIGINT) AS skipped, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS duration_ms,
CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out"""


@registry.add(
    "run_report",
    st.with_tables(f"SELECT run_id, step, {COUNTS} FROM ({USED.format(rel=f'({FINAL})')}) GROUP BY run_id, step", step_logs=st.STEP_LOGS),
)
def run_report(spark, sf):
    return runs.run_report(logs(spark, sf)).drop("step_rank")


@registry.add(
    "run_totals",
    st.with_tables(
        f"""SELECT run_id, step, {COUNTS}, grouping(step) = 1 AS is_total FROM ({USED.format(rel=f'({FINAL})')})
        GROUP BY GROUPING SETS ((run_id, step), (run_id))""",
        step_logs=st.STEP_LOGS,
    ),
)
def run_totals(spark, sf):
    return runs.run_totals(logs(spark, sf))


@registry.add(
    "failed_stores",
    st.with_tables(
        f"""SELECT run_id, step, CAST(floor((rn - 1) / 5) AS BIGINT) AS part, string_agg(CAST(store_id AS VARCHAR), ',' ORDER BY rn) AS failed_stores,
        count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY store_id) AS rn FROM ({FINAL}) WHERE status = 'FAILED')
        GROUP BY run_id, step, floor((rn - 1) / 5)""",
        step_logs=st.STEP_LOGS,
    ),
)
def failed_stores(spark, sf):
    rows = runs.failed_stores(logs(spark, sf), per_part=5)
    text = F.array_join(F.transform("failed_stores", lambda s: s.cast("string")), ",")
    return rows.withColumn("failed_stores", text).withColumn("n", F.col("n").cast("bigint"))


@registry.add(
    "error_histogram",
    st.with_tables(
        f"SELECT run_id, step, error AS message, count(*) AS n FROM ({FINAL}) WHERE status = 'FAILED' AND error IS NOT NULL GROUP BY 1, 2, 3",
        step_logs=st.STEP_LOGS,
    ),
)
def error_histogram(spark, sf):
    return runs.error_histogram(logs(spark, sf))


@registry.add(
    "completed_stores",
    st.with_tables(
        f"SELECT run_id, store_id FROM ({FINAL}) EXCEPT SELECT run_id, store_id FROM ({FINAL}) WHERE status = 'FAILED'",
        step_logs=st.STEP_LOGS,
    ),
)
def completed_stores(spark, sf):
    return runs.completed_stores(logs(spark, sf))


@registry.add(
    "last_failures",
    st.with_tables(
        """SELECT store_id, step, error FROM step_logs WHERE id IN (SELECT max(id) FROM step_logs GROUP BY store_id, step) AND status = 'FAILED'""",
        step_logs=st.STEP_LOGS,
    ),
)
def last_failures(spark, sf):
    return runs.last_failures(logs(spark, sf)).select("store_id", "step", "error")


@registry.add(
    "active_stores",
    st.with_tables(
        """SELECT id, domain, rank FROM stores WHERE status NOT IN ('APPROVED', 'SKIPPED', 'DUPLICATE')
        AND id IN (SELECT store_id FROM run_stores WHERE run_id = 1997)""",
        stores=st.STORES,
        run_stores=st.RUN_STORES,
    ),
)
def active_stores(spark, sf):
    return selection.active_stores(run_sql(spark, sf, st.STORES), run_sql(spark, sf, st.RUN_STORES), 1997).select("id", "domain", "rank")


ASKED = """SELECT concat('https://www.Customer-', right(concat('000000000', CAST(s_suppkey * 40 AS VARCHAR(20))), 9), '.shop/about') AS domain FROM {supplier}"""
ASKED_KEY = "regexp_replace(regexp_replace(lower(domain), '^https://www\\.', ''), '/.*$', '')"


@registry.add(
    "restrict_to_domains",
    st.with_tables(f"SELECT id, domain FROM stores WHERE domain IN (SELECT {ASKED_KEY} FROM asked)", stores=st.STORES, asked=ASKED),
)
def restrict_to_domains(spark, sf):
    return selection.restrict_to_domains(run_sql(spark, sf, st.STORES), run_sql(spark, sf, ASKED))[0].select("id", "domain")


@registry.add(
    "domains_not_active",
    st.with_tables(
        f"SELECT DISTINCT {ASKED_KEY} AS domain FROM asked WHERE {ASKED_KEY} NOT IN (SELECT domain FROM stores)", stores=st.STORES, asked=ASKED
    ),
)
def domains_not_active(spark, sf):
    return selection.restrict_to_domains(run_sql(spark, sf, st.STORES), run_sql(spark, sf, ASKED))[1]


MEASURED = """
SELECT o_custkey AS store_id, CASE WHEN o_orderstatus = 'F' THEN 'mobile' ELSE 'desktop' END AS strategy,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'unreadable' ELSE CAST(max(o_orderdate) AS VARCHAR(30)) END AS fetched_at
FROM {orders} GROUP BY 1, 2, o_orderpriority
"""
SHOPS = "SELECT c_custkey AS store_id, concat('c', CAST(c_custkey AS VARCHAR(20)), '.shop') AS domain FROM {customer}"
NOW = dt.datetime(2001, 8, 1)
STALE = """
SELECT s.store_id, t.strategy FROM stores s, (VALUES ('mobile'), ('desktop')) t(strategy)
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.store_id = s.store_id AND r.strategy = t.strategy
                  AND try_cast(fetched_at AS TIMESTAMP) > TIMESTAMP '2001-08-01' - INTERVAL 200 DAY)
"""


def _stale(spark, sf):
    return selection.stale_measurements(run_sql(spark, sf, SHOPS), run_sql(spark, sf, MEASURED), NOW, ttl_days=200)


@registry.add("stale_measurements", st.with_tables(STALE, stores=SHOPS, results=MEASURED))
def stale_measurements(spark, sf):
    return _stale(spark, sf)


@registry.add(
    "plan_requests",
    st.with_tables(f"SELECT * FROM ({STALE}) ORDER BY store_id, strategy LIMIT 200", stores=SHOPS, results=MEASURED),
)
def plan_requests(spark, sf):
    return selection.plan_requests(_stale(spark, sf), [F.col("store_id"), F.col("strategy")])[0]


@registry.add(
    "refused_requests",
    st.with_tables(
        f"SELECT *, 'request budget spent (200 per run)' AS reason FROM ({STALE}) ORDER BY store_id, strategy OFFSET 200",
        stores=SHOPS,
        results=MEASURED,
    ),
)
def refused_requests(spark, sf):
    return selection.plan_requests(_stale(spark, sf), [F.col("store_id"), F.col("strategy")])[1]


COOLDOWNS = """
SELECT concat('c', CAST(user_id AS VARCHAR(20)), '.shop') AS domain, max(ts) AS blocked_until, count(*) AS strikes
FROM {events} WHERE event_type = 'error' GROUP BY user_id
"""
COOL_NOW = dt.datetime(2024, 1, 30)


@registry.add(
    "stores_free_to_visit",
    st.with_tables(
        "SELECT store_id FROM stores WHERE domain NOT IN (SELECT domain FROM cooldowns WHERE blocked_until > TIMESTAMP '2024-01-30')",
        stores=SHOPS,
        cooldowns=COOLDOWNS,
    ),
)
def stores_free_to_visit(spark, sf):
    return selection.gate_cooling_domains(run_sql(spark, sf, SHOPS), run_sql(spark, sf, COOLDOWNS), COOL_NOW)[0].select("store_id")


@registry.add(
    "stores_cooling",
    st.with_tables(
        """SELECT store_id, strikes, epoch_us(blocked_until) // 1000 - epoch_us(TIMESTAMP '2024-01-30') // 1000 AS ms_remaining
        FROM stores JOIN cooldowns USING (domain) WHERE blocked_until > TIMESTAMP '2024-01-30'""",
        stores=SHOPS,
        cooldowns=COOLDOWNS,
    ),
)
def stores_cooling(spark, sf):
    cooling = selection.gate_cooling_domains(run_sql(spark, sf, SHOPS), run_sql(spark, sf, COOLDOWNS), COOL_NOW)[1]
    return cooling.select("store_id", "strikes", "ms_remaining")


AUDITS = """
SELECT o_orderkey AS id, o_custkey AS store_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'OK' WHEN '2-HIGH' THEN 'PARTIAL' WHEN '3-MEDIUM' THEN 'BLOCKED' ELSE 'FAILED' END AS status,
       o_orderdate AS finished_at
FROM {orders}
"""
READINGS = """
SELECT o_orderkey AS id, o_custkey AS store_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'FAILED' ELSE 'OK' END AS status, o_orderdate AS created_at
FROM {orders} WHERE o_orderstatus <> 'P'
"""
NEWEST = "(SELECT * FROM {rel} QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY {col} DESC) = 1)"


@registry.add(
    "pending_audits",
    st.with_tables(
        f"SELECT store_id FROM stores WHERE store_id NOT IN (SELECT store_id FROM {NEWEST.format(rel='audits', col='id')} WHERE status IN ('OK', 'PARTIAL', 'BLOCKED'))",
        stores=SHOPS,
        audits=AUDITS,
    ),
)
def pending_audits(spark, sf):
    return selection.pending_audits(run_sql(spark, sf, SHOPS), run_sql(spark, sf, AUDITS)).select("store_id")


@registry.add(
    "pending_analyses",
    st.with_tables(
        f"""SELECT s.store_id FROM stores s LEFT JOIN {NEWEST.format(rel='readings', col='id')} r ON r.store_id = s.store_id
        LEFT JOIN {NEWEST.format(rel='audits', col='id')} a ON a.store_id = s.store_id
        WHERE r.id IS NULL OR r.status <> 'OK' OR coalesce(a.finished_at > r.created_at, false)""",
        stores=SHOPS,
        audits=AUDITS,
        readings=READINGS,
    ),
)
def pending_analyses(spark, sf):
    return selection.pending_analyses(
        run_sql(spark, sf, SHOPS), run_sql(spark, sf, READINGS), run_sql(spark, sf, AUDITS)
    ).select("store_id")


FEW_CONTACTS = "SELECT user_id * 2 AS store_id FROM {events}"


@registry.add(
    "pending_contacts",
    st.with_tables("SELECT store_id FROM stores WHERE store_id NOT IN (SELECT store_id FROM c)", stores=SHOPS, c=FEW_CONTACTS),
)
def pending_contacts(spark, sf):
    return selection.pending_contacts(run_sql(spark, sf, SHOPS), run_sql(spark, sf, FEW_CONTACTS)).select("store_id")


DRAFTS = st.LETTERS.replace("WHEN 'F' THEN 'SKIPPED'", "WHEN 'F' THEN 'QC_FAILED'")


@registry.add(
    "pending_letters",
    st.with_tables(
        f"SELECT store_id FROM stores WHERE store_id NOT IN (SELECT store_id FROM {NEWEST.format(rel='letters', col='version')} WHERE status IN ('READY', 'APPROVED', 'SKIPPED'))",
        stores=SHOPS,
        letters=DRAFTS,
    ),
)
def pending_letters(spark, sf):
    return selection.pending_letters(run_sql(spark, sf, SHOPS), run_sql(spark, sf, DRAFTS)).select("store_id")


HISTORY = """
SELECT user_id AS entity_id, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'AUDITED' WHEN 'click' THEN 'ANALYZED' WHEN 'purchase' THEN 'CONTACTED' ELSE 'FAILED' END AS status
FROM {events}
"""


@registry.add(
    "check_transitions",
    st.with_tables(
        """SELECT entity_id, seq, p AS from_status, status AS to_status
        FROM (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY seq) AS p FROM history)
        WHERE p IS NOT NULL AND p <> status AND NOT (
            (p = 'NEW' AND status IN ('AUDITED', 'SKIPPED', 'DUPLICATE', 'FAILED')) OR (p = 'AUDITED' AND status IN ('ANALYZED', 'SKIPPED', 'FAILED'))
            OR (p = 'ANALYZED' AND status IN ('CONTACTED', 'SKIPPED', 'FAILED')) OR (p = 'CONTACTED' AND status IN ('EMAIL_READY', 'SKIPPED', 'FAILED'))
            OR (p = 'FAILED' AND status IN ('NEW', 'AUDITED', 'ANALYZED', 'CONTACTED', 'EMAIL_READY', 'SKIPPED')))""",
        history=HISTORY,
    ),
)
def check_transitions(spark, sf):
    return states.check_transitions(run_sql(spark, sf, HISTORY), "store", id_slice("seq", 1000))


ENTITIES = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'DRAFT' ELSE 'APPROVED' END AS status,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'old note' END AS status_reason
FROM {orders}
"""
CHANGES = """
SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'SKIPPED' WHEN 'purchase' THEN 'APPROVED' WHEN 'click' THEN 'DRAFT' ELSE 'READY' END AS to_status, event_id AS seq,
       ts AS changed_at, CASE WHEN value > 50 THEN props END AS note
FROM {events}
"""
LETTER_MOVE = """(f.status = c.to_status OR (f.status = 'DRAFT' AND c.to_status IN ('READY', 'QC_FAILED', 'SKIPPED')) OR (f.status = 'QC_FAILED' AND c.to_status IN ('DRAFT', 'SKIPPED'))
  OR (f.status = 'READY' AND c.to_status IN ('APPROVED', 'SKIPPED', 'DRAFT')) OR (f.status = 'SKIPPED' AND c.to_status = 'DRAFT'))"""
FOLDED = f"""
WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, to_status, changed_at, note) AS n FROM changes),
fold AS (
  SELECT id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, status AS from_status, status AS to_status, status, status_reason, true AS legal FROM entities
  UNION ALL
  SELECT id, n, seq, status, to_status, CASE WHEN legal THEN to_status ELSE status END, CASE WHEN legal THEN coalesce(note, status_reason) ELSE status_reason END, legal
  FROM (SELECT c.id, c.n, c.seq, f.status, c.to_status, f.status_reason, c.note, {LETTER_MOVE} AS legal
        FROM fold f JOIN numbered c ON c.id = f.id AND c.n = f.n + 1)
)
"""


@registry.add(
    "apply_status_changes",
    st.with_tables(f"{FOLDED} SELECT id, status, status_reason FROM fold QUALIFY n = max(n) OVER (PARTITION BY id)", entities=ENTITIES, changes=CHANGES),
)
def apply_status_changes(spark, sf):
    return states.apply_status_changes(run_sql(spark, sf, ENTITIES), run_sql(spark, sf, CHANGES), "letter", "status_reason")[0]


@registry.add(
    "refused_status_changes",
    st.with_tables(
        f"""{FOLDED} SELECT id, seq, from_status, to_status, 'illegal' AS refusal FROM fold WHERE NOT legal
        UNION ALL SELECT c.id, c.seq, NULL, c.to_status, 'not found' FROM changes c WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = c.id)""",
        entities=ENTITIES,
        changes=CHANGES,
    ),
)
def refused_status_changes(spark, sf):
    return states.apply_status_changes(run_sql(spark, sf, ENTITIES), run_sql(spark, sf, CHANGES), "letter")[1]


@registry.add(
    "mark_abandoned_runs",
    st.with_tables(
        """SELECT id, CASE WHEN status = 'RUNNING' AND id <> 7 THEN 'FAILED' ELSE status END AS status,
        CASE WHEN status = 'RUNNING' AND id <> 7 THEN 'abandoned: the process that started this run is gone' END AS error FROM runs""",
        runs=st.RUNS,
    ),
)
def mark_abandoned_runs(spark, sf):
    table = run_sql(spark, sf, st.RUNS).withColumn("finished_at", F.lit(None).cast("timestamp")).withColumn("error", F.lit(None).cast("string"))
    return states.mark_abandoned(table, 7, F.lit(dt.datetime(2024, 1, 1))).select("id", "status", "error")


REPORTS = """
SELECT l_orderkey AS store_id, l_linenumber AS n, CASE WHEN l_linestatus = 'O' THEN 'mobile' ELSE 'desktop' END AS strategy,
       concat('{"lighthouseResult": {"finalUrl": "https://s/', CAST(l_partkey AS VARCHAR(20)), '", "runtimeError": {"code": "',
              CASE WHEN l_returnflag = 'R' THEN 'ERRORED_DOCUMENT_REQUEST' ELSE 'NO_ERROR' END,
              '"}, "categories": {"performance": {"score": ', CASE WHEN l_discount > 0.05 THEN '1' ELSE '0' END, '}, "seo": {"score": null}}, "audits": {',
              '"first-contentful-paint": {"numericValue": ', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)),
              CASE WHEN l_returnflag = 'A' THEN ', "scoreDisplayMode": "error"' ELSE '' END, '}, ',
              '"server-response-time": {"numericValue": ', CAST(CAST(l_quantity AS INT) - 10 AS VARCHAR(20)), '}}}',
              CASE WHEN l_tax > 0.04 THEN concat(', "originLoadingExperience": {"metrics": {"INTERACTION_TO_NEXT_PAINT": {"percentile": ', CAST(l_suppkey AS VARCHAR(20)), '}}}') ELSE '' END,
              CASE WHEN l_tax > 0.06 THEN concat(', "loadingExperience": {"metrics": {"EXPERIMENTAL_TIME_TO_FIRST_BYTE": {"percentile": ', CAST(l_linenumber AS VARCHAR(20)), '}}}') ELSE '' END,
              '}') AS raw_json,
       l_partkey AS part_id, l_suppkey AS supp_id, CAST(floor(l_extendedprice) AS BIGINT) AS fcp, CAST(CAST(l_quantity AS INT) - 10 AS BIGINT) AS ttfb,
       CAST(CASE WHEN l_discount > 0.05 THEN 100 ELSE 0 END AS BIGINT) AS perf, l_returnflag AS flag, l_tax AS tax, CAST(l_linenumber AS BIGINT) AS field_ttfb
FROM {lineitem}
"""


@registry.add(
    "parse_speed_reports",
    st.with_tables(
        """SELECT store_id, strategy, concat('https://s/', CAST(part_id AS VARCHAR)) AS url, perf AS performance, CAST(NULL AS BIGINT) AS seo,
        CASE WHEN flag <> 'A' THEN fcp END AS fcp_ms, CASE WHEN tax > 0.04 THEN supp_id END AS inp_ms,
        CASE WHEN tax > 0.06 THEN field_ttfb WHEN ttfb >= 0 THEN ttfb END AS ttfb_ms,
        CASE WHEN tax > 0.06 THEN 'field' WHEN ttfb >= 0 THEN 'lab' END AS ttfb_source, tax > 0.04 AS has_field_data,
        CASE WHEN flag = 'R' THEN 'ERRORED_DOCUMENT_REQUEST' END AS runtime_error FROM reports""",
        reports=REPORTS,
    ),
)
def parse_speed_reports(spark, sf):
    return speed.parse_speed_reports(run_sql(spark, sf, REPORTS)).select(
        "store_id", "strategy", "url", "performance", "seo", "fcp_ms", "inp_ms", "ttfb_ms", "ttfb_source", "has_field_data", "runtime_error"
    )
