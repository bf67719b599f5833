"""Shop list queries: overview, filters, sorts, pages and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.operators import overview as ov
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql

registry = Registry()

OVERVIEW_RELATIONS = {
    "stores": st.STORES,
    "analyses": st.ANALYSES,
    "issues": st.ISSUES,
    "letters": st.LETTERS,
    "contacts": st.CONTACTS,
}

# One aggregate per shop and side; a side's best row is the greatest of its sort values.
OVERVIEW_BODY = """
WITH verdict AS (
  SELECT store_id, arg_max(struct_pack(c := category, p := lead_score), id) AS best FROM analyses WHERE agent = 'lead_classifier' GROUP BY store_id
), mail AS (
  SELECT store_id, arg_max(struct_pack(v := status), version) AS newest FROM letters GROUP BY store_id
), found AS (
  SELECT store_id, CAST(sum(CAST(severity = 'CRITICAL' AS INT)) AS BIGINT) AS n_critical, CAST(sum(CAST(severity = 'MAJOR' AS INT)) AS BIGINT) AS n_major FROM issues GROUP BY store_id
), reach AS (
  SELECT store_id,
    arg_max(struct_pack(n := name, r := role, m := email, k := confidence), struct_pack(a := is_primary, b := confidence, c := -id)) FILTER (NOT is_generic) AS person,
    arg_max(linkedin_url, struct_pack(a := linkedin_url LIKE '%/in/%', b := is_primary, c := confidence, d := -id)) FILTER (linkedin_url IS NOT NULL) AS profile,
    string_agg(email, ' ' ORDER BY id) FILTER (is_generic AND email IS NOT NULL) AS boxes,
    count(email) FILTER (is_generic) AS n_boxes
  FROM contacts GROUP BY store_id
)
SELECT stores.*, verdict.best.c AS category, verdict.best.p AS lead_score, coalesce(n_critical, 0) AS critical_issues, coalesce(n_major, 0) AS major_issues,
  mail.newest.v AS email_status, person.n AS contact_name, person.r AS contact_role, person.m AS contact_email, person.k AS contact_confidence,
  profile AS contact_linkedin, boxes AS generic_emails, coalesce(n_boxes, 0) AS generic_count
FROM stores LEFT JOIN verdict ON verdict.store_id = stores.id LEFT JOIN mail ON mail.store_id = stores.id
  LEFT JOIN found ON found.store_id = stores.id LEFT JOIN reach ON reach.store_id = stores.id
"""
OVERVIEW_SQL = st.with_tables(OVERVIEW_BODY, **OVERVIEW_RELATIONS)


def relation(name):
    return lambda spark, sf: run_sql(spark, sf, name)


def overview(spark, sf):
    return ov.store_overview(*[run_sql(spark, sf, t) for t in OVERVIEW_RELATIONS.values()])


registry.add("store_overview", OVERVIEW_SQL)(overview)


def _over(tail: str, select: str = "*") -> str:
    return st.with_tables(f"SELECT {select} FROM ({OVERVIEW_BODY}) o {tail}", **OVERVIEW_RELATIONS)


@registry.add(
    "filter_stores",
    _over(
        """WHERE lower(domain) LIKE '%000000%' AND rank >= 100 AND rank <= 9000 AND coalesce(lead_score, 0) >= 5
        AND coalesce(lead_score, 0) <= 95 AND revenue_estimate >= 20000 AND revenue_estimate <= 95000000
        AND critical_issues + major_issues >= 1 AND critical_issues + major_issues <= 5000""",
        "id, domain, rank, lead_score, critical_issues, major_issues",
    ),
)
def filter_stores(spark, sf):
    kept = ov.filter_stores(
        overview(spark, sf), domain="000000", rank_min=100, rank_max=9000, score_min=5, score_max=95,
        revenue_min=200, revenue_max=950000, issues_min=1, issues_max=5000,
    )
    return kept.select("id", "domain", "rank", "lead_score", "critical_issues", "major_issues")


@registry.add(
    "filter_stores_by_state",
    _over(
        "WHERE status = 'AUDITED' AND email_status = 'READY' AND category = 'POOR_UX'",
        "id, status, email_status, category",
    ),
)
def filter_stores_by_state(spark, sf):
    kept = ov.filter_stores(overview(spark, sf), status="AUDITED", email="READY", category="POOR_UX")
    return kept.select("id", "status", "email_status", "category")


@registry.add("filter_stores_by_severity", _over("WHERE major_issues > 0", "id, critical_issues, major_issues"))
def filter_stores_by_severity(spark, sf):
    return ov.filter_stores(overview(spark, sf), severity="MAJOR").select("id", "critical_issues", "major_issues")


@registry.add(
    "sort_stores_page",
    _over("ORDER BY lead_score DESC NULLS LAST, id LIMIT 20 OFFSET 20", "id, domain, lead_score"),
)
def sort_stores_page(spark, sf):
    return ov.page_of(overview(spark, sf), "score", "desc", page=2)[0].select("id", "domain", "lead_score")


@registry.add(
    "sort_stores_by_issues",
    _over(
        "ORDER BY critical_issues * 1000 + major_issues ASC, id LIMIT 200",
        "id, critical_issues, major_issues",
    ),
)
def sort_stores_by_issues(spark, sf):
    return ov.page_of(overview(spark, sf), "issues", "asc", size=500)[0].select("id", "critical_issues", "major_issues")


@registry.add(
    "page_after_store",
    _over("WHERE lead_score IS NULL OR lead_score < 60 OR lead_score = 60 AND id > 10 ORDER BY lead_score DESC NULLS LAST, id LIMIT 50", "id, lead_score"),
)
def page_after_store(spark, sf):
    return ov.page_after(overview(spark, sf), 10, 60, "score", "desc", size=50).select("id", "lead_score")


@registry.add(
    "recent_runs",
    st.with_tables("SELECT id, status FROM runs ORDER BY id DESC LIMIT 50", runs=st.RUNS),
)
def recent_runs(spark, sf):
    return ov.recent_runs(run_sql(spark, sf, st.RUNS)).select("id", "status")


@registry.add(
    "severity_counts",
    st.with_tables(
        """SELECT store_id, CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical_issues,
        CAST(sum(CASE WHEN severity = 'MAJOR' THEN 1 ELSE 0 END) AS BIGINT) AS major_issues,
        CAST(sum(CASE WHEN severity = 'MINOR' THEN 1 ELSE 0 END) AS BIGINT) AS minor_issues
        FROM issues GROUP BY store_id""",
        issues=st.ISSUES,
    ),
)
def severity_counts(spark, sf):
    return ov.severity_counts(run_sql(spark, sf, st.ISSUES))


@registry.add(
    "latest_audit_severity_counts",
    st.with_tables(
        """SELECT store_id, CAST(count(*) FILTER (severity = 'CRITICAL') AS BIGINT) AS critical_issues,
        CAST(count(*) FILTER (severity = 'MAJOR') AS BIGINT) AS major_issues,
        CAST(count(*) FILTER (severity = 'MINOR') AS BIGINT) AS minor_issues
        FROM issues i WHERE audit_id = (SELECT max(audit_id) FROM issues j WHERE j.store_id = i.store_id)
        GROUP BY store_id""",
        issues=st.ISSUES,
    ),
)
def latest_audit_severity_counts(spark, sf):
    return ov.severity_counts(ov.latest_audit_issues(run_sql(spark, sf, st.ISSUES)))


@registry.add(
    "latest_analysis_per_store",
    st.with_tables(
        """SELECT store_id, agent, arg_max(id, id) AS id, arg_max(lead_score, id) AS lead_score
        FROM analyses GROUP BY store_id, agent""",
        analyses=st.ANALYSES,
    ),
)
def latest_analysis_per_store(spark, sf):
    rows = run_sql(spark, sf, st.ANALYSES).select("store_id", "agent", "id", "lead_score")
    return ov.latest_per_key(rows, ["store_id", "agent"], ["id"])


@registry.add(
    "best_person",
    st.with_tables(
        """SELECT store_id, id, name, confidence FROM contacts WHERE NOT is_generic
        QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY is_primary DESC, confidence DESC, id) = 1""",
        contacts=st.CONTACTS,
    ),
)
def best_person(spark, sf):
    return ov.best_person(run_sql(spark, sf, st.CONTACTS)).select("store_id", "id", "name", "confidence")


@registry.add(
    "best_profile_link",
    st.with_tables(
        """SELECT store_id, id, linkedin_url FROM contacts WHERE linkedin_url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY (linkedin_url LIKE '%/in/%') DESC,
            is_primary DESC, confidence DESC, id) = 1""",
        contacts=st.CONTACTS,
    ),
)
def best_profile_link(spark, sf):
    return ov.best_profile_link(run_sql(spark, sf, st.CONTACTS)).select("store_id", "id", "linkedin_url")


@registry.add(
    "shared_inboxes",
    st.with_tables(
        """SELECT store_id, CAST(floor((rn - 1) / 2) AS BIGINT) AS part, string_agg(email, ' ' ORDER BY rn) AS generic_emails,
        count(*) AS generic_count
        FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY id) AS rn
              FROM contacts WHERE is_generic AND email IS NOT NULL)
        GROUP BY store_id, floor((rn - 1) / 2)""",
        contacts=st.CONTACTS,
    ),
)
def shared_inboxes(spark, sf):
    return ov.shared_inboxes(run_sql(spark, sf, st.CONTACTS), per_part=2).withColumn(
        "generic_count", F.col("generic_count").cast("bigint")
    )


@registry.add("letter_status_counts", st.with_tables("SELECT status, count(*) AS n FROM letters GROUP BY status", letters=st.LETTERS))
def letter_status_counts(spark, sf):
    return ov.status_counts(run_sql(spark, sf, st.LETTERS))


@registry.add(
    "distinct_categories",
    st.with_tables("SELECT DISTINCT category FROM analyses WHERE category IS NOT NULL", analyses=st.ANALYSES),
)
def distinct_categories(spark, sf):
    return ov.distinct_values(run_sql(spark, sf, st.ANALYSES), "category")
