"""Keyed write queries: upserts, replacement, versions, exports, erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql
from retailscope.sources import exports, upserts

registry = Registry()

TARGET = """
SELECT c_custkey AS k, c_mktsegment AS a, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS b, c_name AS c FROM {customer} WHERE c_acctbal < 6000
"""
SOURCE = """
SELECT o_custkey AS k, o_orderkey AS seq, o_orderpriority AS a, CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INT) END AS b,
       CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS c
FROM {orders} WHERE o_totalprice > 30000
"""


@registry.add(
    "upsert_mixed_policy",
    st.with_tables(
        """SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NOT NULL THEN t.a ELSE s.a END AS a, CASE WHEN s.k IS NOT NULL THEN s.b ELSE t.b END AS b,
        coalesce(s.c, t.c) AS c
        FROM target t FULL JOIN (SELECT k, (array_agg(a ORDER BY seq))[1] AS a, (array_agg(b ORDER BY seq DESC))[1] AS b,
                 (array_agg(c ORDER BY seq DESC) FILTER (c IS NOT NULL))[1] AS c FROM source GROUP BY k) s ON s.k = t.k""",
        target=TARGET,
        source=SOURCE,
    ),
)
def upsert_mixed_policy(spark, sf):
    return upserts.upsert(
        run_sql(spark, sf, TARGET), run_sql(spark, sf, SOURCE), ["k"],
        {"a": upserts.INSERT_ONLY, "b": upserts.OVERWRITE, "c": upserts.KEEP_IF_NULL}, order="seq",
    )


REPLACED = """SELECT s_suppkey AS store_id, s_suppkey + 1000000 AS id, s_name AS name FROM {supplier}"""
HELD = "SELECT o_custkey AS store_id, o_orderkey AS id, o_orderpriority AS name FROM {orders}"


@registry.add(
    "replace_by_key",
    st.with_tables(
        "SELECT * FROM held WHERE store_id NOT IN (SELECT store_id FROM fresh) UNION ALL SELECT * FROM fresh", held=HELD, fresh=REPLACED
    ),
)
def replace_by_key(spark, sf):
    return upserts.replace_by_key(run_sql(spark, sf, HELD), run_sql(spark, sf, REPLACED), "store_id")


LETTERS = """
SELECT store_id, id, version, subject, CASE status WHEN 'SKIPPED' THEN 'QC_FAILED' ELSE status END AS status
FROM (SELECT o_custkey AS store_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
             o_orderpriority AS subject, CASE o_orderstatus WHEN 'F' THEN 'SKIPPED' WHEN 'O' THEN 'READY' ELSE 'APPROVED' END AS status
      FROM {orders} WHERE o_orderdate < DATE '1999-01-01') l
"""
DRAFTS = """
SELECT o_custkey AS store_id, o_orderkey AS id, o_orderkey AS seq, o_orderpriority AS subject, CASE o_orderstatus WHEN 'F' THEN 'DRAFT' ELSE 'READY' END AS status
FROM {orders} WHERE o_orderdate >= DATE '1999-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
"""


@registry.add(
    "append_versioned_letters",
    st.with_tables(
        """SELECT store_id, id, version, CASE WHEN next_id IS NOT NULL AND status IN ('DRAFT', 'QC_FAILED', 'READY') AND (is_draft OR next_is_draft) THEN 'SKIPPED' ELSE status END AS status
        FROM (SELECT store_id, id, status, is_draft, row_number() OVER w AS version, lead(id) OVER w AS next_id, lead(is_draft) OVER w AS next_is_draft
              FROM (SELECT store_id, id, status, version, false AS is_draft FROM letters UNION ALL SELECT store_id, id, status, seq, true FROM drafts)
              WINDOW w AS (PARTITION BY store_id ORDER BY is_draft, version))""",
        letters=LETTERS,
        drafts=DRAFTS,
    ),
)
def append_versioned_letters(spark, sf):
    target = run_sql(spark, sf, LETTERS).withColumn("version", F.col("version").cast("bigint"))
    return upserts.append_versioned(target, run_sql(spark, sf, DRAFTS)).select("store_id", "id", "version", "status")


APPROVED = """
SELECT e.id, s.domain, c.name AS contact_name, c.role AS contact_role, c.email AS contact_email, e.subject, e.body, e.category,
       (SELECT arg_max(a.lead_score, a.id) FROM analyses a WHERE a.store_id = e.store_id AND a.agent = 'lead_classifier') AS lead_score,
       e.word_count, e.version, e.created_at
FROM letters e JOIN stores s ON s.id = e.store_id LEFT JOIN contacts c ON c.id = e.contact_id WHERE e.status = 'APPROVED'
"""
RELATIONS = {"letters": st.LETTERS, "stores": st.STORES, "contacts": st.CONTACTS, "analyses": st.ANALYSES}


def _approved(spark, sf):
    return exports.approved_letters(*[run_sql(spark, sf, RELATIONS[n]) for n in ("letters", "stores", "contacts", "analyses")])


@registry.add("approved_letters", st.with_tables(f"SELECT * EXCLUDE (created_at) FROM ({APPROVED})", **RELATIONS))
def approved_letters(spark, sf):
    return _approved(spark, sf).drop("created_at")


def _cell(name: str) -> str:
    text = f"coalesce(CAST({name} AS VARCHAR), '')"
    return f"""'"' || replace(CASE WHEN regexp_matches({text}, '^[=+@\\t\\r-]') THEN '''' || {text} ELSE {text} END, '"', '""') || '"'"""


@registry.add(
    "export_lines",
    st.with_tables(
        "SELECT id, " + " || ',' || ".join(_cell(c) for c in exports.EXPORT_COLUMNS.values()) + f" AS line FROM ({APPROVED})",
        **{**RELATIONS, "letters": st.LETTERS.replace("concat('Offer ', o_orderpriority)", """concat('=1+"', o_orderpriority, '"')""")},
    ),
)
def export_lines(spark, sf):
    letters = run_sql(spark, sf, st.LETTERS.replace("concat('Offer ', o_orderpriority)", """concat('=1+"', o_orderpriority, '"')"""))
    approved = exports.approved_letters(letters, *[run_sql(spark, sf, RELATIONS[n]) for n in ("stores", "contacts", "analyses")])
    return exports.export_lines(approved)
