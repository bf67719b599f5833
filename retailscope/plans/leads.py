"""Lead score, context, letters and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.operators import answers, documents, letters, runs, scoring
from retailscope.plans import grading, standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, spread

registry = Registry()

SIGNALS = """
SELECT o_orderkey AS store_id, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice * 6) AS BIGINT) END AS revenue_estimate,
       CASE WHEN o_orderpriority <> '2-HIGH' THEN CAST(floor(o_totalprice / 2) AS BIGINT) END AS traffic_estimate, CASE WHEN o_orderstatus = 'P' THEN month(o_orderdate) / 20.0 - 0.3 END AS growth_rate,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(month(o_orderdate) % 4 AS BIGINT) END AS critical_issues, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(month(o_orderdate) % 5 AS BIGINT) END AS major_issues,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(month(o_orderdate) AS BIGINT) END AS minor_issues, o_totalprice < 30000 AS blocked, CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice / 5100) AS INT) END AS mobile_performance,
       CASE WHEN o_orderstatus <> 'F' THEN CAST(month(o_orderdate) * 4 AS INT) END AS theme_age_months,
       CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'OK' END AS audit_status, 'boom' AS audit_error, 200 AS home_status, 4 AS pages_seen, CASE WHEN o_totalprice > 400000 THEN 0 ELSE 3 END AS pages_ok, 9 AS products_count
FROM {orders}
"""
PARTS = """
SELECT *, CASE WHEN revenue_estimate <= 10000 THEN 0.0 WHEN revenue_estimate >= 2000000 THEN 1.0 WHEN revenue_estimate IS NOT NULL THEN ln(revenue_estimate / 10000.0::DOUBLE) / ln(2000000.0::DOUBLE / 10000.0::DOUBLE) END AS v1,
    CASE WHEN critical_issues IS NOT NULL AND NOT blocked THEN least(1.0::DOUBLE, (critical_issues * 4 + major_issues * 2 + minor_issues * 0.5::DOUBLE) / 20.0::DOUBLE) END AS v2,
    CASE WHEN traffic_estimate <= 1000 THEN 0.0 WHEN traffic_estimate >= 200000 THEN 1.0 WHEN traffic_estimate IS NOT NULL THEN ln(traffic_estimate / 1000.0::DOUBLE) / ln(200000.0::DOUBLE / 1000.0::DOUBLE) END AS v3,
    1 - mobile_performance / 100.0::DOUBLE AS v4, CASE WHEN growth_rate <= -0.2 THEN 0.0 WHEN growth_rate >= 0.5 THEN 1.0 WHEN growth_rate IS NOT NULL THEN (growth_rate::DOUBLE + 0.2::DOUBLE) / 0.7::DOUBLE END AS v5,
    least(1.0::DOUBLE, theme_age_months / 36.0::DOUBLE) AS v6 FROM f
"""
WEIGHTED = f"""
SELECT *, coalesce(v1 * 0.25::DOUBLE, 0) + coalesce(v2 * 0.25::DOUBLE, 0) + coalesce(v3 * 0.15::DOUBLE, 0) + coalesce(v4 * 0.15::DOUBLE, 0) + coalesce(v5 * 0.1::DOUBLE, 0) + CASE WHEN theme_age_months IS NULL THEN 0 ELSE v6 * 0.1::DOUBLE END AS w,
    CASE WHEN v1 IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN v2 IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN v3 IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN v4 IS NULL THEN 0 ELSE 0.15::DOUBLE END
    + CASE WHEN v5 IS NULL THEN 0 ELSE 0.1::DOUBLE END + CASE WHEN theme_age_months IS NULL THEN 0 ELSE 0.1::DOUBLE END AS cov FROM ({PARTS})
"""
SCORE = "CAST(CASE WHEN cov = 0 THEN 0 ELSE floor(w / cov * 100 + 0.5) END AS INT)"
PRIORITY = f"CASE WHEN {SCORE} >= 70 THEN 'HIGH' WHEN {SCORE} >= 45 THEN 'MEDIUM' ELSE 'LOW' END"


@registry.add("lead_score", st.with_tables(f"SELECT store_id, {SCORE} AS lead_score, floor(cov * 100 + 0.5) / 100 AS coverage, {PRIORITY} AS priority FROM ({WEIGHTED})", f=SIGNALS))
def lead_score(spark, sf):
    scored = scoring.lead_score(run_sql(spark, sf, SIGNALS))
    return scored.select("store_id", "lead_score", (F.floor(F.col("coverage") * 100 + 0.5) / 100).alias("coverage"), scoring.priority(F.col("lead_score")).alias("priority"))


ANSWERS = """
SELECT o_orderkey AS store_id, o_orderkey AS audit_id, 1 AS attempt,
       CASE o_orderpriority WHEN '1-URGENT' THEN concat('{"category": "UX_PROBLEMS", "priority": "LOW", "reason": "r', CAST(o_orderkey AS VARCHAR(20)), '"}') WHEN '2-HIGH' THEN '{"category": "SKIP", "priority": "LOW", "reason": "x"}'
            WHEN '3-MEDIUM' THEN '{"category": 5, "priority": "HIGH", "reason": ""}' WHEN '4-NOT SPECIFIED' THEN 'no json' ELSE '{"category": "GROWING_STORE", "priority": "HIGH", "reason": "ok"}' END AS text, o_orderpriority AS pr
FROM {orders}
"""
JUDGED = """
SELECT *, CASE pr WHEN '2-HIGH' THEN 'category: not an allowed value' WHEN '3-MEDIUM' THEN 'category: not an allowed value; reason: must not be empty' WHEN '4-NOT SPECIFIED' THEN 'not JSON' END AS problem,
CASE pr WHEN '1-URGENT' THEN 'UX_PROBLEMS' WHEN '5-LOW' THEN 'GROWING_STORE' END AS category FROM a
"""


def _judged(spark, sf):
    checked = answers.validate_answers(run_sql(spark, sf, ANSWERS), "classifier")
    for name in ("category", "priority", "reason"):
        checked = checked.withColumn(name, F.try_variant_get("document", f"$.{name}", "string"))
    return checked


@registry.add("validate_answers", st.with_tables(f"SELECT store_id, problem IS NULL AS valid, problem FROM ({JUDGED})", a=ANSWERS))
def validate_answers(spark, sf):
    return answers.validate_answers(run_sql(spark, sf, ANSWERS), "classifier").select("store_id", "valid", "problem")


SKIP = """CASE WHEN blocked THEN NULL WHEN audit_status = 'FAILED' THEN 'x' WHEN pages_ok = 0 THEN 'x' WHEN revenue_estimate < 10000 AND traffic_estimate < 1000 THEN 'x' END"""


@registry.add(
    "classify_leads",
    st.with_tables(
        f"""SELECT store_id, CASE WHEN s IS NOT NULL THEN 'SKIP' ELSE category END AS category, CASE WHEN s IS NOT NULL THEN 'LOW' WHEN category IS NOT NULL THEN p END AS priority, lead_score,
        CASE WHEN s IS NULL AND category IS NOT NULL THEN CASE pr WHEN '1-URGENT' THEN 'LOW' ELSE 'HIGH' END END AS model_priority, s IS NULL AND category IS NULL AS unanswered
        FROM (SELECT store_id, {SKIP} AS s, {SCORE} AS lead_score, {PRIORITY} AS p FROM ({WEIGHTED})) JOIN (SELECT store_id, category, pr FROM ({JUDGED})) USING (store_id)""",
        f=SIGNALS,
        a=ANSWERS,
    ),
)
def classify_leads(spark, sf):
    return scoring.classify_leads(run_sql(spark, sf, SIGNALS), _judged(spark, sf)).drop("reason")


ANALYST = """
SELECT l_orderkey AS store_id, l_orderkey AS audit_id, l_linenumber AS attempt, l_partkey AS part_id, l_suppkey AS supp_id,
       concat('{"issues": [{"evidenceId": ', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_tax > 0.07 THEN '.5' ELSE '' END, ', "page": "', CASE WHEN l_discount > 0.08 THEN 'blog' ELSE 'cart' END,
              '", "category": "ux", "severity": "MAJOR", "title": "t", "impact": "i"}], "scores": {"ux": ', CAST(CAST(floor(l_quantity * 3) AS INT) AS VARCHAR(9)), ', "cro": -4, "seo": 50.5, "performance": ', CASE WHEN l_returnflag = 'R' THEN '"9"' ELSE '9' END,
              '}, "signals": {"strengths": ["s"], "momentum": "", "insufficientEvidence": false}}') AS text, l_tax AS tax, l_discount AS disc, l_returnflag AS flag, l_quantity AS qty
FROM {lineitem}
"""
CITED = "SELECT p_partkey AS id, p_size AS size FROM {part} WHERE p_size > 20"


def _analyst(spark, sf):
    return answers.validate_answers(run_sql(spark, sf, ANALYST), "analyst")


@registry.add(
    "validate_analyst_answers",
    st.with_tables(
        """SELECT store_id, attempt, part_id, supp_id, nullif(concat_ws('; ', CASE WHEN tax > 0.07 OR disc > 0.08 THEN concat('issues.0.', concat_ws('; ', CASE WHEN tax > 0.07 THEN 'evidenceId: expected a whole number' END, CASE WHEN disc > 0.08 THEN 'page: not an allowed value' END)) END,
        CASE WHEN flag = 'R' THEN 'scores.performance: expected a number' END), '') AS problem FROM a""",
        a=ANALYST,
    ),
)
def validate_analyst_answers(spark, sf):
    return _analyst(spark, sf).select("store_id", "attempt", "part_id", "supp_id", "problem")


@registry.add(
    "clamped_scores",
    st.with_tables("SELECT store_id, CAST(least(100, floor(qty * 3)) AS INT) AS score_ux, 0 AS score_cro, 51 AS score_seo, 9 AS score_performance FROM a WHERE NOT (tax > 0.07 OR disc > 0.08 OR flag = 'R')", a=ANALYST),
)
def clamped_scores(spark, sf):
    return answers.clamped_scores(_analyst(spark, sf))


@registry.add(
    "ground_findings",
    st.with_tables("SELECT audit_id, part_id AS evidence_id, severity FROM (SELECT *, 'MAJOR' AS severity FROM a) WHERE NOT (tax > 0.07 OR disc > 0.08 OR flag = 'R') AND part_id IN (SELECT id FROM i)", a=ANALYST, i=CITED),
)
def ground_findings(spark, sf):
    found = answers.explode_findings(_analyst(spark, sf))
    known = run_sql(spark, sf, CITED).select("id").join(found.select(F.col("evidence_id").alias("id"), "audit_id").distinct(), "id")
    return answers.ground_findings(found, known)[0].select("audit_id", "evidence_id", "severity")


@registry.add(
    "dropped_findings",
    st.with_tables("SELECT audit_id, part_id AS evidence_id, 'unknown-evidence-id' AS reason FROM a WHERE NOT (tax > 0.07 OR disc > 0.08 OR flag = 'R') AND part_id NOT IN (SELECT id FROM i)", a=ANALYST, i=CITED),
)
def dropped_findings(spark, sf):
    found = answers.explode_findings(_analyst(spark, sf))
    known = run_sql(spark, sf, CITED).select("id").join(found.select(F.col("evidence_id").alias("id"), "audit_id").distinct(), "id")
    return answers.ground_findings(found, known)[1].select("audit_id", "evidence_id", "reason")


@registry.add(
    "compare_prompt_versions",
    st.with_tables(
        """WITH n AS (SELECT store_id, prompt_version, arg_max(lead_score, id) AS s FROM analyses GROUP BY 1, 2) SELECT store_id, max(s) FILTER (prompt_version = 'v1') AS v1, max(s) FILTER (prompt_version = 'v2') AS v2 FROM n GROUP BY 1""",
        analyses=st.ANALYSES,
    ),
)
def compare_prompt_versions(spark, sf):
    side = scoring.compare_prompt_versions(run_sql(spark, sf, st.ANALYSES), ["v1", "v2"])
    return side.select("store_id", F.col("v1_lead_score").alias("v1"), F.col("v2_lead_score").alias("v2"))


IMAGES = """
SELECT o_custkey AS audit_id, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'homepage' WHEN '2-HIGH' THEN 'cart' ELSE 'product' END AS page, CASE WHEN o_orderstatus = 'F' THEN 'mobile' ELSE 'desktop' END AS viewport,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'a-full.png' ELSE 'a.png' END AS path, CASE WHEN o_totalprice > 450000 THEN 9000 ELSE 800 END AS height, CASE WHEN o_totalprice > 20000 THEN CAST(floor(o_totalprice * 10) AS BIGINT) END AS bytes FROM {orders}
"""
IMAGE_ISSUES = "SELECT user_id AS audit_id, event_id AS id, CASE WHEN value < 30 THEN 'homepage' ELSE 'cart' END AS page, CASE event_type WHEN 'error' THEN 'CRITICAL' ELSE 'MINOR' END AS severity FROM {events} WHERE value > 20"


def _images(spark, sf):
    return scoring.select_images(run_sql(spark, sf, IMAGES), run_sql(spark, sf, IMAGE_ISSUES))


GREEDY = """
WITH RECURSIVE w AS (SELECT audit_id, page, min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END) AS worst FROM i GROUP BY 1, 2),
r AS (SELECT m.audit_id, m.id, m.bytes, m.viewport, row_number() OVER (PARTITION BY m.audit_id ORDER BY coalesce(worst, 3), m.viewport <> 'mobile', CASE m.page WHEN 'homepage' THEN 1 WHEN 'product' THEN 3 ELSE 4 END, m.id) AS rn
      FROM m LEFT JOIN w USING (audit_id, page) WHERE path NOT LIKE '%-full.png' AND height <= 4000 AND bytes IS NOT NULL),
g AS (SELECT audit_id, id, rn, CASE WHEN bytes <= 4000000 THEN bytes ELSE 0 END AS used, CASE WHEN bytes <= 4000000 THEN 1 ELSE 0 END AS n, bytes <= 4000000 AS taken FROM r WHERE rn = 1
      UNION ALL SELECT r.audit_id, r.id, r.rn, g.used + CASE WHEN g.n < 4 AND g.used + r.bytes <= 4000000 THEN r.bytes ELSE 0 END, g.n + CASE WHEN g.n < 4 AND g.used + r.bytes <= 4000000 THEN 1 ELSE 0 END, g.n < 4 AND g.used + r.bytes <= 4000000
      FROM g JOIN r ON r.audit_id = g.audit_id AND r.rn = g.rn + 1)
"""
IMAGE_RELATIONS = {"m": IMAGES, "i": IMAGE_ISSUES}


def _recursive(tail: str) -> str:
    return "WITH RECURSIVE " + st.with_tables(GREEDY.replace("WITH RECURSIVE", "WITH") + tail, **IMAGE_RELATIONS)[5:]


@registry.add("select_images", _recursive("SELECT audit_id, id, CAST(n AS INT) AS image_no FROM g WHERE taken"))
def select_images(spark, sf):
    return _images(spark, sf)[0].select("audit_id", "id", "image_no")


@registry.add(
    "skipped_images",
    _recursive(
        """SELECT m.audit_id, m.id, CASE WHEN path LIKE '%-full.png' THEN 'full-page' WHEN height > 4000 THEN 'too-tall' WHEN f.at IS NOT NULL AND (coalesce(w.worst, 3), m.viewport <> 'mobile', CASE m.page WHEN 'homepage' THEN 1 WHEN 'product' THEN 3 ELSE 4 END, m.id) > f.at THEN 'over-limit'
        WHEN bytes IS NULL THEN 'unreadable' ELSE 'over-budget' END AS reason FROM m LEFT JOIN w USING (audit_id, page)
        LEFT JOIN (SELECT g.audit_id, (coalesce(w.worst, 3), m.viewport <> 'mobile', CASE m.page WHEN 'homepage' THEN 1 WHEN 'product' THEN 3 ELSE 4 END, m.id) AS at FROM g JOIN m ON m.id = g.id LEFT JOIN w ON w.audit_id = m.audit_id AND w.page = m.page WHERE taken AND n = 4) f ON f.audit_id = m.audit_id
        WHERE m.id NOT IN (SELECT id FROM g WHERE taken)"""
    ),
)
def skipped_images(spark, sf):
    return _images(spark, sf)[1]


# ------------------------------------------------------------------ documents

C_STORES = "SELECT c_custkey AS id, concat('shop', CAST(c_custkey AS VARCHAR(20)), '.pl') AS domain, c_name AS name, CASE WHEN c_nationkey < 5 THEN NULL ELSE 'PL' END AS country, CAST(c_nationkey AS BIGINT) AS rank, CAST(round(c_acctbal * 100) AS BIGINT) AS revenue_estimate, CAST(c_nationkey AS BIGINT) AS traffic_estimate, CASE WHEN c_acctbal > 1000 THEN CAST(c_nationkey AS BIGINT) END AS products_count FROM {customer}"
C_THEMES = "SELECT c_custkey AS store_id, concat('Theme ', CAST(c_nationkey AS VARCHAR(9))) AS name, '1.0' AS current_version, '2.0' AS latest_version, 3 AS version_gap, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS age_months, 'os2' AS architecture, 'outdated' AS freshness FROM {customer} WHERE c_mktsegment <> 'BUILDING'"
C_APPS = "SELECT c_custkey AS store_id, c_nationkey AS total, CASE WHEN c_nationkey > 5 THEN 'low' END AS size, c_name AS app FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"
C_SPEED = "SELECT o_custkey AS store_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'mobile' WHEN 'O' THEN 'desktop' ELSE 'tablet' END AS strategy, CASE WHEN o_totalprice > 50000 THEN CAST(floor(o_totalprice / 5100) AS INT) END AS performance, 50 AS seo, CAST(floor(o_totalprice / 100) AS BIGINT) AS lcp_ms, CAST(0.25 AS DOUBLE) AS cls, CAST(NULL AS BIGINT) AS inp_ms FROM {orders}"
C_AUDITS = "SELECT event_id AS id, user_id AS store_id, 'OK' AS status, false AS blocked, CAST(NULL AS VARCHAR(9)) AS error FROM (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS event_id, user_id FROM {events} GROUP BY 1, 2) e"
CONTEXT_RELATIONS = {"stores": C_STORES, "audits": C_AUDITS, "issues": st.ISSUES, "speed": C_SPEED}


def contexts(spark, sf, max_bytes=documents.CONTEXT_BYTES):
    audits = run_sql(spark, sf, C_AUDITS)
    pages = audits.select(
        F.col("id").alias("audit_id"), F.lit(0).alias("page_no"), F.lit("homepage").alias("page"), F.lit("mobile").alias("viewport"), F.lit("https://s").alias("url"), F.lit("ok").alias("availability"),
        F.lit(200).alias("http_status"), F.lit(5).alias("run"), F.lit(1).alias("failed"), F.array(F.struct(F.lit("home.nav").alias("name"), F.lit("boom").alias("error"))).alias("failed_checks"), F.lit("facts " * 20).alias("facts"),
    ).distinct()
    issues = grading.issues_with_evidence(spark, sf).withColumn("detail", F.concat(F.coalesce("detail", F.lit("")), F.lit(" " + "long text " * 6)))
    apps = run_sql(spark, sf, C_APPS).withColumn("names", F.array("app"))
    return documents.build_context(run_sql(spark, sf, C_STORES), run_sql(spark, sf, C_THEMES), apps, run_sql(spark, sf, C_SPEED), audits, pages, issues, max_bytes)


CURRENT = "(SELECT * FROM issues i WHERE audit_id = (SELECT max(id) FROM audits a WHERE a.store_id = i.store_id))"


@registry.add(
    "build_context",
    st.with_tables(
        f"""SELECT s.id AS store_id, s.domain, (SELECT max(id) FROM audits a WHERE a.store_id = s.id) AS audit_id, c.critical, c.minor, c.ids AS issue_ids, (SELECT count(DISTINCT strategy) FROM speed p WHERE p.store_id = s.id AND strategy <> 'tablet') AS n_speed
        FROM stores s LEFT JOIN (SELECT store_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'MINOR') AS minor,
            string_agg(CAST(id AS VARCHAR), ',' ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END, CASE page WHEN 'product' THEN 3 WHEN 'cart' THEN 4 WHEN 'checkout' THEN 5 ELSE 6 END, id) AS ids FROM {CURRENT} GROUP BY 1) c ON c.store_id = s.id""",
        **CONTEXT_RELATIONS,
    ),
)
def build_context(spark, sf):
    x = contexts(spark, sf)
    a = F.col("context.audit")
    ids = F.array_join(F.transform(a["issues"], lambda i: i["id"].cast("string")), ",")
    return x.select(
        "store_id", F.col("context.store.domain").alias("domain"), a["id"].alias("audit_id"), a["counts"]["CRITICAL"].alias("critical"), a["counts"]["MINOR"].alias("minor"), ids.alias("issue_ids"),
        F.size("context.pagespeed").cast("bigint").alias("n_speed"),
    )


@registry.add("fit_context_to_budget")
def fit_context_to_budget(spark, sf):
    fitted = documents.fit_to_budget(contexts(spark, sf, 1500), 1500)
    return fitted.select("store_id", "bytes", "over_budget", F.array_join("context.meta.trimmed", ",").alias("trimmed"), F.col("context.meta.issues_omitted").alias("issues_omitted"))


@registry.add("analyst_prompts")
def analyst_prompts(spark, sf):
    return documents.analyst_prompts(documents.fit_to_budget(contexts(spark, sf)), "You judge web shops.")


@registry.add("classifier_prompts")
def classifier_prompts(spark, sf):
    return documents.classifier_prompts(contexts(spark, sf), scoring.lead_score(run_sql(spark, sf, SIGNALS)), "You classify web shops.")


FINDINGS = "SELECT user_id AS store_id, event_id AS pos, event_id AS evidence_id, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'MAJOR' ELSE 'MINOR' END AS severity, 'cart' AS page, concat('T ', props) AS title, 'loses sales' AS impact FROM {events}"
FACTS = """
WITH f AS (SELECT store_id, 0 AS k, row_number() OVER (PARTITION BY store_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END, pos) AS a, concat('A', evidence_id) AS fact_id, concat('On ', page, ': ', title, '; effect: ', impact) AS text FROM findings
    UNION ALL SELECT store_id, 1, a, concat('P', a), concat('Lab test (', strategy, '): ', concat_ws(', ', CASE WHEN performance IS NOT NULL THEN concat('score ', performance, ' of 100') END, concat('main content after ', printf('%.1f', CASE WHEN lcp_ms % 500 = 250 THEN lcp_ms + 1 ELSE lcp_ms END / 1000), ' seconds'), concat('shift of ', cls)))
      FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY strategy <> 'mobile', id) AS a FROM (SELECT * FROM speed QUALIFY id = max(id) OVER (PARTITION BY store_id, strategy)))
    UNION ALL SELECT store_id, 2, 0, 'T1', concat('Theme in use: ', name, CASE WHEN age_months IS NULL THEN '' ELSE concat('; its release is ', age_months, ' months old') END) FROM themes
    UNION ALL SELECT store_id, 3, 0, 'S1', concat('Apps installed: ', total, CASE WHEN size IS NULL THEN '' ELSE concat(' (', size, ' for shops like it)') END) FROM apps WHERE total > 0
    UNION ALL SELECT id, 4, 0, 'B1', concat('Products on sale: ', products_count) FROM stores WHERE products_count IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY k, a) AS fact_no FROM f)
"""
FACT_RELATIONS = {"findings": FINDINGS, "speed": C_SPEED, "themes": C_THEMES, "apps": C_APPS, "stores": C_STORES}


def facts(spark, sf):
    f = {k: run_sql(spark, sf, v) for k, v in FACT_RELATIONS.items()}
    return documents.fact_sheet(f["findings"], f["speed"], f["themes"], f["apps"], f["stores"].withColumnRenamed("id", "store_id"))


@registry.add("fact_sheet", st.with_tables(FACTS + "SELECT store_id, CAST(fact_no AS INT) AS fact_no, fact_id, text FROM n WHERE fact_no <= 12", **FACT_RELATIONS))
def fact_sheet(spark, sf):
    return facts(spark, sf).select("store_id", "fact_no", "fact_id", "text")


LEADS = "SELECT c_custkey AS store_id, concat('s', CAST(c_custkey AS VARCHAR(20)), '.pl') AS domain, c_name AS name, CASE WHEN c_nationkey < 9 THEN 'pl' END AS country, 'UX_PROBLEMS' AS category, CASE WHEN c_acctbal > 0 THEN 'slow' END AS reason, CASE WHEN c_acctbal > 4000 THEN 'Anna Nowak' END AS contact_name, CASE WHEN c_acctbal > 6000 THEN 'CEO' END AS contact_role FROM {customer}"


@registry.add(
    "letter_prompts",
    st.with_tables(
        FACTS
        + """, sheets AS (SELECT store_id, string_agg(concat('  [', fact_id, '] ', text), chr(10) ORDER BY fact_no) AS s FROM n WHERE fact_no <= 12 GROUP BY 1),
        p AS (SELECT l.store_id, concat_ws(chr(10), concat('Recipient shop: ', name, ', ', domain), concat('Language: ', CASE WHEN country = 'pl' THEN 'Polish' ELSE 'English' END),
            concat('Salutation: ', CASE WHEN contact_name IS NULL THEN 'no name known, address the shop' WHEN contact_role IS NULL THEN 'Anna' ELSE 'Anna, CEO' END),
            concat(chr(10), 'Reason for contact: ', concat_ws('; ', category, reason)), concat(chr(10), 'Permitted facts, cited by id; nothing beyond them:'), coalesce(s, '  (none on file)')) AS prompt
          FROM leads l LEFT JOIN sheets USING (store_id))
        SELECT store_id, prompt, substr(sha256(concat('Write.', chr(10), '---', chr(10), prompt)), 1, 16) AS prompt_hash FROM p""",
        leads=LEADS,
        **FACT_RELATIONS,
    ),
)
def letter_prompts(spark, sf):
    return documents.letter_prompts(run_sql(spark, sf, LEADS), documents.render_fact_sheets(facts(spark, sf)), "Write.")


@registry.add(
    "store_detail",
    st.with_tables(
        """WITH a AS (SELECT store_id, 'contacts' AS section, row_number() OVER (PARTITION BY store_id ORDER BY is_primary DESC, is_generic, confidence DESC, id) AS rn, CAST(id AS VARCHAR) AS id FROM contacts
        UNION ALL SELECT audit_id, 'images', row_number() OVER (PARTITION BY audit_id ORDER BY page, viewport DESC, id), CAST(id AS VARCHAR) FROM images
        UNION ALL SELECT store_id, 'apps', row_number() OVER (PARTITION BY store_id ORDER BY app), app FROM apps
        UNION ALL SELECT store_id, 'theme', row_number() OVER (PARTITION BY store_id ORDER BY name), name FROM themes
        UNION ALL SELECT store_id, 'measurements', row_number() OVER (PARTITION BY store_id ORDER BY strategy DESC), CAST(id AS VARCHAR) FROM (SELECT * FROM speed QUALIFY id = max(id) OVER (PARTITION BY store_id, strategy))
        UNION ALL SELECT store_id, 'failures', row_number() OVER (PARTITION BY store_id ORDER BY step), step FROM (SELECT * FROM logs QUALIFY id = max(id) OVER (PARTITION BY store_id, step)) WHERE status = 'FAILED'
        UNION ALL SELECT store_id, 'letters', row_number() OVER (PARTITION BY store_id ORDER BY version DESC), CAST(id AS VARCHAR) FROM letters
        UNION ALL SELECT store_id, 'issues', row_number() OVER (PARTITION BY store_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END, page, id), CAST(id AS VARCHAR) FROM issues i WHERE audit_id = (SELECT max(audit_id) FROM issues j WHERE j.store_id = i.store_id))
        SELECT store_id, section, CAST(floor((rn - 1) / 3) AS BIGINT) AS part, string_agg(id, ',' ORDER BY rn) AS ids FROM a GROUP BY ALL""",
        contacts=st.CONTACTS,
        letters=st.LETTERS,
        issues=st.ISSUES,
        images=IMAGES,
        apps=C_APPS,
        themes=C_THEMES,
        speed=C_SPEED,
        logs=st.STEP_LOGS,
    ),
)
def store_detail(spark, sf):
    logs = run_sql(spark, sf, st.STEP_LOGS)
    contacts, letter_rows, issues = (run_sql(spark, sf, t) for t in (st.CONTACTS, st.LETTERS, st.ISSUES))
    images = run_sql(spark, sf, IMAGES).withColumn("store_id", F.col("audit_id"))
    apps = run_sql(spark, sf, C_APPS).select("store_id", F.col("app").alias("name"))
    sections = documents.store_sections(contacts, letter_rows, issues, images, apps, runs.last_failures(logs), run_sql(spark, sf, C_SPEED), run_sql(spark, sf, C_THEMES))
    detail = documents.store_detail(sections, per_part=3)
    ids = F.transform("items", lambda i: F.coalesce(*[F.get_json_object(i, f"$.{k}") for k in ("id", "name", "step")]))
    return detail.select("store_id", "section", "part", F.array_join(ids, ",").alias("ids"))


@registry.add(
    "store_heads",
    st.with_tables(
        """SELECT s.id AS store_id, a.category, a.lead_score, r.run_id FROM stores s LEFT JOIN (SELECT store_id, category, lead_score FROM analyses WHERE agent = 'lead_classifier' QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY id DESC) = 1) a ON a.store_id = s.id
        LEFT JOIN (SELECT store_id, max(run_id) AS run_id FROM run_stores GROUP BY 1) r ON r.store_id = s.id""",
        stores=st.STORES,
        analyses=st.ANALYSES,
        run_stores=st.RUN_STORES,
    ),
)
def store_heads(spark, sf):
    return documents.store_heads(*[run_sql(spark, sf, t) for t in (st.STORES, st.ANALYSES, st.RUN_STORES)]).select("store_id", "category", "lead_score", "run_id")


# ------------------------------------------------------------------ letters

TEXTS = "SELECT doc_id AS id, doc_id AS draft_id, source AS store_id, CASE WHEN lang = 'en' THEN 'Your shop' ELSE '' END AS subject, text AS body FROM {documents}"
SHINGLED = r"""
WITH w AS (SELECT id, store_id, list_filter(string_split(regexp_replace(replace(replace(strip_accents(lower(CASE WHEN subject <> '' THEN concat(subject, chr(10), body) ELSE body END)), 'ł', 'l'), 'Ł', 'l'), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM t),
s AS (SELECT id, store_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
c AS (SELECT a.store_id, b.id, b.store_id AS other FROM (SELECT DISTINCT store_id FROM t) a JOIN t b ON b.store_id <> a.store_id QUALIFY row_number() OVER (PARTITION BY a.store_id ORDER BY b.id DESC) <= 500),
x AS (SELECT id, store_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT d.id, e.id AS other_id, e.store_id AS other_store, d.n AS dn, e.n AS en, count(*) AS shared FROM x d JOIN x e ON e.g = d.g JOIN c ON c.store_id = d.store_id AND c.id = e.id GROUP BY ALL),
b AS (SELECT id, max((floor(shared / (dn + en - shared) * 1000 + 0.5) / 1000, other_id)) AS m FROM p GROUP BY 1)
SELECT s.id AS draft_id, (SELECT count(*) FROM c WHERE c.store_id = s.store_id) AS compared, coalesce(m[1], 0) AS similarity, CASE WHEN m[1] > 0 THEN m[2] END AS closest_id, coalesce(m[1], 0) >= 0.4 AS repeats FROM s LEFT JOIN b USING (id)
"""


@registry.add("nearest_earlier_text", st.with_tables(SHINGLED, t=TEXTS))
def nearest_earlier_text(spark, sf):
    texts = spread(run_sql(spark, sf, TEXTS))
    return letters.nearest_earlier_text(texts.drop("id"), texts.drop("draft_id")).select("draft_id", "compared", "similarity", "closest_id", "repeats")


@registry.add("nearest_text_of_all")
def nearest_text_of_all(spark, sf):
    """All letters whatever their age; the index is approximate, so it is tested against brute force instead of SQL."""
    texts = spread(run_sql(spark, sf, TEXTS))
    return letters.nearest_earlier_text(texts.drop("id"), texts.drop("draft_id"), newest=None).select("draft_id", "compared", "similarity", "closest_id", "repeats")


CATEGORISED = "SELECT o_orderkey AS store_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'HEALTHY_STORE' WHEN '2-HIGH' THEN 'SKIP' WHEN '3-MEDIUM' THEN 'ODD' ELSE 'UX_PROBLEMS' END AS category FROM {orders}"
GATE = "CASE category WHEN 'HEALTHY_STORE' THEN 'nothing to point out: its audit is nearly clean' WHEN 'SKIP' THEN 'a rule excludes it' END"


@registry.add("gate_letters", st.with_tables(f"SELECT store_id, {GATE} AS gate_reason, {GATE} IS NULL AS write FROM c", c=CATEGORISED))
def gate_letters(spark, sf):
    return letters.gate_letters(run_sql(spark, sf, CATEGORISED)).select("store_id", "gate_reason", "write")


CITING = """
SELECT o_orderkey AS draft_id, o_orderkey AS store_id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat('Subject ', o_orderpriority, CASE WHEN o_totalprice > 400000 THEN ' and a very long tail that goes on and on and on for ever' ELSE '' END) END AS subject,
       concat(CASE WHEN o_totalprice > 100000 THEN 'Dzień dobry Łukaszu, ' ELSE 'Hello, ' END, repeat('we saw the cart – ', CAST(floor(o_totalprice / 20000) AS INT)), CASE WHEN o_orderpriority = '1-URGENT' THEN ' This is a GAME  Changer' ELSE '' END) AS body,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 'Łukasz Nowak' END AS contact_name, CASE WHEN o_totalprice < 250000 THEN ' a1 ' ELSE 'Z9' END AS cite, o_totalprice, o_orderpriority, o_orderstatus
FROM {orders}
"""


def _drafts(spark, sf):
    return run_sql(spark, sf, CITING).withColumn("cited", F.array(F.col("cite"), F.lit("A1"), F.lit(" "), F.col("cite")))


def _sheet(spark, sf):
    return run_sql(spark, sf, CITING).filter("o_totalprice > 60000").select("store_id", F.lit("A1").alias("fact_id"))


@registry.add(
    "ground_citations",
    st.with_tables(
        """SELECT draft_id, 'a1' AS cited, o_totalprice > 60000 AS used FROM d WHERE o_totalprice < 250000 UNION ALL SELECT draft_id, 'Z9', false FROM d WHERE o_totalprice >= 250000 UNION ALL SELECT draft_id, 'A1', true FROM d WHERE o_totalprice >= 250000""", d=CITING
    ),
)
def ground_citations(spark, sf):
    return letters.ground_citations(_drafts(spark, sf), _sheet(spark, sf)).select("draft_id", "cited", "used")


def _checked(spark, sf):
    return letters.check_letters(_drafts(spark, sf), letters.ground_citations(_drafts(spark, sf), _sheet(spark, sf)))


WORDS = "CAST(len(list_filter(regexp_split_to_array(trim(body), '\\s+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]'))) AS INT)"
CHECKED = f"""
SELECT draft_id, store_id, word_count, concat_ws(',', CASE WHEN word_count < 80 OR word_count > 150 THEN 'length' END, CASE WHEN contact_name IS NOT NULL AND o_totalprice <= 100000 THEN 'greeting' END, CASE WHEN o_totalprice <= 60000 THEN 'grounding' END,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'phrases' END, CASE WHEN o_orderstatus = 'F' THEN 'subject' WHEN length(subject) > 60 THEN 'subject' END) AS failed FROM (SELECT *, {WORDS} AS word_count FROM d)
"""


@registry.add("check_letters", st.with_tables(f"SELECT draft_id, word_count, failed FROM ({CHECKED})", d=CITING))
def check_letters(spark, sf):
    names = F.array_join(F.transform("failures", lambda f: f["check"]), ",")
    return _checked(spark, sf).select("draft_id", "word_count", names.alias("failed"))


REVIEWS = """
SELECT o_orderkey AS draft_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'oops' ELSE concat('{"facts": {"verdict": "', CASE WHEN o_orderpriority = '2-HIGH' THEN 'FAIL' ELSE 'PASS' END, '", "reason": "r1"}, "personalisation": {"verdict": "PASS", "reason": "r"}, "category": {"verdict": "PASS", "reason": "r"}, "tone": {"verdict": "NOT_CHECKED", "reason": "r"}, "pushiness": {"verdict": "PASS", "reason": "r"}}') END AS text,
       CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 1000) / 600 END AS similarity, o_orderpriority AS pr FROM {orders}
"""


def _verdicts(spark, sf):
    reviews = answers.validate_answers(run_sql(spark, sf, REVIEWS), "review")
    similar = run_sql(spark, sf, REVIEWS).select("draft_id", "similarity", (F.col("similarity") >= 0.4).alias("repeats"))
    return letters.merge_verdicts(reviews.drop("similarity"), _checked(spark, sf), similar)


VERDICTS = f"""
SELECT r.draft_id, nullif(concat_ws(' ', CASE WHEN pr = '5-LOW' THEN 'facts: review unreadable' WHEN pr = '2-HIGH' THEN 'facts: r1' END, CASE WHEN c.word_count < 80 OR c.word_count > 150 THEN concat('length: ', c.word_count, ' of 80 to 150 words') END,
    CASE WHEN similarity >= 0.4 THEN concat('repetition: shares ', CAST(floor(similarity * 100 + 0.5) AS BIGINT), '% with an earlier one, limit 40%') END), '') AS failures FROM r JOIN ({CHECKED}) c ON c.draft_id = r.draft_id
"""


@registry.add("merge_verdicts", st.with_tables(f"SELECT draft_id, failures IS NULL AS passed, failures FROM ({VERDICTS})", r=REVIEWS, d=CITING))
def merge_verdicts(spark, sf):
    joined = F.array_join("failures", " ")
    return _verdicts(spark, sf).select("draft_id", "passed", F.when(joined != "", joined).alias("failures"))


@registry.add(
    "decide_letter_status",
    st.with_tables(
        f"""SELECT k.draft_id, CASE WHEN g.r IS NOT NULL THEN 'SKIPPED' WHEN k.failed = '' AND v.failures IS NULL THEN 'READY' ELSE 'QC_FAILED' END AS status FROM ({CHECKED}) k JOIN ({VERDICTS}) v USING (draft_id) JOIN (SELECT store_id, {GATE} AS r FROM c) g ON g.store_id = k.store_id""",
        c=CATEGORISED,
        d=CITING,
        r=REVIEWS,
    ),
)
def decide_letter_status(spark, sf):
    gates = letters.gate_letters(run_sql(spark, sf, CATEGORISED))
    return letters.decide_letter_status(_drafts(spark, sf), gates, _checked(spark, sf), _verdicts(spark, sf)).select("draft_id", "status")


@registry.add(
    "review_prompts",
    st.with_tables(
        FACTS
        + """, sheets AS (SELECT store_id, string_agg(concat('  [', fact_id, '] ', text), chr(10) ORDER BY fact_no) AS s FROM n WHERE fact_no <= 12 GROUP BY 1)
        SELECT l.store_id, concat_ws(chr(10), 'Reason for contact: UX_PROBLEMS', concat('Salutation expected: ', CASE WHEN contact_name IS NULL THEN 'none, as no name was known' ELSE 'Anna' END), 'Permitted facts:', coalesce(s, '  (none on file)'),
            concat('Subject under review: About ', name), 'Text under review:', concat('Hello ', domain)) AS prompt FROM leads l LEFT JOIN sheets USING (store_id)""",
        leads=LEADS,
        **FACT_RELATIONS,
    ),
)
def review_prompts(spark, sf):
    drafts = run_sql(spark, sf, LEADS).withColumns({"draft_id": F.col("store_id"), "subject": F.concat(F.lit("About "), "name"), "body": F.concat(F.lit("Hello "), "domain")})
    return documents.review_prompts(drafts, documents.render_fact_sheets(facts(spark, sf)), "Check.").select("store_id", "prompt")


# ------------------------------------------------------------------ the whole bundle

B_APPS = """
SELECT o_custkey AS store_id, concat('app ', CAST(o_orderkey AS VARCHAR(20))) AS name,
       CASE o_orderpriority WHEN '1-URGENT' THEN ' ADS' WHEN '2-HIGH' THEN 'analytics' WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'gifts' ELSE concat('odd ', o_orderstatus) END AS category FROM {orders}
"""
B_COUNTS = "SELECT c_custkey AS store_id, CASE WHEN c_acctbal > 5000 THEN CAST(c_nationkey AS BIGINT) END AS apps_count FROM {customer}"
B_SPEED = """
SELECT o_custkey AS store_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'mobile' WHEN 'O' THEN 'desktop' ELSE 'tablet' END AS strategy,
       CASE WHEN o_totalprice > 50000 THEN CAST(floor(o_totalprice / 5100) AS INT) END AS performance, CAST(month(o_orderdate) AS INT) AS accessibility, CAST(50 + month(o_orderdate) AS INT) AS best_practices, CAST(60 + month(o_orderdate) AS INT) AS seo,
       CAST(floor(o_totalprice / 200) AS BIGINT) AS fcp_ms, CAST(floor(o_totalprice / 100) AS BIGINT) AS lcp_ms, CAST(0.25 AS DOUBLE) AS cls, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(month(o_orderdate) AS BIGINT) END AS inp_ms,
       CAST(floor(o_totalprice / 300) AS BIGINT) AS ttfb_ms, CAST(floor(o_totalprice / 50) AS BIGINT) AS speed_index_ms, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS fetched_at FROM {orders}
"""
B_AUDITS = """
SELECT event_id AS id, user_id AS store_id, 'OK' AS status, value > 95 AS blocked, CASE WHEN event_type = 'error' THEN props END AS error, concat('at ', CAST(event_id AS VARCHAR(20))) AS finished_at,
       CASE WHEN value > 95 THEN 'cloudflare' END AS wall_vendor, CASE WHEN value > 95 THEN props END AS wall_signal, CASE WHEN value > 30 THEN concat('/c/', event_type) END AS collection_url, CASE WHEN value > 60 THEN concat('/p/', event_type) END AS product_url FROM {events}
"""
B_PAGE_SEO = """
SELECT event_id AS audit_id, props AS title, CAST(length(props) AS INT) AS title_length, CASE WHEN value > 40 THEN event_type END AS description, CAST(CASE WHEN value > 40 THEN length(event_type) ELSE 0 END AS INT) AS description_length, CAST(1 AS INT) AS h1_count,
       event_type AS h1_text, CASE WHEN value > 70 THEN 'https://s/' END AS canonical, CASE WHEN value > 80 THEN 'noindex' END AS robots_meta, value > 80 AS noindex, 'pl' AS lang, value > 20 AS open_graph, CAST(floor(value) AS INT) AS images, CAST(floor(value / 2) AS INT) AS images_with_alt FROM {events} WHERE event_type <> 'signup'
"""
B_SITE_SEO = "SELECT event_id AS audit_id, value > 10 AS has_robots, value > 99 AS robots_blocks_all, value > 5 AS has_sitemap, CAST(floor(value * 3) AS INT) AS sitemap_urls FROM {events} WHERE event_type <> 'click'"
B_RELATIONS = {"stores": C_STORES, "themes": C_THEMES, "apps": B_APPS, "counts": B_COUNTS, "speed": B_SPEED, "audits": B_AUDITS, "page_seo": B_PAGE_SEO, "site_seo": B_SITE_SEO}


@registry.add(
    "context_sections",
    st.with_tables(
        """WITH a AS (SELECT * FROM audits QUALIFY id = max(id) OVER (PARTITION BY store_id)),
        g AS (SELECT *, CASE lower(trim(category)) WHEN 'ads' THEN 'marketing' WHEN 'analytics' THEN 'analytics' ELSE 'other' END AS grp FROM apps),
        n AS (SELECT store_id, count(*) AS total, count(*) FILTER (grp = 'marketing') AS marketing, count(*) FILTER (grp = 'analytics') AS analytics, count(*) FILTER (grp = 'other') AS others, string_agg(name, ',' ORDER BY name) AS names FROM g GROUP BY 1),
        o AS (SELECT store_id, string_agg(concat(category, ':', n), ',' ORDER BY n DESC, category) AS other FROM (SELECT store_id, category, count(*) AS n FROM g WHERE grp = 'other' AND category IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        k AS (SELECT store_id, apps_count, coalesce(total, 0) AS rows, coalesce(marketing, 0) AS marketing, coalesce(analytics, 0) AS analytics, coalesce(others, 0) AS others, names, other, greatest(coalesce(total, 0), coalesce(apps_count, 0)) AS counted
              FROM counts LEFT JOIN n USING (store_id) LEFT JOIN o USING (store_id) WHERE coalesce(total, 0) > 0 OR apps_count IS NOT NULL),
        v AS (SELECT store_id, string_agg(concat_ws('|', strategy, performance, accessibility, best_practices, seo, fcp_ms, lcp_ms, cls, inp_ms, ttfb_ms, speed_index_ms, fetched_at), ';' ORDER BY strategy DESC) AS speed
              FROM (SELECT * FROM speed WHERE strategy <> 'tablet' QUALIFY id = max(id) OVER (PARTITION BY store_id, strategy)) GROUP BY 1)
        SELECT s.id AS store_id, concat_ws('|', s.domain, s.name, s.country) AS store, concat_ws('|', s.rank, s.revenue_estimate, s.traffic_estimate, s.products_count) AS business, concat_ws('|', t.name, t.current_version, t.latest_version, t.version_gap, t.age_months, t.architecture, t.freshness) AS theme,
        coalesce(k.apps_count, k.rows) AS apps_total, CASE WHEN k.counted <= 0 THEN NULL WHEN k.counted <= 5 THEN 'low' WHEN k.counted <= 12 THEN 'medium' WHEN k.counted <= 20 THEN 'high' ELSE 'very_high' END AS apps_size,
        k.marketing, k.analytics, k.others, k.other, k.names, coalesce(v.speed, '') AS speed, a.id AS audit_id, a.finished_at, CASE WHEN a.wall_vendor IS NOT NULL THEN concat(a.wall_vendor, ': ', a.wall_signal) END AS wall,
        concat_ws('|', a.collection_url, a.product_url) AS key_urls,
        concat_ws('|', p.title, p.title_length, p.description, p.description_length, p.h1_count, p.h1_text, p.canonical, p.robots_meta, p.noindex, p.lang, p.open_graph, p.images, p.images_with_alt) AS page_seo,
        concat_ws('|', w.has_robots, w.robots_blocks_all, w.has_sitemap, w.sitemap_urls) AS site_seo
        FROM stores s LEFT JOIN themes t ON t.store_id = s.id LEFT JOIN k ON k.store_id = s.id LEFT JOIN v ON v.store_id = s.id LEFT JOIN a ON a.store_id = s.id LEFT JOIN page_seo p ON p.audit_id = a.id LEFT JOIN site_seo w ON w.audit_id = a.id""",
        **B_RELATIONS,
    ),
)
def context_sections(spark, sf):
    """Every section of the context bundle beside pages and issues, field by field."""
    r = {k: run_sql(spark, sf, v) for k, v in B_RELATIONS.items()}
    no_pages = r["audits"].select(
        F.col("id").alias("audit_id"), F.lit(0).alias("page_no"), F.lit("homepage").alias("page"), F.lit("mobile").alias("viewport"), F.lit("u").alias("url"), F.lit("ok").alias("availability"), F.lit(200).alias("http_status"), F.lit(1).alias("run"), F.lit(0).alias("failed"),
        F.array().cast("array<struct<name:string,error:string>>").alias("failed_checks"), F.col("error").alias("facts"),
    )
    issues = grading.issues_with_evidence(spark, sf)
    x = documents.build_context(r["stores"], r["themes"], documents.context_apps(r["apps"], r["counts"]), r["speed"], r["audits"], no_pages, issues, page_seo=r["page_seo"], site_seo=r["site_seo"])
    c = F.col("context")
    line = lambda part, names: F.concat_ws("|", *[part[n].cast("string") for n in names])
    apps, audit = c["apps"], c["audit"]
    speed = F.array_join(F.transform(c["pagespeed"], lambda p: line(p, ["strategy", *documents.SPEED_FIELDS])), ";")
    return x.select(
        "store_id", line(c["store"], ["domain", "name", "country"]).alias("store"), line(c["business"], ["rank", "revenue_estimate", "traffic_estimate", "products_count"]).alias("business"),
        line(c["theme"], ["name", "current_version", "latest_version", "version_gap", "age_months", "architecture", "freshness"]).alias("theme"),
        apps["total"].alias("apps_total"), apps["size"].alias("apps_size"), apps["by_group"]["marketing"].alias("marketing"), apps["by_group"]["analytics"].alias("analytics"), apps["by_group"]["other"].alias("others"),
        F.array_join(F.transform(apps["other"], lambda o: F.concat(o["category"], F.lit(":"), o["n"].cast("string"))), ",").alias("other"), F.array_join(apps["names"], ",").alias("names"), speed.alias("speed"),
        audit["id"].alias("audit_id"), audit["finished_at"].alias("finished_at"), F.concat(audit["bot_protection"]["vendor"], F.lit(": "), audit["bot_protection"]["signal"]).alias("wall"), line(audit["key_urls"], ["collection", "product"]).alias("key_urls"),
        line(audit["seo"]["page"], r["page_seo"].columns[1:]).alias("page_seo"), line(audit["seo"]["site"], r["site_seo"].columns[1:]).alias("site_seo"),
    )


# ------------------------------------------------------------------ briefs and versions

BRIEF_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in letters.BRIEFS.items()) + f" ELSE '{letters.BRIEFS[letters.DEFAULT_BRIEF]}' END"
BRIEFED = """SELECT o_orderkey AS store_id, concat('s', CAST(o_orderkey AS VARCHAR(20)), '.pl') AS domain, CAST(NULL AS VARCHAR(9)) AS name, 'de' AS country, CAST(NULL AS VARCHAR(9)) AS reason, CAST(NULL AS VARCHAR(9)) AS contact_name, CAST(NULL AS VARCHAR(9)) AS contact_role,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HEALTHY_STORE' WHEN '2-HIGH' THEN 'HEAVY_APP_STACK' WHEN '3-MEDIUM' THEN 'HIGH_REVENUE_OPPORTUNITY' WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'F' THEN 'PERFORMANCE_PROBLEMS' WHEN 'P' THEN 'SKIP' END ELSE 'GROWING_STORE' END AS category FROM {orders}"""


@registry.add(
    "letter_briefs",
    st.with_tables(
        f"""SELECT store_id, category, w AS write, coalesce(category <> 'HIGH_REVENUE_OPPORTUNITY', false) AS known_category, CASE WHEN w THEN {BRIEF_CASE} END AS brief
        FROM (SELECT *, coalesce(category NOT IN ('HEALTHY_STORE', 'SKIP'), true) AS w FROM c)""",
        c=BRIEFED,
    ),
)
def letter_briefs(spark, sf):
    return letters.gate_letters(run_sql(spark, sf, BRIEFED)).select("store_id", "category", "write", "known_category", "brief")


@registry.add(
    "briefed_letter_prompts",
    st.with_tables(
        f"""SELECT store_id, concat_ws(chr(10), concat('Recipient shop: ', domain, ', ', domain), 'Language: English', 'Salutation: no name known, address the shop', concat(chr(10), 'Reason for contact: ', coalesce(category, '')), concat('Brief: ', {BRIEF_CASE}),
        concat(chr(10), 'Permitted facts, cited by id; nothing beyond them:'), '  (none on file)') AS prompt FROM c WHERE coalesce(category NOT IN ('HEALTHY_STORE', 'SKIP'), true)""",
        c=BRIEFED,
    ),
)
def briefed_letter_prompts(spark, sf):
    leads = letters.gate_letters(run_sql(spark, sf, BRIEFED)).filter("write")
    none = leads.select("store_id", F.lit(None).cast("string").alias("fact_sheet")).filter(F.lit(False))
    return documents.letter_prompts(leads, none, "Write.").select("store_id", "prompt")


VERSIONS = """
SELECT o_orderkey AS id, o_custkey AS store_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version,
       CASE WHEN o_totalprice < 9000 THEN ' - ' ELSE concat('Offer of level ', o_orderpriority, ' for orders in state ', o_orderstatus, ', month ', CAST(month(o_orderdate) AS VARCHAR(9)), '; price about ', CAST(CAST(floor(o_totalprice / 100000) AS INT) AS VARCHAR(9)), ' units') END AS body FROM {orders}
"""


@registry.add(
    "version_similarity",
    st.with_tables(
        """WITH w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM l),
        s AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS all_s FROM w),
        d AS (SELECT id, store_id, version, CASE WHEN len(w) = 0 THEN [] ELSE all_s END AS s FROM s)
        SELECT a.id, b.id AS previous_id, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE floor(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 1000 + 0.5) / 1000 END AS similarity
        FROM d a JOIN d b ON b.store_id = a.store_id AND b.version = a.version - 1""",
        l=VERSIONS,
    ),
)
def version_similarity(spark, sf):
    return letters.version_similarity(run_sql(spark, sf, VERSIONS))
