"""Contact queries: people, mailboxes, ranking, saving and erasure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.functions.people import detect_role
from retailscope.operators import constraints, contacts, extract, search
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, spread

registry = Registry()

FIRST = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Anna' WHEN '2-HIGH' THEN 'Łukasz' WHEN '3-MEDIUM' THEN 'Jan' WHEN '5-LOW' THEN 'Ewa' ELSE 'Piotr' END"
LAST = "CASE CAST(month(o_orderdate) AS INT) WHEN 1 THEN 'Nowak' WHEN 2 THEN 'Żak' WHEN 3 THEN 'Lis' WHEN 4 THEN 'Kowalska' WHEN 5 THEN 'Sklep' ELSE 'Wójcik' END"
PEOPLE_PAGES = f"""
SELECT o_orderkey AS page_id, o_custkey AS store_id, concat('shop', CAST(o_custkey AS VARCHAR(20)), '.pl') AS store_domain,
       CASE o_orderstatus WHEN 'F' THEN 'about' WHEN 'O' THEN 'contact' ELSE 'home' END AS kind, concat('https://s/', CAST(o_orderkey AS VARCHAR(20))) AS url, '' AS html,
       concat('Our brand was founded by ', {FIRST}, ' ', {LAST}, ' in 1999. Later, ', {LAST}, ' ', {FIRST}, ' - ', CASE WHEN o_totalprice > 200000 THEN 'CEO' ELSE 'singer' END, ' of it.') AS text,
       {FIRST} AS first, {LAST} AS last, o_totalprice > 200000 AS boss
FROM {{orders}}
"""
SAID = """
SELECT page_id, store_id, kind, concat(first, ' ', last) AS name, CASE WHEN boss THEN 'CEO' ELSE 'Founder' END AS role, 0 AS way FROM p WHERE last <> 'Sklep' AND boss
UNION ALL SELECT page_id, store_id, kind, concat(first, ' ', last), NULL, 0 FROM p WHERE last <> 'Sklep' AND NOT boss
UNION ALL SELECT page_id, store_id, kind, concat(last, ' ', first), 'CEO', 1 FROM p WHERE last <> 'Sklep' AND boss
"""


def named(spark, sf):
    return extract.extract_people(spread(run_sql(spark, sf, PEOPLE_PAGES)), ["page_id", "store_id"])


@registry.add("extract_people", st.with_tables(f"SELECT page_id, name, role FROM ({SAID})", p=PEOPLE_PAGES))
def extract_people(spark, sf):
    return named(spark, sf).select("page_id", "name", "role")


FOLDED = "lower(replace(strip_accents(name), 'ł', 'l'))"


@registry.add(
    "strongest_person",
    st.with_tables(
        f"""SELECT store_id, replace({FOLDED}, 'ł', 'l') AS name_key, role, page_id FROM ({SAID})
        QUALIFY row_number() OVER (PARTITION BY store_id, replace({FOLDED}, 'ł', 'l') ORDER BY role IS NULL, page_id, way) = 1""",
        p=PEOPLE_PAGES,
    ),
)
def strongest_person(spark, sf):
    return contacts.strongest_person(named(spark, sf), ["page_id", "pos"]).select("store_id", "name_key", "role", "page_id")


@registry.add(
    "detect_roles",
    st.with_tables(
        """SELECT id, CASE WHEN n < 2 THEN 'CEO' WHEN n < 4 THEN 'Founder' WHEN n < 6 THEN 'Co-Founder' WHEN n < 8 THEN 'Other' WHEN n < 10 THEN 'Ecommerce Manager' END AS role,
        CASE WHEN n < 2 THEN 'Prezes Zarządu' WHEN n < 4 THEN 'założycielka' WHEN n < 6 THEN 'współzałożyciel' WHEN n < 8 THEN 'Kierownik' WHEN n < 10 THEN 'E-commerce manager' END AS matched FROM t""",
        t="""SELECT c_custkey AS id, c_nationkey AS n, concat(c_name, CASE WHEN c_nationkey < 2 THEN ' founder, Prezes Zarządu' WHEN c_nationkey < 4 THEN ' założycielka i manager' WHEN c_nationkey < 6 THEN ' współzałożyciel'
             WHEN c_nationkey < 8 THEN ' Kierownik zmiany' WHEN c_nationkey < 10 THEN ' E-commerce manager' ELSE ' ceobot ownership' END) AS text FROM {customer}""",
    ),
)
def detect_roles(spark, sf):
    text = """SELECT c_custkey AS id, concat(c_name, CASE WHEN c_nationkey < 2 THEN ' founder, Prezes Zarządu' WHEN c_nationkey < 4 THEN ' założycielka i manager' WHEN c_nationkey < 6 THEN ' współzałożyciel'
             WHEN c_nationkey < 8 THEN ' Kierownik zmiany' WHEN c_nationkey < 10 THEN ' E-commerce manager' ELSE ' ceobot ownership' END) AS text FROM {customer}"""
    found = run_sql(spark, sf, text).withColumn("d", detect_role(F.col("text")))
    return found.select("id", "d.role", "d.matched")


PEOPLE = f"""
SELECT o_orderkey AS person_id, o_custkey AS store_id, concat({FIRST}, ' ', {LAST}) AS name, CASE WHEN o_totalprice > 300000 THEN 'CEO' END AS role, CASE WHEN o_totalprice > 300000 THEN 'ceo' END AS role_text,
       CASE o_orderstatus WHEN 'F' THEN 'jsonld' ELSE 'role_text' END AS source, CASE WHEN o_orderpriority < '3' THEN 'about' ELSE 'home' END AS page_kind, concat('https://s/', CAST(o_orderkey AS VARCHAR(20))) AS page_url,
       concat('seen ', CAST(o_orderkey AS VARCHAR(20))) AS evidence
FROM {{orders}}
"""
BOXES = f"""
SELECT o_custkey AS store_id, concat(CASE WHEN o_totalprice < 100000 THEN 'anna.nowak' WHEN o_totalprice < 200000 THEN 'jzak' WHEN o_totalprice < 300000 THEN 'e.lis' WHEN o_totalprice < 400000 THEN 'info' ELSE 'lukasz-wojcik+x' END,
       '@', CASE o_orderstatus WHEN 'F' THEN concat('shop', CAST(o_custkey AS VARCHAR(20)), '.pl') ELSE 'mail.pl' END) AS email,
       CASE WHEN o_totalprice BETWEEN 300000 AND 400000 THEN 'generic' ELSE 'personal' END AS bucket, max(CASE WHEN o_orderpriority < '3' THEN 'mailto' ELSE 'text' END) AS source,
       o_orderstatus = 'F' AS own_domain, min(CASE WHEN o_orderpriority < '4' THEN 'contact' ELSE 'home' END) AS page_kind, min(concat('https://s/', CAST(o_orderkey AS VARCHAR(20)))) AS page_url, 'text around' AS evidence,
       concat('shop', CAST(o_custkey AS VARCHAR(20)), '.pl') AS store_domain
FROM {{orders}} GROUP BY 1, 2, 3, 5, 8, 9
"""
BOX_ORDER = "(bucket <> 'personal', NOT own_domain, CASE source WHEN 'mailto' THEN 0 ELSE 3 END, CASE page_kind WHEN 'contact' THEN 0 ELSE 2 END, email)"
KEYED = """
SELECT p.*, k FROM (SELECT *, trim(regexp_replace(replace(lower(strip_accents(name)), 'ł', 'l'), '[^a-z]+', ' ', 'g')) AS k FROM people) p
"""
BEST_BOX = f"""
SELECT store_id, k, arg_min(email, {BOX_ORDER}) AS mailbox FROM (SELECT DISTINCT n.store_id, n.k, e.email, e.bucket, e.own_domain, e.source, e.page_kind
  FROM (SELECT DISTINCT store_id, k FROM ({KEYED})) n JOIN (SELECT *, trim(regexp_replace(regexp_replace(lower(email), '(\\+[^@]*)?@.*$', ''), '[^a-z]+', ' ', 'g')) AS b FROM boxes) e
  ON e.store_id = n.store_id AND (e.b = n.k OR e.b = concat(n.k[1], ' ', split_part(n.k, ' ', 2)) OR e.b = concat(n.k[1], split_part(n.k, ' ', 2)))) GROUP BY 1, 2
"""


@registry.add(
    "match_people_to_mailboxes",
    st.with_tables(f"SELECT p.person_id, p.name, b.mailbox FROM ({KEYED}) p LEFT JOIN ({BEST_BOX}) b ON b.store_id = p.store_id AND b.k = p.k", people=PEOPLE, boxes=BOXES),
)
def match_people_to_mailboxes(spark, sf):
    return contacts.match_people_to_mailboxes(run_sql(spark, sf, PEOPLE), run_sql(spark, sf, BOXES)).select("person_id", "name", "mailbox")


@registry.add(
    "people_from_mailboxes",
    st.with_tables(
        """SELECT store_id, email, CASE WHEN email LIKE 'anna%' THEN 'Anna Nowak' ELSE 'Lukasz Wojcik' END AS name FROM boxes WHERE email LIKE 'anna%' OR email LIKE 'lukasz%'""", boxes=BOXES
    ),
)
def people_from_mailboxes(spark, sf):
    found = contacts.people_from_mailboxes(run_sql(spark, sf, BOXES))
    return found.select("store_id", F.regexp_replace("evidence", "^derived from ", "").alias("email"), "name")


def confirmed(spark, sf):
    pages = run_sql(spark, sf, PEOPLE).withColumn("page_id", F.col("person_id")).withColumn("pos", F.lit(0))
    return contacts.confirm_people(pages, run_sql(spark, sf, BOXES))


CONFIRMED = f"""
WITH said AS (SELECT store_id, name, role, source, page_kind, page_url, 0 AS f, person_id AS s FROM people WHERE name NOT LIKE '%Sklep'
    UNION ALL SELECT store_id, CASE WHEN email LIKE 'anna%' THEN 'Anna Nowak' ELSE 'Lukasz Wojcik' END, NULL, 'email_local', page_kind, page_url, 1, 0 FROM boxes WHERE email LIKE 'anna%' OR email LIKE 'lukasz%'),
best AS (SELECT *, trim(replace(lower(strip_accents(name)), 'ł', 'l')) AS k FROM said
    QUALIFY row_number() OVER (PARTITION BY store_id, replace(lower(strip_accents(name)), 'ł', 'l') ORDER BY role IS NULL, CASE source WHEN 'jsonld' THEN 0 WHEN 'role_text' THEN 1 ELSE 3 END, f, s, name) = 1),
fine AS (SELECT b.store_id, b.name, b.role, b.source, b.page_kind, m.mailbox, b.k FROM best b LEFT JOIN ({BEST_BOX.replace(f'({KEYED})', 'best')}) m ON m.store_id = b.store_id AND m.k = b.k
    WHERE source IN ('jsonld', 'email_local') OR m.mailbox IS NOT NULL OR role <> 'Other')
"""


@registry.add("confirm_people", st.with_tables(CONFIRMED + "SELECT store_id, k AS name_key, role, source, mailbox FROM fine", people=PEOPLE, boxes=BOXES))
def confirm_people(spark, sf):
    pages = run_sql(spark, sf, PEOPLE).withColumn("page_id", F.col("person_id")).withColumn("pos", F.lit(0))
    return contacts.confirm_people(pages, run_sql(spark, sf, BOXES)).select("store_id", "name_key", "role", "source", "mailbox")


SCORED = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'jsonld' WHEN 'O' THEN 'role_text' ELSE 'email_local' END AS person_source, CASE WHEN o_totalprice > 250000 THEN 'CEO' END AS person_role,
       CASE WHEN o_totalprice > 150000 THEN 'a@b.pl' END AS person_mailbox, CASE WHEN o_orderpriority < '2' THEN 'about' ELSE 'privacy' END AS person_page,
       CASE WHEN o_orderpriority < '3' THEN 'mailto' WHEN o_orderpriority < '4' THEN 'text' END AS email_source, o_totalprice < 300000 AS own_domain, CASE WHEN o_totalprice < 60000 THEN 'contact' ELSE 'home' END AS email_page,
       CASE WHEN o_custkey > 500 THEN concat('shop', CAST(o_custkey AS VARCHAR(20)), '-pl') WHEN o_custkey > 200 THEN 'anna-nowak' END AS link_slug, CASE WHEN o_totalprice < 200000 THEN 'company' ELSE 'profile' END AS link_kind,
       concat('shop', CAST(o_custkey AS VARCHAR(20)), '.pl') AS store_domain, o_custkey, o_totalprice
FROM {orders}
"""


@registry.add(
    "contact_confidence",
    st.with_tables(
        """SELECT id, floor(greatest(0, least(1, CASE person_source WHEN 'jsonld' THEN 0.45 WHEN 'role_text' THEN 0.35 ELSE 0.2 END + CASE WHEN email_source = 'mailto' THEN 0.08 ELSE 0 END
        + CASE WHEN email_source IS NULL THEN 0 WHEN own_domain THEN 0.15 ELSE -0.08 END + CASE WHEN email_source IS NOT NULL AND email_page = 'contact' THEN 0.04 ELSE 0 END
        + CASE WHEN person_role IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN person_mailbox IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN email_source IS NULL AND person_page = 'about' THEN 0.04 ELSE 0 END
        + CASE WHEN link_slug IS NOT NULL AND link_kind = 'profile' THEN 0.08 ELSE 0 END + CASE WHEN link_slug LIKE 'shop%' THEN 0.04 ELSE 0 END)) * 100 + 0.5) / 100 AS confidence FROM s""",
        s=SCORED,
    ),
)
def contact_confidence(spark, sf):
    rows = run_sql(spark, sf, SCORED)
    return rows.select("id", contacts.contact_confidence(rows).alias("confidence"))


@registry.add(
    "brand_match",
    st.with_tables(
        """SELECT id, coalesce(link_slug LIKE 'shop%', false) AS slug_matches, o_totalprice > 300000 AS text_mentions FROM s""", s=SCORED
    ),
)
def brand_match(spark, sf):
    rows = run_sql(spark, sf, SCORED)
    text = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("Owner at SHÓP "), F.col("o_custkey").cast("string"), F.lit(" PL"))).otherwise(F.lit("Owner elsewhere"))
    return rows.select(
        "id",
        F.coalesce(mail.slug_matches_brand(F.col("link_slug"), F.col("store_domain")), F.lit(False)).alias("slug_matches"),
        mail.text_mentions_brand(text, F.col("store_domain")).alias("text_mentions"),
    )


STORES = "SELECT c_custkey AS store_id, concat('shop', CAST(c_custkey AS VARCHAR(20)), '.pl') AS store_domain FROM {customer}"
LINKS = """
SELECT o_custkey AS store_id, min(CASE WHEN o_orderpriority < '3' THEN 'contact' ELSE 'home' END) AS page_kind, min(concat('https://s/', CAST(o_orderkey AS VARCHAR(20)))) AS page_url,
       concat('https://www.linkedin.com/', CASE WHEN o_totalprice > 450000 THEN 'in/p' ELSE 'company/c' END, CAST(month(o_orderdate) AS VARCHAR(9))) AS link,
       CASE WHEN o_totalprice > 450000 THEN 'profile' ELSE 'company' END AS link_kind, concat(CASE WHEN o_totalprice > 450000 THEN 'p' ELSE 'c' END, CAST(month(o_orderdate) AS VARCHAR(9))) AS slug
FROM {orders} WHERE o_orderstatus = 'P' GROUP BY 1, 4, 5, 6
"""
SEARCHED = f"""
SELECT o_custkey AS store_id, o_orderkey AS seen, concat({FIRST}, ' ', {LAST}) AS name, CASE WHEN o_totalprice > 100000 THEN 'Owner' END AS role, CASE WHEN o_totalprice > 100000 THEN 'owner' END AS role_text,
       concat('https://www.linkedin.com/in/s', CAST(o_orderkey AS VARCHAR(20))) AS link, concat('s', CAST(o_orderkey AS VARCHAR(20))) AS slug, 'q' AS query, 'found' AS evidence
FROM {{orders}} WHERE o_orderstatus = 'O' AND o_orderpriority < '3'
"""
COMPANIES = "SELECT s_suppkey * 3 AS store_id, concat('https://www.linkedin.com/company/x', CAST(s_suppkey AS VARCHAR(9))) AS link, concat('x', CAST(s_suppkey AS VARCHAR(9))) AS slug FROM {supplier}"
FIRST_LINK = "(SELECT * FROM links WHERE link_kind = '{k}' QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY CASE page_kind WHEN 'contact' THEN 0 ELSE 2 END, link) = 1)"
CANDIDATES = (
    CONFIRMED
    + f""", own AS (SELECT f.*, l.link, CASE WHEN b.email IS NOT NULL THEN f.mailbox END AS email FROM fine f LEFT JOIN {FIRST_LINK.format(k='profile')} l ON l.store_id = f.store_id
        LEFT JOIN boxes b ON b.store_id = f.store_id AND b.email = f.mailbox AND b.bucket = 'personal'),
    sk AS (SELECT *, replace(lower(strip_accents(name)), 'ł', 'l') AS k FROM searched),
    fill AS (SELECT * FROM sk QUALIFY row_number() OVER (PARTITION BY store_id, k ORDER BY seen) = 1),
    named AS (SELECT o.store_id, o.name, CASE WHEN o.link IS NULL AND o.role IS NULL THEN coalesce(f.role, o.role) ELSE o.role END AS role, o.email, coalesce(o.link, f.link) AS linkedin_url, false AS is_generic
        FROM own o LEFT JOIN fill f ON f.store_id = o.store_id AND f.k = o.k),
    alone AS (SELECT s.store_id, s.name, s.role, CAST(NULL AS VARCHAR) AS email, s.link AS linkedin_url, false AS is_generic FROM sk s WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.store_id = s.store_id AND o.k = s.k)),
    loose AS (SELECT b.store_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS role, b.email, CAST(NULL AS VARCHAR) AS linkedin_url, b.bucket = 'generic' AS is_generic FROM boxes b
        WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.store_id = b.store_id AND n.email = b.email)),
    firm AS (SELECT s.store_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS email, coalesce(l.link, c.link) AS linkedin_url, false AS is_generic FROM stores s
        LEFT JOIN {FIRST_LINK.format(k='company')} l ON l.store_id = s.store_id LEFT JOIN companies c ON c.store_id = s.store_id
        WHERE coalesce(l.link, c.link) IS NOT NULL AND s.store_id NOT IN (SELECT store_id FROM named WHERE linkedin_url IS NOT NULL UNION ALL SELECT store_id FROM alone)),
    everyone AS (SELECT * FROM named UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM loose UNION ALL SELECT * FROM firm)"""
)
CANDIDATE_RELATIONS = {"people": PEOPLE, "boxes": BOXES, "stores": STORES, "links": LINKS, "searched": SEARCHED, "companies": COMPANIES}


def candidates(spark, sf):
    pages = run_sql(spark, sf, PEOPLE).withColumn("page_id", F.col("person_id")).withColumn("pos", F.lit(0))
    people = contacts.confirm_people(pages, run_sql(spark, sf, BOXES))
    return contacts.union_candidates(
        run_sql(spark, sf, STORES), people, run_sql(spark, sf, SEARCHED), run_sql(spark, sf, BOXES), run_sql(spark, sf, LINKS), run_sql(spark, sf, COMPANIES)
    )


@registry.add("union_candidates", st.with_tables(CANDIDATES + " SELECT store_id, name, role, email, linkedin_url, is_generic FROM everyone", **CANDIDATE_RELATIONS))
def union_candidates(spark, sf):
    return candidates(spark, sf).select("store_id", "name", "role", "email", "linkedin_url", "is_generic")


@registry.add(
    "collect_store_contacts",
    st.with_tables(
        CONFIRMED
        + """SELECT s.store_id, coalesce(e.p, 0) AS personal_emails, coalesce(e.g, 0) AS generic_emails, coalesce(l.n, 0) AS profile_links, coalesce(f.n, 0) AS people,
        coalesce(e.p, 0) + coalesce(e.g, 0) + coalesce(l.n, 0) + coalesce(f.n, 0) = 0 AS empty
        FROM stores s LEFT JOIN (SELECT store_id, count(*) FILTER (bucket = 'personal') AS p, count(*) FILTER (bucket = 'generic') AS g FROM boxes GROUP BY 1) e USING (store_id)
        LEFT JOIN (SELECT store_id, count(*) AS n FROM links GROUP BY 1) l USING (store_id) LEFT JOIN (SELECT store_id, count(*) AS n FROM fine GROUP BY 1) f USING (store_id)""",
        **CANDIDATE_RELATIONS,
    ),
)
def collect_store_contacts(spark, sf):
    pages = run_sql(spark, sf, PEOPLE).withColumn("page_id", F.col("person_id")).withColumn("pos", F.lit(0))
    boxes = run_sql(spark, sf, BOXES)
    return contacts.collect_store_contacts(run_sql(spark, sf, STORES), boxes, run_sql(spark, sf, LINKS), contacts.confirm_people(pages, boxes))


@registry.add(
    "evidence_lists",
    st.with_tables(
        """SELECT store_id, kind, CAST(floor((rn - 1) / 2) AS BIGINT) AS part, string_agg(item, ' ' ORDER BY rn) AS items FROM (
        SELECT store_id, kind, item, row_number() OVER (PARTITION BY store_id, kind ORDER BY grade, item) AS rn FROM (
            SELECT store_id, concat(bucket, '_emails') AS kind, CASE source WHEN 'mailto' THEN 0 ELSE 3 END AS grade, email AS item FROM boxes
            UNION ALL SELECT store_id, 'profile_links', CASE link_kind WHEN 'profile' THEN 0 ELSE 1 END, link FROM links)) GROUP BY ALL""",
        boxes=BOXES,
        links=LINKS,
    ),
)
def evidence_lists(spark, sf):
    nobody = run_sql(spark, sf, PEOPLE).filter(F.lit(False))
    lists = contacts.evidence_lists(run_sql(spark, sf, BOXES), run_sql(spark, sf, LINKS), nobody, per_part=2)
    return lists.select("store_id", "kind", "part", F.array_join("items", " ").alias("items"))


@registry.add(
    "evidence_lists_with_people",
    st.with_tables(
        CONFIRMED
        + """SELECT store_id, kind, CAST(floor((rn - 1) / 2) AS BIGINT) AS part, string_agg(item, ' ' ORDER BY rn) AS items FROM (
        SELECT store_id, kind, item, row_number() OVER (PARTITION BY store_id, kind ORDER BY grade, item) AS rn FROM (
            SELECT store_id, concat(bucket, '_emails') AS kind, CASE source WHEN 'mailto' THEN 0 ELSE 3 END AS grade, email AS item FROM boxes
            UNION ALL SELECT store_id, 'profile_links', CASE link_kind WHEN 'profile' THEN 0 ELSE 1 END, link FROM links
            UNION ALL SELECT store_id, 'people', CASE WHEN role IS NULL THEN 1 ELSE 0 END, name FROM fine)) GROUP BY ALL""",
        people=PEOPLE,
        boxes=BOXES,
        links=LINKS,
    ),
)
def evidence_lists_with_people(spark, sf):
    lists = contacts.evidence_lists(run_sql(spark, sf, BOXES), run_sql(spark, sf, LINKS), confirmed(spark, sf), per_part=2)
    return lists.select("store_id", "kind", "part", F.array_join("items", " ").alias("items"))


PLAIN = """
SELECT o_orderkey AS contact_rank, o_custkey AS store_id, CASE WHEN o_orderpriority < '4' THEN concat('Person ', CAST(month(o_orderdate) AS VARCHAR(9))) END AS name, CASE WHEN o_totalprice > 300000 THEN 'CEO' END AS role,
       CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN concat('box', CAST(CAST(floor(o_totalprice / 300) AS BIGINT) AS VARCHAR(20)), '@mail', CAST(CAST(floor(o_totalprice / 40000) AS BIGINT) AS VARCHAR(20)), '.shop') END AS email,
       CASE WHEN o_orderstatus = 'F' THEN concat('https://www.linkedin.com/in/p', CAST(month(o_orderdate) AS VARCHAR(9))) END AS linkedin_url, 'footer' AS source, concat('u', CAST(o_orderkey AS VARCHAR(20))) AS source_url,
       floor(o_totalprice / 5100) / 100 AS confidence, o_orderpriority = '4-NOT SPECIFIED' AS is_generic
FROM {orders}
"""
SHOPS = "SELECT c_custkey AS store_id, concat('customer-', right(concat('000000000', CAST(c_custkey AS VARCHAR(20))), 9), '.shop') AS store_domain FROM {customer}"
SUPPRESSED = """(EXISTS (SELECT 1 FROM supp s WHERE s.email = lower(c.email)) OR EXISTS (SELECT 1 FROM supp s WHERE s.domain = regexp_replace(lower(c.email), '^[^@]*@', '')) OR EXISTS (SELECT 1 FROM supp s WHERE s.domain = h.store_domain))"""
KEPT = f"SELECT c.*, h.store_domain FROM c JOIN shops h USING (store_id) WHERE NOT {SUPPRESSED}"
UNIQUE = """
SELECT * FROM (SELECT *, coalesce('@' || email, 'n' || lower(name)) AS k FROM kept WHERE coalesce(email, name, linkedin_url) IS NOT NULL)
QUALIFY k IS NULL OR row_number() OVER (PARTITION BY store_id, k ORDER BY contact_rank) = 1
"""
SAVE = f"""
WITH kept AS ({KEPT}), uniq AS ({UNIQUE}),
pool AS (SELECT DISTINCT store_id, email FROM (SELECT store_id, email FROM held WHERE store_id NOT IN (SELECT store_id FROM c) UNION ALL SELECT store_id, email FROM uniq) WHERE email IS NOT NULL),
elsewhere AS (SELECT email, count(*) AS n FROM pool GROUP BY 1),
flagged AS (SELECT u.* EXCLUDE (confidence), coalesce(e.n - 1, 0) >= 3 AS is_shared, CASE WHEN coalesce(e.n - 1, 0) >= 3 THEN floor(confidence * 0.5 * 100 + 0.5) / 100 ELSE confidence END AS confidence FROM uniq u LEFT JOIN elsewhere e USING (email)),
done AS (SELECT *, contact_rank = coalesce(min(CASE WHEN NOT is_generic THEN contact_rank END) OVER (PARTITION BY store_id), first_value(contact_rank) OVER (PARTITION BY store_id ORDER BY confidence DESC, contact_rank)) AS is_primary FROM flagged)
"""
HELD = "SELECT user_id + 5000 AS store_id, event_id AS id, concat('box', CAST(CAST(floor(value * 8) AS BIGINT) AS VARCHAR(20)), '@mail0.shop') AS email FROM {events}"
SAVE_RELATIONS = {"c": PLAIN, "supp": st.SUPPRESSIONS, "shops": SHOPS, "held": HELD}


def _kept(spark, sf):
    rows = run_sql(spark, sf, PLAIN).join(run_sql(spark, sf, SHOPS), "store_id")
    return contacts.drop_suppressed(rows, run_sql(spark, sf, st.SUPPRESSIONS))


@registry.add("rank_contacts", st.with_tables(
    """SELECT store_id, source_url, contact_rank FROM (SELECT *  EXCLUDE (contact_rank), row_number() OVER (PARTITION BY store_id ORDER BY is_generic, name IS NULL, role IS NULL, confidence DESC, coalesce(email, linkedin_url, ''), coalesce(name, ''), source_url) AS contact_rank FROM c)""", c=PLAIN))
def rank_contacts(spark, sf):
    return contacts.rank_contacts(run_sql(spark, sf, PLAIN).drop("contact_rank")).select("store_id", "source_url", "contact_rank")


@registry.add("drop_suppressed", st.with_tables(f"SELECT contact_rank FROM ({KEPT})", **SAVE_RELATIONS))
def drop_suppressed(spark, sf):
    return _kept(spark, sf)[0].select("contact_rank")


@registry.add("suppressed_contacts", st.with_tables(f"SELECT contact_rank FROM c JOIN shops h USING (store_id) WHERE {SUPPRESSED}", **SAVE_RELATIONS))
def suppressed_contacts(spark, sf):
    return _kept(spark, sf)[1].select("contact_rank")


@registry.add("dedupe_candidates", st.with_tables(f"WITH kept AS (SELECT * FROM c) SELECT contact_rank FROM ({UNIQUE})", c=PLAIN))
def dedupe_candidates(spark, sf):
    return contacts.dedupe_candidates(run_sql(spark, sf, PLAIN)).select("contact_rank")


@registry.add(
    "flag_shared_mailboxes",
    st.with_tables(
        """WITH pool AS (SELECT DISTINCT store_id, email FROM c WHERE email IS NOT NULL), n AS (SELECT email, count(*) AS n FROM pool GROUP BY 1)
        SELECT contact_rank, coalesce(n.n - 1, 0) AS stores_elsewhere, coalesce(n.n - 1, 0) >= 3 AS is_shared,
        CASE WHEN coalesce(n.n - 1, 0) >= 3 THEN floor(confidence * 0.5 * 100 + 0.5) / 100 ELSE confidence END AS confidence FROM c LEFT JOIN n USING (email)""",
        c=PLAIN,
    ),
)
def flag_shared_mailboxes(spark, sf):
    rows = run_sql(spark, sf, PLAIN)
    return contacts.flag_shared_mailboxes(rows, rows).select("contact_rank", "stores_elsewhere", "is_shared", "confidence")


@registry.add(
    "mark_primary",
    st.with_tables(
        """SELECT contact_rank, contact_rank = coalesce(min(CASE WHEN NOT is_generic THEN contact_rank END) OVER (PARTITION BY store_id),
        first_value(contact_rank) OVER (PARTITION BY store_id ORDER BY confidence DESC, contact_rank)) AS is_primary FROM c""",
        c=PLAIN,
    ),
)
def mark_primary(spark, sf):
    return contacts.mark_primary(run_sql(spark, sf, PLAIN)).select("contact_rank", "is_primary")


def _saved(spark, sf):
    held = run_sql(spark, sf, HELD).withColumn("contact_rank", F.lit(None).cast("bigint")).withColumn("confidence", F.lit(None).cast("double")).withColumn("is_primary", F.lit(None).cast("boolean"))
    return contacts.save_contacts(held, run_sql(spark, sf, PLAIN), run_sql(spark, sf, st.SUPPRESSIONS), run_sql(spark, sf, SHOPS))


@registry.add(
    "save_contacts",
    st.with_tables(SAVE + "SELECT store_id, email, contact_rank, confidence, is_primary FROM done UNION ALL SELECT store_id, email, NULL, NULL, NULL FROM held WHERE store_id NOT IN (SELECT store_id FROM c)", **SAVE_RELATIONS),
)
def save_contacts(spark, sf):
    return _saved(spark, sf)[0].select("store_id", "email", "contact_rank", "confidence", "is_primary")


@registry.add(
    "save_contacts_counts",
    st.with_tables(
        SAVE + f"""SELECT b.store_id, coalesce(d.n, 0) AS written, coalesce(k.n, 0) - coalesce(d.n, 0) AS duplicates, coalesce(d.shared, 0) AS shared, coalesce(x.n, 0) AS suppressed
        FROM (SELECT DISTINCT store_id FROM c) b LEFT JOIN (SELECT store_id, count(*) AS n, count(*) FILTER (is_shared) AS shared FROM done GROUP BY 1) d USING (store_id)
        LEFT JOIN (SELECT store_id, count(*) AS n FROM kept WHERE coalesce(email, name, linkedin_url) IS NOT NULL GROUP BY 1) k USING (store_id)
        LEFT JOIN (SELECT store_id, count(*) AS n FROM c JOIN shops h USING (store_id) WHERE {SUPPRESSED} GROUP BY 1) x USING (store_id)""",
        **SAVE_RELATIONS,
    ),
)
def save_contacts_counts(spark, sf):
    return _saved(spark, sf)[1]


REQUESTS = "SELECT email, domain, reason FROM (SELECT ' ' || upper(email) AS email, CASE WHEN domain IS NULL THEN NULL ELSE concat('https://', domain, '/x') END AS domain, reason FROM (" + st.SUPPRESSIONS + ") s) r WHERE email IS NOT NULL OR domain IS NOT NULL"
OLD_SUPP = "SELECT s_suppkey + 100 AS id, CAST(NULL AS VARCHAR(20)) AS email, concat('mail', CAST(s_nationkey AS VARCHAR(9)), '.shop') AS domain, 'manual' AS reason FROM {supplier} WHERE s_suppkey < 4"
ASKED = "(SELECT DISTINCT lower(trim(email)) AS email, regexp_replace(regexp_replace(domain, '^https://', ''), '/x$', '') AS domain FROM r)"


def _forgotten(spark, sf):
    return contacts.forget(run_sql(spark, sf, PLAIN), run_sql(spark, sf, OLD_SUPP), run_sql(spark, sf, REQUESTS), run_sql(spark, sf, SHOPS))


@registry.add("forget_contacts", st.with_tables(f"WITH supp AS {ASKED} SELECT contact_rank FROM c JOIN shops h USING (store_id) WHERE NOT {SUPPRESSED}", c=PLAIN, r=REQUESTS, shops=SHOPS))
def forget_contacts(spark, sf):
    return _forgotten(spark, sf)[0].select("contact_rank")


@registry.add(
    "forget_suppressions",
    st.with_tables(f"SELECT email, domain FROM old UNION ALL SELECT email, domain FROM {ASKED} a WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.email IS NOT DISTINCT FROM a.email AND o.domain IS NOT DISTINCT FROM a.domain)", old=OLD_SUPP, r=REQUESTS),
)
def forget_suppressions(spark, sf):
    return _forgotten(spark, sf)[1].select("email", "domain")


@registry.add("purge_expired", st.with_tables("SELECT id FROM contacts WHERE created_at >= TIMESTAMP '1999-01-01' - INTERVAL 180 DAY", contacts=st.CONTACTS))
def purge_expired(spark, sf):
    return contacts.purge_expired(run_sql(spark, sf, st.CONTACTS), dt.datetime(1999, 1, 1)).select("id")


LIFTED = "SELECT concat(' MAIL', CAST(n_nationkey AS VARCHAR(9)), '.shop ') AS identifier FROM {nation} WHERE n_nationkey < 9"


@registry.add(
    "unsuppress",
    st.with_tables("SELECT id FROM supp WHERE (domain IS NULL OR domain NOT IN (SELECT lower(trim(identifier)) FROM l)) AND (email IS NULL OR email NOT IN (SELECT lower(trim(identifier)) FROM l))", supp=st.SUPPRESSIONS, l=LIFTED),
)
def unsuppress(spark, sf):
    return contacts.unsuppress(run_sql(spark, sf, st.SUPPRESSIONS), run_sql(spark, sf, LIFTED)).select("id")


HITS = f"""
SELECT o_custkey AS store_id, o_orderkey AS pos, CAST(month(o_orderdate) % 3 AS INT) AS query_no, 'q' AS query, concat('zebra', CAST(o_custkey AS VARCHAR(20)), '.pl') AS store_domain, 'Zebra House' AS brand,
       concat('https://pl.linkedin.com/in/', lower({FIRST.replace('Łukasz', 'Lukasz')}), '-', CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR(9))) AS url, concat(CASE WHEN o_orderstatus = 'F' THEN 'Zebra' ELSE {FIRST} END, ' Nowak - ',
       CASE WHEN o_totalprice > 300000 THEN 'CEO at Zebra House' WHEN o_totalprice > 200000 THEN 'Zebra House' WHEN o_totalprice > 150000 THEN 'CEO at Other' ELSE 'Zebra house team' END, ' | LinkedIn') AS title,
       CASE WHEN o_orderpriority < '2' THEN 'Adam Kot, owner of the shop' WHEN o_orderpriority < '4' THEN 'Works as owner there' END AS snippet, o_totalprice, o_orderpriority, o_orderstatus, {FIRST} AS first
FROM {{orders}}
"""
READ = """
SELECT store_id, query_no, pos, concat(CASE WHEN o_orderstatus = 'F' THEN 'Zebra' ELSE first END, ' Nowak') AS name, CASE WHEN o_totalprice > 300000 THEN 'CEO' WHEN o_orderpriority >= '2' AND o_orderpriority < '4' THEN 'Owner' END AS role, regexp_extract(url, '/in/(.*)$', 1) AS slug
FROM h WHERE NOT (o_totalprice > 150000 AND o_totalprice <= 200000)
"""


def read_hits(spark, sf):
    return search.read_search_people(spread(run_sql(spark, sf, HITS)))


@registry.add("read_search_people", st.with_tables(f"SELECT store_id, query_no, pos, name, role, slug FROM ({READ})", h=HITS))
def read_search_people(spark, sf):
    return read_hits(spark, sf).select("store_id", "query_no", "pos", "name", "role", "slug")


BEST_HIT = f"""SELECT * FROM (SELECT * FROM ({READ}) QUALIFY row_number() OVER (PARTITION BY store_id, slug, query_no ORDER BY CASE role WHEN 'CEO' THEN 0 WHEN 'Owner' THEN 2 ELSE 8 END, name, pos) = 1)
QUALIFY row_number() OVER (PARTITION BY store_id, slug ORDER BY query_no) = 1"""


@registry.add("best_search_person", st.with_tables(f"SELECT store_id, slug, query_no, pos, role FROM ({BEST_HIT})", h=HITS))
def best_search_person(spark, sf):
    return search.best_search_person(read_hits(spark, sf)).select("store_id", "slug", "query_no", "pos", "role")


@registry.add(
    "stop_after_first_titled",
    st.with_tables(
        f"SELECT h.store_id, h.pos FROM h LEFT JOIN (SELECT store_id, min(query_no) AS s FROM ({READ}) WHERE role IS NOT NULL GROUP BY 1) t USING (store_id) WHERE s IS NULL OR query_no <= s", h=HITS
    ),
)
def stop_after_first_titled(spark, sf):
    return search.stop_after_first_titled(spread(run_sql(spark, sf, HITS)), read_hits(spark, sf)).select("store_id", "pos")


FIRM_HITS = """
SELECT o_custkey AS store_id, o_orderkey AS pos, 0 AS query_no, concat('zebra', CAST(o_custkey AS VARCHAR(20)), '.pl') AS store_domain, 'Zebra House' AS brand,
       concat('https://www.linkedin.com/company/', CASE WHEN o_orderstatus = 'F' THEN concat('zebra', CAST(o_custkey AS VARCHAR(20))) ELSE concat('firm', CAST(o_orderkey AS VARCHAR(20))) END) AS url,
       CASE WHEN o_totalprice > 300000 THEN 'Zebra House | LinkedIn' ELSE 'Firm' END AS title, o_orderstatus, o_totalprice FROM {orders}
"""


@registry.add(
    "find_company_pages",
    st.with_tables("SELECT store_id, arg_min(regexp_extract(url, '/company/(.*)$', 1), pos) AS slug FROM h WHERE o_orderstatus = 'F' OR o_totalprice > 300000 GROUP BY 1", h=FIRM_HITS),
)
def find_company_pages(spark, sf):
    return search.find_company_pages(run_sql(spark, sf, FIRM_HITS)).select("store_id", "slug")


CLAIMED = """
SELECT l_suppkey AS search_id, l_orderkey * 10 + l_linenumber AS pos, concat('https://WWW.Shop', CAST(l_partkey AS VARCHAR(20)), '.pl/A/', CASE WHEN l_linestatus = 'O' THEN '/' ELSE '?q=1' END) AS url, l_returnflag AS title, 's' AS snippet, l_partkey AS part_id FROM {lineitem}
"""
REACHED = "SELECT ps AS search_id, concat('http://shop', CAST(p_partkey AS VARCHAR(20)), '.pl/a') AS url, CASE WHEN p_size > 25 THEN p_name END AS title, p_partkey AS part_id FROM (SELECT *, p_size AS ps FROM {part}) x"


@registry.add(
    "ground_search_hits",
    st.with_tables(
        """SELECT search_id, part_id, title FROM (SELECT c.search_id, c.part_id, min(c.pos) AS pos, coalesce(any_value(r.title), arg_min(c.title, c.pos)) AS title FROM c JOIN r ON r.search_id = c.search_id AND r.part_id = c.part_id GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY pos) <= 5""",
        c=CLAIMED,
        r=REACHED,
    ),
)
def ground_search_hits(spark, sf):
    kept = search.ground_search_hits(run_sql(spark, sf, CLAIMED), run_sql(spark, sf, REACHED))[0]
    return kept.select("search_id", F.regexp_extract("url", "Shop([0-9]+)", 1).cast("bigint").alias("part_id"), "title")


@registry.add(
    "dropped_search_hits",
    st.with_tables("SELECT search_id, count(*) AS dropped FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.search_id = c.search_id AND r.part_id = c.part_id) GROUP BY 1", c=CLAIMED, r=REACHED),
)
def dropped_search_hits(spark, sf):
    return search.ground_search_hits(run_sql(spark, sf, CLAIMED), run_sql(spark, sf, REACHED))[1]


@registry.add(
    "surplus_search_hits",
    st.with_tables(
        "SELECT search_id, count(DISTINCT c.part_id) - 5 AS surplus FROM c JOIN r USING (search_id, part_id) GROUP BY 1 HAVING count(DISTINCT c.part_id) > 5",
        c=CLAIMED,
        r=REACHED,
    ),
)
def surplus_search_hits(spark, sf):
    return search.surplus_search_hits(run_sql(spark, sf, CLAIMED), run_sql(spark, sf, REACHED))


QUOTED = """
SELECT doc_id AS person_no, source AS store_id, concat(source, '.pl') AS store_domain, CASE WHEN lang = 'en' THEN 'Anna Nowak' WHEN lang = 'de' THEN 'Sklep Nowak' ELSE 'Jan Lis' END AS name, CASE WHEN n_chars > 500 THEN 'CEO' ELSE '' END AS role,
       concat(CASE WHEN lang = 'fr' THEN 'Somebody' WHEN lang = 'en' THEN 'Anna  Nowak' WHEN lang = 'de' THEN 'Sklep Nowak' ELSE 'jan lis' END, ' runs shop ', CAST(doc_id AS VARCHAR(20))) AS quote, lang FROM {documents}
"""
QUOTE_PAGES = """
SELECT 2 * doc_id AS page_no, source AS store_id, 'about' AS kind, concat('https://s/', CAST(doc_id AS VARCHAR(20))) AS url,
       concat(text, ' (', CASE WHEN lang = 'en' THEN 'Anna Nowak' ELSE 'JAN LIS' END, ' runs ', CASE WHEN n_chars > 900 THEN concat('shop ', CAST(doc_id AS VARCHAR(20)), ')') ELSE '' END) AS text FROM {documents}
UNION ALL
SELECT 2 * doc_id + 1, source, 'contact', concat('https://c/', CAST(doc_id AS VARCHAR(20))), CASE WHEN n_chars % 3 = 0 THEN 'shop' ELSE concat(' Shop  ', CAST(doc_id AS VARCHAR(20)), ' and more') END FROM {documents} WHERE n_chars <= 900
"""


@registry.add(
    "ground_quotes",
    st.with_tables(
        """SELECT q.store_id, person_no, CASE WHEN lang = 'de' THEN 'rejected' WHEN NOT ok THEN 'ungrounded' WHEN person_no <> min(CASE WHEN ok AND lang <> 'de' THEN person_no END) OVER (PARTITION BY q.store_id, name) THEN 'repeated' ELSE 'grounded' END AS verdict
        FROM (SELECT *, lang <> 'fr' AND EXISTS (SELECT 1 FROM h WHERE h.store_id = q.store_id AND contains(h.text, regexp_replace(lower(q.quote), '\\s+', ' ', 'g'))) AS ok FROM q) q""",
        q=QUOTED,
        p=QUOTE_PAGES,
        h="SELECT store_id, regexp_replace(lower(string_agg(text, ' ' ORDER BY page_no)), '\\s+', ' ', 'g') AS text FROM p GROUP BY 1",
    ),
)
def ground_quotes(spark, sf):
    return contacts.ground_quotes(spread(run_sql(spark, sf, QUOTED)), spread(run_sql(spark, sf, QUOTE_PAGES))).select("store_id", "person_no", "verdict")


@registry.add(
    "check_constraints",
    st.with_tables(
        """SELECT 'unique' AS rule, 'letters(store_id, subject)' AS subject, count(*) AS violations FROM (SELECT 1 FROM letters GROUP BY store_id, subject HAVING count(*) > 1)
        UNION ALL SELECT 'reference', 'issues.store_id', count(*) FROM issues WHERE store_id NOT IN (SELECT store_id FROM letters)
        UNION ALL SELECT 'one_of', 'suppressions(email, domain)', count(*) FROM supp WHERE (email IS NULL) = (domain IS NULL)
        UNION ALL SELECT 'allowed', 'letters.status', count(*) FROM letters WHERE status NOT IN ('READY', 'APPROVED')""",
        letters=st.LETTERS,
        issues=st.ISSUES,
        supp=st.SUPPRESSIONS,
    ),
)
def check_constraints(spark, sf):
    letters, issues, supp = (run_sql(spark, sf, t) for t in (st.LETTERS, st.ISSUES, st.SUPPRESSIONS))
    return constraints.check_constraints(
        [
            constraints.duplicate_keys(letters, ["store_id", "subject"], "letters"),
            constraints.orphans(issues, "store_id", letters, "store_id", "issues"),
            constraints.not_exactly_one(supp, ["email", "domain"], "suppressions"),
            constraints.not_allowed(letters, "status", ["READY", "APPROVED"], "letters"),
        ]
    )
