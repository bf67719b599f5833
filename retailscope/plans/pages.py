"""Queries over fetched pages and their links."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.operators import extract, grading, links, tables
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, spread, table

registry = Registry()

#: Tasks a core for pages put together from small rows: a file of few bytes holds many of them.
PAGE_TASKS = 4


def fetched(spark, sf):
    return spread(table(spark, sf, "pages"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
BLOCKS = "br|p|li|ul|nav|div|article|h1|footer|body|html|head|title"
ENT = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
TEXT = (
    "trim(regexp_replace(" + ENT.format(x=f"regexp_replace(regexp_replace(regexp_replace({CLEAN}, '(?is)<head>.*</head>', ' '), '(?i)</?({BLOCKS})([^a-z0-9>][^>]*)?>', ' ', 'g'), '</?[a-zA-Z][^>]*>|<![^>]*>', '', 'g')")
    + ", '\\s+', ' ', 'g'))"
)


@registry.add("page_corpus", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages")
def page_corpus(spark, sf):
    return extract.read_page_corpus(spark, f"{sf}/pages.parquet").select("page_id", "host", "origin")


@registry.add("extract_page_text", f"SELECT page_id, {TEXT} AS text, 0 AS n_mailtos FROM pages")
def extract_page_text(spark, sf):
    return extract.extract_page_text(fetched(spark, sf)).select("page_id", "text", F.size("mailtos").alias("n_mailtos"))


LINKS = f"""
SELECT page_id, pos, href, text, concat(origin, href) AS absolute_url, true AS internal, false AS in_footer, origin
FROM (SELECT page_id, origin, unnest(range(len(a))) AS pos, unnest(list_transform(a, lambda x: regexp_extract(x, 'href="([^"]*)"', 1))) AS href,
             unnest(list_transform(a, lambda x: regexp_extract(x, '>(.*)</a>', 1))) AS text
      FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract_all({CLEAN}, '(?is)<a\\s[^>]*>.*?</a>') AS a FROM pages))
"""


@registry.add("extract_links", f"SELECT page_id, pos, href, text, absolute_url, internal, in_footer FROM ({LINKS})")
def extract_links(spark, sf):
    return extract.extract_links(fetched(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


TITLE = "nullif(trim(" + ENT.format(x=f"regexp_extract({CLEAN}, '(?is)<title>(.*?)</title>', 1)") + "), '')"
H1 = "nullif(trim(substr(trim(" + ENT.format(x=f"regexp_extract({CLEAN}, '(?is)<h1>(.*?)</h1>', 1)") + "), 1, 120)), '')"
SEO = f"""
SELECT page_id, url, {TITLE} AS title, CAST(NULL AS VARCHAR) AS description, CAST(len(regexp_extract_all({CLEAN}, '(?i)<h1>')) AS INT) AS h1_count, {H1} AS h1_text,
       CAST(NULL AS VARCHAR) AS canonical, regexp_extract({CLEAN}, '<html lang="([^"]*)"', 1) AS lang, false AS open_graph, 0 AS images,
       CAST(coalesce(length({TITLE}), 0) AS INT) AS title_length, 0 AS description_length, false AS noindex FROM pages
"""


@registry.add("extract_seo_facts", SEO)
def extract_seo_facts(spark, sf):
    return extract.extract_seo_facts(fetched(spark, sf)).drop("schema_types", "robots_meta", "images_with_alt")


@registry.add(
    "grade_extracted_seo",
    f"""SELECT page_id, title FROM (SELECT page_id, unnest([CASE WHEN title IS NULL THEN 'Page has no title tag' END,
        CASE WHEN title IS NOT NULL AND NOT title_length BETWEEN 15 AND 65 THEN 'Page title is the wrong length' END, 'Page has no meta description',
        CASE WHEN h1_count = 0 THEN 'Page has no H1 heading' END, CASE WHEN h1_count > 1 THEN 'Page has more than one H1' END, 'No canonical URL',
        CASE WHEN lang = '' THEN 'The page does not declare its language' END]) AS title FROM ({SEO})) WHERE title IS NOT NULL""",
)
def grade_extracted_seo(spark, sf):
    facts = extract.extract_seo_facts(fetched(spark, sf)).withColumn("page", F.lit("homepage"))
    return grading.grade_page_seo(facts, ["page_id"]).select("page_id", "title")


@registry.add(
    "extract_structure_facts",
    f"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all({CLEAN}, '(?is)<a\\s[^>]*>.*?</a>'))) AS INT) AS nav_links, true AS has_nav, false AS has_toggle, false AS has_search,
    false AS has_header, true AS has_footer, 0 AS footer_links FROM pages""",
)
def extract_structure_facts(spark, sf):
    facts = extract.extract_structure_facts(fetched(spark, sf)).withColumn("footer_links", F.size("footer_links"))
    return facts.select("page_id", "nav_links", "has_nav", "has_toggle", "has_search", "has_header", "has_footer", "footer_links")


LD_PAGES = """
SELECT p_partkey AS page_id, concat('https://s', CAST(p_size AS VARCHAR(9)), '.shop/products/', CAST(p_partkey AS VARCHAR(20)), '?v=1') AS url, p_size AS size,
       concat('<html><body><script type="application/ld+json">{"@type": "', CASE WHEN p_size < 20 THEN 'Product' ELSE 'Organization' END, '", "name": "', p_name,
              '", "contact": {"@type": ["ContactPoint", "Thing"], "Email": "mailto:Team', CAST(p_partkey AS VARCHAR(20)), '@', lower(p_type), '.shop"}}</script>',
              CASE WHEN p_size > 40 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END, '</body></html>') AS html
FROM {part}
"""


@registry.add(
    "extract_json_ld",
    st.with_tables(
        """SELECT page_id, CASE WHEN size < 20 THEN 'Product' ELSE 'Organization' END AS type, 1 AS n FROM p
        UNION ALL SELECT page_id, 'ContactPoint', 1 FROM p UNION ALL SELECT page_id, 'Thing', 1 FROM p""",
        p=LD_PAGES,
    ),
)
def extract_json_ld(spark, sf):
    nodes = extract.extract_json_ld(spread(run_sql(spark, sf, LD_PAGES)))
    return nodes.groupBy("page_id", "type").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _as_tables(spark, name: str, df, text: str):
    tables.register(spark)
    df.createOrReplaceTempView(name)
    return spark.sql(text)


@registry.add("page_links_table", f"SELECT page_id, pos, href, text, absolute_url, internal, in_footer FROM ({LINKS})")
def page_links_table(spark, sf):
    """``extract_links`` as a table function from SQL."""
    return _as_tables(spark, "fetched_pages", fetched(spark, sf), "SELECT p.page_id, CAST(l.pos AS BIGINT) AS pos, l.href, l.text, l.absolute_url, l.internal, l.in_footer FROM fetched_pages p, LATERAL page_links(p.html, p.url) l")


@registry.add(
    "page_json_ld_table",
    st.with_tables(
        """SELECT page_id, 0 AS pos, CASE WHEN size < 20 THEN 'Product' ELSE 'Organization' END AS type, name FROM p
        UNION ALL SELECT page_id, 1, 'ContactPoint', NULL FROM p UNION ALL SELECT page_id, 2, 'Thing', NULL FROM p""",
        p=LD_PAGES.replace("p_size AS size,", "p_size AS size, p_name AS name,"),
    ),
)
def page_json_ld_table(spark, sf):
    """``extract_json_ld`` as a table function from SQL."""
    return _as_tables(spark, "ld_pages", spread(run_sql(spark, sf, LD_PAGES)), "SELECT p.page_id, n.pos, n.type, get_json_object(n.node, '$.name') AS name FROM ld_pages p, LATERAL page_json_ld(p.html) n")


MAIL_PAGES = """
SELECT doc_id AS page_id, source AS store_id, concat(source, '.shop') AS store_domain, CASE WHEN lang = 'en' THEN 'contact' WHEN lang = 'fr' THEN 'about' ELSE 'home' END AS kind,
       concat('https://', source, '.shop/', CAST(doc_id AS VARCHAR(20))) AS url,
       concat(text, ' Write to Info', CAST(doc_id % 40 AS VARCHAR(9)), '@', source, '.shop or anna.k (at) ', source, ' [dot] pl now. jan at firma', CAST(doc_id % 9 AS VARCHAR(9)), ' dot com') AS text,
       text AS body, doc_id % 40 AS box, doc_id % 9 AS firm, source
FROM {documents}
"""
MAIL_RE = r"[a-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&''*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}"


def mails(spark, sf):
    pages = spread(run_sql(spark, sf, MAIL_PAGES)).withColumn("html", F.lit("")).withColumn("mailtos", F.array().cast("array<string>"))
    return extract.extract_emails(pages, ["page_id", "store_id"])


FOUND = f"""
SELECT page_id, store_id, store_domain, kind, email, 'text' AS source FROM (SELECT *, lower(unnest(regexp_extract_all(text, '(?i){MAIL_RE}'))) AS email FROM p)
WHERE NOT regexp_matches(email, '@(example\\.(com|org|net))$')
UNION ALL SELECT page_id, store_id, store_domain, kind, concat('anna.k@', store_id, '.pl'), 'obfuscated' FROM p
UNION ALL SELECT page_id, store_id, store_domain, kind, concat('jan@firma', firm, '.com'), 'obfuscated' FROM p
"""


@registry.add(
    "extract_emails",
    st.with_tables(
        f"""SELECT page_id, email, source, bucket, email LIKE concat('%@', store_domain) AS own_domain, kind AS page_kind
        FROM (SELECT *, CASE WHEN regexp_matches(email, '^info[0-9]*@') THEN 'generic' ELSE 'personal' END AS bucket FROM ({FOUND}))""",
        p=MAIL_PAGES,
    ),
)
def extract_emails(spark, sf):
    return mails(spark, sf).select("page_id", "email", "source", "bucket", "own_domain", "page_kind")


RANK_EMAIL = """row_number() OVER (PARTITION BY store_id, email ORDER BY CASE source WHEN 'mailto' THEN 0 WHEN 'jsonld' THEN 1 WHEN 'obfuscated' THEN 2 ELSE 3 END,
CASE kind WHEN 'contact' THEN 0 WHEN 'about' THEN 1 ELSE 2 END, page_id)"""


@registry.add(
    "strongest_email",
    st.with_tables(f"SELECT store_id, email, source, kind AS page_kind, page_id FROM ({FOUND}) QUALIFY {RANK_EMAIL} = 1", p=MAIL_PAGES),
)
def strongest_email(spark, sf):
    from retailscope.operators.contacts import strongest_email as strongest

    return strongest(mails(spark, sf), ["page_id", "pos"]).select("store_id", "email", "source", "page_kind", "page_id")


BOXES = """
SELECT o_orderkey AS id, concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'anna.nowak' WHEN '2-HIGH' THEN 'order-desk' WHEN '3-MEDIUM' THEN concat('shop', CAST(o_custkey AS VARCHAR(9)))
         WHEN '5-LOW' THEN 'b2b' ELSE 'jan+info' END, '@', CASE o_orderstatus WHEN 'F' THEN 'mail.' ELSE '' END, 'shop', CAST(o_custkey AS VARCHAR(20)), '.pl') AS email,
       concat('https://www.shop', CAST(CASE WHEN o_totalprice > 200000 THEN o_custkey ELSE 1 END AS VARCHAR(20)), '.pl') AS store_domain, o_orderpriority, o_orderstatus, o_custkey, o_totalprice
FROM {orders}
"""


@registry.add(
    "classify_mailboxes",
    st.with_tables(
        """SELECT id, email, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'generic' ELSE 'personal' END AS bucket,
        o_totalprice > 200000 OR o_custkey = 1 AS own_domain FROM b""",
        b=BOXES,
    ),
)
def classify_mailboxes(spark, sf):
    b = run_sql(spark, sf, BOXES)
    bucket = F.when(mail.is_generic_mailbox(F.col("email")), F.lit("generic")).otherwise(F.lit("personal"))
    return b.select("id", "email", bucket.alias("bucket"), mail.is_own_domain(F.col("email"), F.col("store_domain")).alias("own_domain"))


LINKED = """
SELECT o_orderkey AS page_id, o_custkey AS store_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'contact' WHEN '2-HIGH' THEN 'about' ELSE 'home' END AS kind,
       concat('https://s/', CAST(o_orderkey AS VARCHAR(20))) AS url,
       concat('<a href="https://pl.linkedin.com/in/Anna-', CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR(20)), '_">x</a> <a href="http://linkedin.com/company/dir/">y</a>',
              CASE WHEN o_orderstatus = 'F' THEN ' https://www.linkedin.com/company/acme.' ELSE '' END) AS html, o_totalprice, o_orderstatus FROM {orders}
"""
PROFILES = """
SELECT page_id, store_id, kind, concat('https://www.linkedin.com/in/anna-', CAST(floor(o_totalprice / 100000) AS BIGINT)) AS link, 'profile' AS link_kind FROM l
UNION ALL SELECT page_id, store_id, kind, 'https://www.linkedin.com/company/acme', 'company' FROM l WHERE o_orderstatus = 'F'
"""


@registry.add("extract_profile_links", st.with_tables(f"SELECT page_id, link, link_kind FROM ({PROFILES})", l=LINKED))
def extract_profile_links(spark, sf):
    return extract.extract_profile_links(run_sql(spark, sf, LINKED)).select("page_id", "link", "link_kind")


@registry.add(
    "strongest_profile_link",
    st.with_tables(
        f"""SELECT store_id, link, link_kind, kind AS page_kind, page_id FROM ({PROFILES})
        QUALIFY row_number() OVER (PARTITION BY store_id, link ORDER BY CASE kind WHEN 'contact' THEN 0 WHEN 'about' THEN 1 ELSE 2 END, page_id) = 1""",
        l=LINKED,
    ),
)
def strongest_profile_link(spark, sf):
    from retailscope.operators.contacts import strongest_profile_link as strongest

    found = extract.extract_profile_links(run_sql(spark, sf, LINKED), ["page_id", "store_id"])
    return strongest(found, ["page_id", "pos"]).select("store_id", "link", "link_kind", "page_kind", "page_id")


PRODUCT_PAGES = """
SELECT p_partkey AS page_id, concat('https://s.shop/products/', CAST(p_partkey AS VARCHAR(20))) AS url, p_size AS size, p_type AS type, p_retailprice AS price,
       concat('<html><body><main><div class="product__media">', CASE WHEN p_size > 25 THEN '<img src="a.jpg" alt="">' ELSE '' END, '<img src=b.jpg></div><h1>', p_name, '</h1>',
              CASE WHEN p_size < 30 THEN '<span class="price">10</span>' ELSE concat('<b>', CAST(p_size AS VARCHAR(9)), ',00 zł</b>') END,
              CASE WHEN p_type = 'ECONOMY' THEN '' ELSE '<form action="/cart/add" method="post"><select name="id" class="x"><option value="1">S<option value="2">M</select>' END,
              CASE WHEN p_type = 'ECONOMY' THEN '' WHEN p_type = 'PROMO' THEN '<button name="add" disabled>Sold out</button></form>' ELSE '<input name="quantity" value="1"><button type="submit" name="add">Add to cart</button></form>' END,
              '<div class="product-description">', repeat('Nice thing. ', p_size), '</div><a href="/products/other">o</a><a href="https://s.shop/products/', CAST(p_partkey AS VARCHAR(20)), '#r">self</a>',
              CASE WHEN p_retailprice > 1500 THEN '<div id="shop-reviews">5</div><p>Free delivery and returns</p>' ELSE '' END, '</main></body></html>') AS html
FROM {part}
"""


@registry.add(
    "extract_product_facts",
    st.with_tables(
        """SELECT page_id, type <> 'ECONOMY' AS has_cart_form, type <> 'ECONOMY' AS has_add_button, type NOT IN ('ECONOMY', 'PROMO') AS add_enabled, false AS has_express, true AS has_price,
        CASE WHEN size > 25 THEN 2 ELSE 1 END AS images, type <> 'ECONOMY' AS has_variants, CASE WHEN type <> 'ECONOMY' THEN 2 ELSE 0 END AS variant_options, false AS variants_disabled,
        type NOT IN ('ECONOMY', 'PROMO') AS has_quantity, size * 12 - 1 AS description_chars, price > 1500 AS has_reviews, price > 1500 AS has_delivery, price > 1500 AS has_returns,
        1 AS related, type = 'PROMO' AS sold_out FROM p""",
        p=PRODUCT_PAGES,
    ),
)
def extract_product_facts(spark, sf):
    return extract.extract_product_facts(spread(run_sql(spark, sf, PRODUCT_PAGES), PAGE_TASKS)).drop("url", "static", "add_text")


LISTING_PAGES = """
SELECT s_suppkey AS page_id, concat('https://s.shop/collections/', CAST(s_suppkey AS VARCHAR(20))) AS url, s_acctbal AS bal, s_nationkey AS n,
       concat('<html><body><ul><li><a href="/blog">b</a></li>', repeat('<li class="grid__item"><a href="/products/a"><img src="a"></a><a href="/products/a">A</a> 12 EUR</li>', s_nationkey),
              '<li id="last"><div>Sold out</div><a href="https://s.shop/products/z">Z</a></li></ul>', CASE WHEN s_acctbal > 5000 THEN '<div class="facets"></div><select name="sort_by"></select>' ELSE '' END,
              CASE WHEN s_acctbal > 2000 THEN '<nav class="pagination"></nav>' ELSE '' END, '</body></html>') AS html
FROM {supplier}
"""


@registry.add(
    "extract_listing_facts",
    st.with_tables(
        """SELECT page_id, n + 1 AS cards, n AS with_image, n AS with_price, n + 1 AS with_title, 1 AS sold_out, '#last' AS missing_price, bal > 5000 AS has_filters, bal > 5000 AS has_sorting,
        bal > 2000 AS has_pagination, false AS has_quick_add FROM p""",
        p=LISTING_PAGES,
    ),
)
def extract_listing_facts(spark, sf):
    facts = extract.extract_listing_facts(spread(run_sql(spark, sf, LISTING_PAGES), PAGE_TASKS)).drop("url", "static")
    return facts.withColumn("missing_price", F.array_join("missing_price", ","))


CART_PAGES = """
SELECT o_orderkey AS page_id, 'https://s.shop/cart' AS url, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS price,
       concat('<html><body><div class="cart__item">x</div>', CASE WHEN o_orderpriority < '3' THEN '<input name="updates[]" value="1">' ELSE '' END,
              CASE WHEN o_orderstatus = 'F' THEN '<a href="/cart/change?line=1&amp;quantity=0">x</a>' ELSE '' END, CASE WHEN o_totalprice > 250000 THEN '<button>Checkout now</button>' ELSE '<button>Go</button>' END,
              '<form><input type="email" required id="e"><label for="e">Mail</label><input name="zip" required><select name="country"><option>France<option>', CASE WHEN o_orderstatus = 'F' THEN 'Polska' ELSE 'Italy' END,
              '</option></select></form><p>', CASE WHEN o_orderpriority < '2' THEN '120 zł' ELSE 'EUR 9' END, ' Visa, visa, PayPal</p>',
              CASE WHEN o_totalprice > 400000 THEN '<input type="password"><p>Sign in to continue</p>' ELSE '' END, '<div role="alert">Bad card</div></body></html>') AS html
FROM {orders}
"""


@registry.add(
    "extract_cart_facts",
    st.with_tables(
        "SELECT page_id, true AS has_lines, pr < '3' AS has_quantity, st = 'F' AS has_remove, false AS has_delivery_estimate, price > 250000 AS has_checkout FROM p", p=CART_PAGES
    ),
)
def extract_cart_facts(spark, sf):
    return extract.extract_cart_facts(spread(run_sql(spark, sf, CART_PAGES), PAGE_TASKS)).select("page_id", "has_lines", "has_quantity", "has_remove", "has_delivery_estimate", "has_checkout")


@registry.add(
    "extract_checkout_facts",
    st.with_tables(
        """SELECT page_id, true AS has_email_field, true AS has_address_fields, price > 400000 AS requires_login, true AS has_country_select, st = 'F' AS has_target_country, pr < '2' AS has_local_currency,
        'visa,paypal' AS payments, 2 AS required_fields, 'zip' AS unlabelled_required, 'Bad card' AS visible_errors FROM p""",
        p=CART_PAGES,
    ),
)
def extract_checkout_facts(spark, sf):
    facts = extract.extract_checkout_facts(spread(run_sql(spark, sf, CART_PAGES), PAGE_TASKS), "pl").drop("url", "static", "country_options")
    for name in ("payments", "unlabelled_required", "visible_errors"):
        facts = facts.withColumn(name, F.array_join(name, ","))
    return facts


ROBOTS = """
SELECT concat('h', CAST(s_suppkey AS VARCHAR(9)), '.shop') AS host, s_acctbal AS bal, s_nationkey AS n,
       concat('# robots', chr(10), 'User-Agent: *', chr(13), chr(10), 'Disallow: /', CASE WHEN s_acctbal < 3000 THEN '' ELSE 'cart* # x' END, chr(10), 'Allow: /cart/ok$', chr(10), 'Crawl-delay: ', CAST(s_nationkey AS VARCHAR(9)), chr(10),
              CASE WHEN s_acctbal > 6000 THEN concat('user-agent: Other', chr(10), 'user-agent: AuditBot', chr(10), 'Disallow:', chr(10), 'Disallow: /private', chr(10)) ELSE '' END) AS robots_txt
FROM {supplier}
"""


@registry.add(
    "read_robots",
    st.with_tables(
        """SELECT host, '*' AS agent, 'agent' AS kind, NULL AS pattern, CAST(NULL AS DOUBLE) AS crawl_delay FROM r
        UNION ALL SELECT host, '*', 'disallow', CASE WHEN bal < 3000 THEN '/' ELSE '/cart*' END, NULL FROM r
        UNION ALL SELECT host, '*', 'allow', '/cart/ok$', NULL FROM r UNION ALL SELECT host, '*', 'crawl-delay', NULL, n FROM r
        UNION ALL SELECT host, a, 'agent', NULL, NULL FROM r, (VALUES ('other'), ('auditbot')) t(a) WHERE bal > 6000
        UNION ALL SELECT host, a, 'disallow', '/private', NULL FROM r, (VALUES ('other'), ('auditbot')) t(a) WHERE bal > 6000""",
        r=ROBOTS,
    ),
)
def read_robots(spark, sf):
    return links.read_robots(run_sql(spark, sf, ROBOTS)).drop("line_no")


@registry.add(
    "robots_block_everything",
    st.with_tables("SELECT host, bal < 3000 AS robots_blocks_all, true AS has_robots, false AS has_sitemap, 0 AS sitemap_urls FROM r", r=ROBOTS),
)
def robots_block_everything(spark, sf):
    sites = run_sql(spark, sf, ROBOTS).withColumn("sitemap_xml", F.lit(None).cast("string"))
    return links.site_seo_facts(sites).select("host", "robots_blocks_all", "has_robots", "has_sitemap", "sitemap_urls")


ROBOT_URLS = """
SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part_id, concat('h', CAST(l_suppkey AS VARCHAR(9)), '.shop') AS host,
       concat('https://h/', CASE WHEN l_tax > 0.06 THEN 'private/x' WHEN l_tax > 0.04 THEN 'cart/ok' WHEN l_tax > 0.02 THEN 'cart/ok/more' ELSE 'a?b=1' END) AS url,
       CASE WHEN l_tax > 0.06 THEN 'p' WHEN l_tax > 0.04 THEN 'ok' WHEN l_tax > 0.02 THEN 'more' ELSE 'a' END AS what FROM {lineitem}
"""


@registry.add(
    "apply_robots",
    st.with_tables(
        """SELECT id, line, part_id, u.host, CASE WHEN bal > 6000 THEN what <> 'p' WHEN what = 'ok' THEN true WHEN bal < 3000 THEN false ELSE what NOT IN ('more') END AS allowed,
        CASE WHEN bal <= 6000 THEN CAST(n AS DOUBLE) END AS crawl_delay FROM u JOIN r ON r.host = u.host""",
        r=ROBOTS,
        u=ROBOT_URLS,
    ),
)
def apply_robots(spark, sf):
    rules = links.read_robots(run_sql(spark, sf, ROBOTS))
    return links.apply_robots(run_sql(spark, sf, ROBOT_URLS), rules, "AuditBot/1.0 (+x)").select("id", "line", "part_id", "host", "allowed", "crawl_delay")


SITEMAPS = """
SELECT c_custkey AS site, c_nationkey AS n, concat('<urlset>', repeat('<url><loc> https://s/a?x=1&amp;y=2 </loc></url>', c_nationkey), '<LOC>https://s/', CAST(c_custkey AS VARCHAR(20)), '</LOC></urlset>') AS sitemap_xml FROM {customer}
"""


@registry.add(
    "expand_sitemaps",
    st.with_tables(
        """SELECT site, CAST(pos AS INT) AS pos, CASE WHEN pos < n THEN 'https://s/a?x=1&y=2' ELSE concat('https://s/', site) END AS loc FROM (SELECT site, n, unnest(range(n + 1)) AS pos FROM s)""",
        s=SITEMAPS,
    ),
)
def expand_sitemaps(spark, sf):
    return links.expand_sitemaps(run_sql(spark, sf, SITEMAPS))


SHOP_LINKS = """
SELECT o_custkey AS store_id, o_orderkey AS pos, 'https://s.shop' AS origin,
       CASE WHEN o_totalprice < 30000 THEN 'collections_all' WHEN o_orderstatus = 'F' THEN 'sitemap' ELSE 'navigation' END AS source,
       concat(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'https://other.shop' ELSE 'https://S.shop' END,
              CASE o_orderpriority WHEN '1-URGENT' THEN '/collections/all' WHEN '2-HIGH' THEN '/collections/c' WHEN '3-MEDIUM' THEN '/collections/x/products/p' ELSE '/products/p' END,
              CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE CAST(month(o_orderdate) AS VARCHAR(9)) END, CASE WHEN o_orderstatus = 'O' THEN '?a=1#f' ELSE '' END) AS absolute_url
FROM {orders}
"""
CLASSED = """
SELECT store_id, source, link_kind, clean_url, min(pos) AS pos FROM (SELECT *, regexp_replace(absolute_url, '[?#].*$', '') AS clean_url,
    CASE WHEN absolute_url LIKE '%/products/%' THEN 'product' ELSE 'collection' END AS link_kind FROM l WHERE absolute_url LIKE 'https://S.shop%') GROUP BY ALL
"""


@registry.add("classify_shop_links", st.with_tables(CLASSED, l=SHOP_LINKS))
def classify_shop_links(spark, sf):
    return links.classify_shop_links(run_sql(spark, sf, SHOP_LINKS), ["store_id", "source"])


@registry.add(
    "pick_key_pages",
    st.with_tables(
        f"""WITH c AS ({CLASSED}), a AS (SELECT store_id, arg_min(clean_url, pos) AS p FROM c WHERE source = 'collections_all' AND link_kind = 'product' GROUP BY 1),
        f AS (SELECT * FROM c WHERE source <> 'collections_all' QUALIFY row_number() OVER (PARTITION BY store_id, link_kind ORDER BY source <> 'navigation', link_kind = 'collection' AND clean_url LIKE '%/collections/all', pos) = 1)
        SELECT s.store_id, CASE WHEN a.p IS NOT NULL THEN 'https://s.shop/collections/all' ELSE x.clean_url END AS collection, CASE WHEN a.p IS NOT NULL THEN 'collections_all' ELSE x.source END AS collection_source,
               coalesce(a.p, y.clean_url) AS product, CASE WHEN a.p IS NOT NULL THEN 'collections_all' ELSE y.source END AS product_source
        FROM (SELECT DISTINCT store_id FROM l) s LEFT JOIN a USING (store_id) LEFT JOIN f x ON x.store_id = s.store_id AND x.link_kind = 'collection' LEFT JOIN f y ON y.store_id = s.store_id AND y.link_kind = 'product'""",
        l=SHOP_LINKS,
    ),
)
def pick_key_pages(spark, sf):
    return links.pick_key_pages(run_sql(spark, sf, SHOP_LINKS))


PROBE_LINKS = """
SELECT l_suppkey AS page_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_tax > 0.07 THEN 'mailto:a@b.c' ELSE concat('https://s/', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_linestatus = 'O' THEN '#top' ELSE '' END) END AS absolute_url,
       'go' AS text, l_partkey % 50 = 0 AS internal, l_partkey AS part_id FROM {lineitem}
"""
PICKED = """
WITH d AS (SELECT page_id, regexp_replace(absolute_url, '#.*$', '') AS link_url, min(pos) AS pos, any_value(internal) AS internal FROM l WHERE absolute_url LIKE 'https://%' GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, internal ORDER BY pos, link_url) AS rn FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY internal DESC, pos) AS link_no FROM e WHERE internal OR rn <= 10)
"""


@registry.add("select_links", st.with_tables(PICKED + "SELECT page_id, link_url, internal FROM k WHERE link_no <= 30", l=PROBE_LINKS))
def select_links(spark, sf):
    return links.select_links(run_sql(spark, sf, PROBE_LINKS))[0].select("page_id", "link_url", "internal")


@registry.add(
    "skipped_links",
    st.with_tables(
        PICKED + "SELECT a.page_id, a.n - k.n AS skipped FROM (SELECT page_id, count(*) AS n FROM l GROUP BY 1) a JOIN (SELECT page_id, count(*) AS n FROM k WHERE link_no <= 30 GROUP BY 1) k USING (page_id)",
        l=PROBE_LINKS,
    ),
)
def skipped_links(spark, sf):
    return links.select_links(run_sql(spark, sf, PROBE_LINKS))[1]


CONTACT_LINKS = """
SELECT o_custkey AS store_id, o_orderkey AS pos, 'https://s.shop' AS origin, CASE WHEN o_totalprice > 300000 THEN 'Our story' WHEN o_totalprice > 250000 THEN 'Regulamin sklepu' ELSE 'Link' END AS text,
       concat(CASE WHEN o_orderstatus = 'P' THEN 'https://x.shop' ELSE 'https://s.shop' END, CASE o_orderpriority WHEN '1-URGENT' THEN '/pages/kontakt/' WHEN '2-HIGH' THEN '/pages/about-us?x=1' WHEN '3-MEDIUM' THEN '/policies/privacy-policy'
              ELSE concat('/pages/p', CAST(month(o_orderdate) AS VARCHAR(9))) END) AS absolute_url, o_orderpriority AS pr, o_totalprice AS price, o_orderstatus AS st FROM {orders}
"""


@registry.add(
    "pick_contact_pages",
    st.with_tables(
        """WITH k AS (SELECT store_id, pos, regexp_replace(regexp_replace(absolute_url, '[?#].*$', ''), '/+$', '') AS page_url,
            CASE pr WHEN '1-URGENT' THEN 'contact' WHEN '2-HIGH' THEN 'about' WHEN '3-MEDIUM' THEN 'privacy' ELSE CASE WHEN price > 300000 THEN 'about' WHEN price > 250000 THEN 'terms' END END AS page_kind FROM l WHERE st <> 'P'),
        o AS (SELECT store_id, page_url, arg_min(page_kind, pos) AS page_kind, min(pos) AS pos FROM k WHERE page_kind IS NOT NULL GROUP BY 1, 2)
        SELECT store_id, page_kind, arg_min(page_url, pos) AS page_url FROM o GROUP BY 1, 2""",
        l=CONTACT_LINKS,
    ),
)
def pick_contact_pages(spark, sf):
    return links.pick_contact_pages(run_sql(spark, sf, CONTACT_LINKS)).drop("kind_order")


SEARCHED = """
SELECT c_custkey AS store_id, concat(CASE WHEN c_acctbal > 5000 THEN 'www.' ELSE '' END, 'best-shop_'  , CAST(c_nationkey AS VARCHAR(9)), 'x.pl') AS raw_domain, concat('best-shop', CAST(c_custkey AS VARCHAR(20)), '.pl') AS domain,
       CASE c_mktsegment WHEN 'BUILDING' THEN concat('Best Shop', CAST(c_custkey AS VARCHAR(20)), '.pl') WHEN 'FURNITURE' THEN 'Dom "Meble"' WHEN 'MACHINERY' THEN concat('BestShop', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS name,
       CASE WHEN c_nationkey < 12 THEN 'pl' ELSE 'DE' END AS country, c_mktsegment AS seg FROM {customer}
"""


@registry.add(
    "plan_searches",
    st.with_tables(
        """WITH b AS (SELECT *, CASE WHEN seg = 'FURNITURE' THEN 'Dom Meble' ELSE concat('Best Shop', store_id) END AS brand,
            CASE WHEN country = 'pl' THEN '(founder OR CEO OR owner OR założyciel OR właściciel OR prezes)' ELSE '(founder OR CEO OR owner)' END AS roles FROM s)
        SELECT store_id, 0 AS query_no, 'linkedin_profile' AS kind, concat('"', brand, '" ', roles, ' linkedin.com/in') AS query, 'linkedin.com' AS allowed_domain FROM b
        UNION ALL SELECT store_id, 1, 'linkedin_company', concat('"', domain, '" ', roles), 'linkedin.com' FROM b
        UNION ALL SELECT store_id, 2, 'open_web', concat('"', brand, '" ', roles, ' ecommerce'), NULL FROM b""",
        s=SEARCHED,
    ),
)
def plan_searches(spark, sf):
    return links.plan_searches(run_sql(spark, sf, SEARCHED)).drop("max_results")
