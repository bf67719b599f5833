"""Grading, audit outcome and fetch verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.operators import findings, grading, walls
from retailscope.plans import standins as st
from retailscope.plans.registry import Registry
from retailscope.session import run_sql, spread

registry = Registry()

PLACE = "concat('https://shop/', CAST(l_orderkey AS VARCHAR(20))) AS url, CASE WHEN l_linestatus = 'O' THEN 'mobile' ELSE 'desktop' END AS viewport"
KEYS = "l_orderkey AS audit_id, l_suppkey AS store_id, l_partkey AS part_id"
VIEW = ["audit_id", "store_id", "part_id"]


def shown(issues, keys=VIEW):
    first = F.try_element_at("evidence", F.lit(1))
    return issues.select(
        *keys, "page", "category", "severity", "title", F.coalesce("detail", F.lit("")).alias("detail"),
        F.coalesce(first["actual"], F.lit("")).alias("actual"), F.coalesce(first["expected"], F.lit("")).alias("expected"),
        F.size("evidence").alias("n_evidence"),
    )


def rules_sql(relation: str, rules, keys=VIEW, **relations: str) -> str:
    """UNION ALL of (condition, page, category, severity, title, detail, actual, expected, n) rows."""
    parts = []
    for cond, page, category, severity, title, *rest in rules:
        detail, actual, expected, n = [*rest, *["''", "''", "''", "1"][len(rest):]]
        q = lambda v: v if v.startswith(("CASE", "concat", "page", "(")) else f"'{v}'"
        parts.append(
            f"SELECT {', '.join(keys)}, {q(page)} AS page, '{category}' AS category, {q(severity)} AS severity, {q(title)} AS title, "
            f"{detail} AS detail, {actual} AS actual, {expected} AS expected, CAST({n} AS INT) AS n_evidence FROM {relation} WHERE {cond}"
        )
    return st.with_tables(" UNION ALL ".join(parts), **relations)


SEO = f"""
SELECT {KEYS}, {PLACE}, CASE WHEN l_suppkey < 50 THEN 'product' ELSE 'homepage' END AS page, l_tax > 0.07 AS noindex, 'noindex' AS robots_meta,
       CASE WHEN l_quantity < 4 THEN '' ELSE 'A title' END AS title, CAST(l_quantity * 2 AS INT) AS title_length,
       CASE WHEN l_discount < 0.02 THEN NULL ELSE 'text' END AS description, CAST(floor(l_extendedprice / 300) AS INT) AS description_length,
       l_linenumber - 1 AS h1_count, CASE WHEN l_returnflag = 'A' THEN 'c' END AS canonical, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'en' END AS lang,
       CAST(floor(l_quantity) AS INT) AS images, CAST(floor(l_extendedprice / 2000) AS INT) AS images_with_alt,
       CASE WHEN l_tax < 0.03 THEN 'Product' WHEN l_tax < 0.05 THEN 'Offer' ELSE '' END AS type_name
FROM {{lineitem}}
"""


@registry.add(
    "grade_page_seo",
    rules_sql(
        "facts",
        [
            ("noindex", "page", "seo", "CRITICAL", "Page is excluded from search engines", "'Its robots meta tag carries noindex'"),
            ("title = ''", "page", "seo", "MAJOR", "Page has no title tag"),
            ("title <> '' AND (title_length < 15 OR title_length > 65)", "page", "seo", "MINOR", "Page title is the wrong length", "''", "CAST(title_length AS VARCHAR)", "'15–65 characters'"),
            ("description IS NULL", "page", "seo", "MAJOR", "Page has no meta description", "'Search results show an arbitrary excerpt instead'"),
            ("description IS NOT NULL AND NOT description_length BETWEEN 50 AND 165", "page", "seo", "MINOR", "Meta description is the wrong length", "''", "CAST(description_length AS VARCHAR)", "'50–165 characters'"),
            ("h1_count = 0", "page", "seo", "MAJOR", "Page has no H1 heading"),
            ("h1_count > 1", "page", "seo", "MINOR", "Page has more than one H1", "''", "concat(h1_count, ' H1 headings')"),
            ("canonical IS NULL", "page", "seo", "MINOR", "No canonical URL", "'Copies under other parameters compete with it'"),
            ("lang = ''", "page", "seo", "MINOR", "The page does not declare its language"),
            ("page = 'product' AND type_name <> 'Product'", "page", "seo", "MAJOR", "Product page has no Product structured data", "'Rich results need it for price, stock and rating'", "CASE WHEN type_name = '' THEN 'no structured data' ELSE type_name END", "'schema.org Product'"),
            ("images > 0 AND images_with_alt / images < 0.7", "page", "seo", "MINOR", "Images have no alt text", "'Image search and screen readers have nothing to go by'", "concat(images_with_alt, ' of ', images)", "'70% of images'"),
        ],
        facts=SEO,
    ),
)
def grade_page_seo(spark, sf):
    facts = spread(run_sql(spark, sf, SEO)).withColumn("schema_types", F.when(F.col("type_name") != "", F.array("type_name")))
    return shown(grading.grade_page_seo(facts, VIEW))


SITE = "SELECT s_suppkey AS audit_id, s_nationkey AS store_id, concat('https://', s_name) AS origin, s_acctbal < 2000 AS robots_blocks_all, s_acctbal > 4000 AS has_sitemap, s_acctbal < 8000 AS has_robots FROM {supplier}"


@registry.add(
    "grade_site_seo",
    rules_sql(
        "facts",
        [
            ("robots_blocks_all", "site", "seo", "CRITICAL", "robots.txt blocks the whole site", "'A rule for all agents disallows the root'"),
            ("NOT has_sitemap", "site", "seo", "MAJOR", "No sitemap.xml", "''", "''", "'an XML sitemap'"),
            ("NOT has_robots", "site", "seo", "MINOR", "No robots.txt"),
        ],
        ["audit_id", "store_id"],
        facts=SITE,
    ),
)
def grade_site_seo(spark, sf):
    return shown(grading.grade_site_seo(run_sql(spark, sf, SITE)), ["audit_id", "store_id"])


PRODUCT = f"""
SELECT {KEYS}, {PLACE}, l_tax > 0.01 AS has_add_button, l_discount > 0.02 AS add_enabled, l_returnflag = 'R' AS sold_out, 'Add' AS add_text,
       l_quantity > 3 AS has_price, l_linenumber - 1 AS images, l_discount > 0.05 AS has_variants, l_tax > 0.04 AS variants_disabled, l_linenumber AS variant_options,
       l_quantity > 10 AS has_quantity, l_suppkey > 40 AS has_express, CASE WHEN l_quantity < 9 THEN 0 ELSE CAST(floor(l_quantity * 4) AS INT) END AS description_chars,
       l_partkey > 900 AS has_reviews, l_discount < 0.06 AS has_delivery, l_tax < 0.06 AS has_returns, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 3 END AS related
FROM {{lineitem}}
"""


@registry.add(
    "grade_product",
    rules_sql(
        "facts",
        [
            ("NOT has_add_button", "product", "cro", "CRITICAL", "No add to cart button", "'No control on the page puts the product into a cart'", "'none found'", "'an add-to-cart button'"),
            ("has_add_button AND NOT add_enabled AND NOT sold_out", "product", "cro", "CRITICAL", "Add to cart button is disabled", "'Its button is inactive although stock is not said to be gone'", "'disabled'"),
            ("NOT has_price", "product", "cro", "CRITICAL", "Product page shows no price", "''", "'none found'", "'a price'"),
            ("images = 0", "product", "ux", "MAJOR", "Product page has no photo"),
            ("images = 1", "product", "cro", "MINOR", "Only one product photo", "'A single view leaves questions open'", "'1 image'"),
            ("has_variants AND variants_disabled", "product", "cro", "MAJOR", "Variant selection is disabled", "'The control for options is inactive'", "concat(variant_options, ' option(s), control disabled')"),
            ("NOT has_quantity", "product", "cro", "MINOR", "No quantity selector"),
            ("NOT has_express", "product", "cro", "MINOR", "No express checkout button", "'Known buyers have no short way to pay'"),
            ("description_chars < 120", "product", "cro", "MAJOR", "CASE WHEN description_chars = 0 THEN 'No product description' ELSE 'Product description is too short' END", "concat('Length of the text: ', description_chars, ' characters')", "CAST(description_chars AS VARCHAR)", "'at least 120 characters'"),
            ("NOT has_reviews", "product", "cro", "MINOR", "No reviews or ratings", "'Opinions of buyers are absent'"),
            ("NOT has_delivery", "product", "cro", "MINOR", "No delivery information on the product page"),
            ("NOT has_returns", "product", "cro", "MINOR", "No returns information on the product page"),
            ("related = 0", "product", "cro", "MINOR", "No related products or upsell", "'It leads to no other product'"),
        ],
        facts=PRODUCT,
    ),
)
def grade_product(spark, sf):
    return shown(grading.grade_product(spread(run_sql(spark, sf, PRODUCT)), VIEW))


LISTING = f"""
SELECT {KEYS}, {PLACE}, CAST(floor(l_quantity) AS INT) - 1 AS cards, CAST(floor(l_quantity) AS INT) - l_linenumber AS with_image,
       CASE WHEN l_tax > 0.05 THEN CAST(floor(l_quantity) AS INT) - 2 ELSE CAST(floor(l_quantity) AS INT) - 1 END AS with_price,
       CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity) AS INT) - 1 ELSE 0 END AS sold_out, l_discount > 0.03 AS has_filters, l_discount > 0.05 AS has_sorting,
       l_tax > 0.02 AS has_pagination, l_suppkey > 30 AS has_quick_add
FROM {{lineitem}}
"""


@registry.add(
    "grade_listing",
    rules_sql(
        "facts",
        [
            ("cards = 0", "collection", "cro", "CRITICAL", "Collection page shows no products", "'The listing has no card'", "'0 cards'", "'at least one product card'"),
            ("cards > 0 AND with_image < cards", "collection", "ux", "MAJOR", "Product cards without an image", "concat(cards - with_image, ' of ', cards, ' without a picture')", "CAST(with_image AS VARCHAR)", "concat(cards, ' images')"),
            ("cards > 0 AND with_price < cards", "collection", "cro", "MAJOR", "Product cards without a price", "concat(cards - with_price, ' of ', cards, ' without a price')", "CASE WHEN viewport = 'mobile' THEN '' ELSE concat(with_price, ' of ', cards, ' cards priced') END", "''", "CASE WHEN viewport = 'mobile' THEN 2 ELSE 1 END"),
            ("cards > 0 AND sold_out = cards", "collection", "cro", "MAJOR", "Every product in the collection is sold out", "''", "concat(sold_out, ' of ', cards, ' marked unavailable')"),
            ("cards >= 12 AND NOT has_filters", "collection", "cro", "MINOR", "No filters on a long product list", "''", "concat(cards, ' products, no filter controls')"),
            ("cards >= 12 AND NOT has_sorting", "collection", "cro", "MINOR", "No sorting on a long product list", "''", "concat(cards, ' products, no sort control')"),
            ("cards >= 24 AND NOT has_pagination", "collection", "ux", "MAJOR", "No pagination on a full collection page", "'Further products are out of reach'", "concat(cards, ' products, no pagination or load-more')"),
            ("cards > 0 AND NOT has_quick_add", "collection", "cro", "MINOR", "No quick add to cart on the listing", "'Cards have no button of their own to buy'"),
        ],
        facts=LISTING,
    ),
)
def grade_listing(spark, sf):
    some = F.array(F.lit("a.card"), F.lit("b.card"))
    facts = spread(run_sql(spark, sf, LISTING)).withColumn(
        "missing_price", F.when(F.col("viewport") == "mobile", some).otherwise(F.array().cast("array<string>"))
    )
    return shown(grading.grade_listing(facts, VIEW))


CART = f"""
SELECT {KEYS}, {PLACE}, CASE WHEN l_tax > 0.01 THEN 0 END AS add_before, CASE WHEN l_tax > 0.02 THEN l_linenumber - 1 END AS add_after, l_linenumber > 1 AS added,
       CASE WHEN l_returnflag = 'R' THEN 'HTTP 500' END AS add_error, l_quantity > 5 AS has_lines, CASE WHEN l_quantity > 3 THEN l_linenumber END AS item_count,
       l_discount > 0.02 AS has_quantity, l_discount > 0.04 AS quantity_tried, l_discount > 0.07 AS quantity_changed, CASE WHEN l_tax > 0.04 THEN 1 END AS quantity_after,
       l_suppkey > 20 AS has_remove, l_suppkey > 30 AS remove_tried, l_suppkey > 60 AS removed, 1 AS remove_before, CASE WHEN l_tax > 0.04 THEN 1 END AS remove_after,
       l_returnflag = 'A' AS has_delivery_estimate, l_partkey > 100 AS has_checkout, l_partkey > 300 AS checkout_clicked, l_partkey > 1000 AS checkout_reached,
       CASE WHEN l_linestatus = 'O' THEN 'https://shop/login' END AS checkout_url
FROM {{lineitem}}
"""


@registry.add(
    "grade_cart",
    rules_sql(
        "facts",
        [
            ("NOT added AND add_before IS NOT NULL AND add_after IS NOT NULL", "cart", "cro", "CRITICAL", "Adding to cart does not work", "coalesce(add_error, 'The cart counted the same before and after')", "concat(add_before, ' → ', add_after, ' items')", "'the cart gains an item'"),
            ("added AND NOT has_lines", "cart", "technical", "CRITICAL", "Cart page does not show the added item", "''", "concat(coalesce(CAST(item_count AS VARCHAR), '?'), ' items in the cart API')"),
            ("added AND NOT has_quantity", "cart", "ux", "MAJOR", "Quantity cannot be changed in the cart"),
            ("added AND has_quantity AND quantity_tried AND NOT quantity_changed", "cart", "technical", "MAJOR", "Changing the quantity has no effect", "''", "concat(coalesce(CAST(quantity_after AS VARCHAR), '?'), ' items after the update')", "'2 items'"),
            ("added AND NOT has_remove", "cart", "ux", "MAJOR", "Items cannot be removed from the cart"),
            ("added AND has_remove AND remove_tried AND NOT removed", "cart", "technical", "MAJOR", "Removing an item has no effect", "''", "concat(remove_before, ' → ', coalesce(CAST(remove_after AS VARCHAR), '?'), ' items')"),
            ("added AND NOT has_delivery_estimate", "cart", "cro", "MINOR", "No delivery cost shown in the cart", "'Its price of delivery is unknown until later'"),
            ("added AND NOT has_checkout", "cart", "cro", "CRITICAL", "No checkout button in the cart"),
            ("added AND has_checkout AND checkout_clicked AND NOT checkout_reached", "cart", "cro", "CRITICAL", "Checkout button does not reach the checkout", "''", "coalesce(checkout_url, 'no navigation')", "'a /checkout URL'"),
        ],
        facts=CART,
    ),
)
def grade_cart(spark, sf):
    return shown(grading.grade_cart(spread(run_sql(spark, sf, CART)), VIEW))


CHECKOUT = f"""
SELECT {KEYS}, {PLACE}, l_tax > 0.01 AS opened, CASE WHEN l_linestatus = 'O' THEN 503 END AS http_status, l_returnflag = 'R' AS shows_error,
       l_discount > 0.03 AS has_email_field, l_discount > 0.05 AS has_address_fields, l_suppkey < 30 AS requires_login, l_suppkey > 15 AS has_country_select,
       l_partkey > 500 AS has_target_country, l_linenumber AS country_options, l_quantity > 20 AS has_local_currency, l_quantity < 15 AS has_unlabelled
FROM {{lineitem}}
"""


@registry.add(
    "grade_checkout",
    rules_sql(
        "facts",
        [
            ("NOT opened", "checkout", "cro", "CRITICAL", "Checkout does not open", "'The step did not load'", "''", "'a checkout form'"),
            ("opened AND shows_error", "checkout", "technical", "CRITICAL", "Checkout shows an error message", "''", "''", "''", "2"),
            ("opened AND NOT has_email_field AND NOT has_address_fields", "checkout", "cro", "MAJOR", "Checkout has no data-entry form", "'It asks for neither e-mail nor address'"),
            ("opened AND requires_login", "checkout", "cro", "MAJOR", "No guest checkout", "'It asks for an account first'"),
            ("opened AND has_country_select AND NOT has_target_country", "checkout", "cro", "MAJOR", "Checkout does not offer PL as a delivery country", "''", "concat(country_options, ' countries listed, none matching')", "'PL'"),
            ("opened AND NOT has_local_currency", "checkout", "cro", "MINOR", "Checkout does not show prices in the local currency", "''", "''", "'zł / PLN'"),
            ("opened AND has_unlabelled", "checkout", "ux", "MINOR", "Required checkout fields have no label", "'Their purpose has to be guessed'"),
        ],
        facts=CHECKOUT,
    ),
)
def grade_checkout(spark, sf):
    none = F.array().cast("array<string>")
    facts = (
        spread(run_sql(spark, sf, CHECKOUT))
        .withColumn("visible_errors", F.when(F.col("shows_error"), F.array(F.lit("a"), F.lit("b"))).otherwise(none))
        .withColumn("unlabelled_required", F.when(F.col("has_unlabelled"), F.array(F.lit("phone"))).otherwise(none))
    )
    return shown(grading.grade_checkout(facts, "pl", VIEW))


RESPONSIVE = f"""
SELECT {KEYS}, {PLACE}, 'homepage' AS page, CAST(floor(l_quantity / 4) AS INT) AS overflow_by, 360 AS viewport_width, 400 AS document_width, l_linenumber - 1 AS small_tap_count,
       l_tax > 0.06 AS overlapping, l_linenumber * 2 AS small_font_count FROM {{lineitem}}
"""
LOUD = "CASE WHEN viewport = 'mobile' THEN 'MAJOR' ELSE 'MINOR' END"


@registry.add(
    "grade_responsive",
    rules_sql(
        "facts",
        [
            ("overflow_by > 4", "page", "ux", LOUD, "Page scrolls sideways", "concat('Wider by ', overflow_by, 'px than its screen of 360px')", "'400px'", "'360px'"),
            ("viewport = 'mobile' AND small_tap_count > 0", "page", "ux", "CASE WHEN small_tap_count > 5 THEN 'MAJOR' ELSE 'MINOR' END", "Tap targets are too small", "concat(small_tap_count, ' below 44px')", "'20x30px'", "'44x44px'"),
            ("overlapping", "page", "ux", LOUD, "Controls overlap each other", "'Their boxes intersect'"),
            ("viewport = 'mobile' AND small_font_count > 5", "page", "ux", "MINOR", "Text is too small to read on a phone", "concat(small_font_count, ' text(s) below 12px')", "''", "''", "0"),
        ],
        facts=RESPONSIVE,
    ),
)
def grade_responsive(spark, sf):
    facts = (
        spread(run_sql(spark, sf, RESPONSIVE))
        .withColumn("overflowing", F.array().cast("array<struct<selector:string,overflow_px:int>>"))
        .withColumn("small_taps", F.from_json(F.lit('[{"selector":"a","text":"","width":20,"height":30}]'), "array<struct<selector:string,text:string,width:int,height:int>>"))
        .withColumn("overlaps", F.when(F.col("overlapping"), F.from_json(F.lit('[{"a":"x","b":"y"}]'), "array<struct<a:string,b:string>>")).otherwise(F.array().cast("array<struct<a:string,b:string>>")))
        .withColumn("small_fonts", F.array().cast("array<struct<selector:string,text:string,font_size:int>>"))
    )
    return shown(grading.grade_responsive(facts, VIEW))


OVERLAY = f"""
SELECT {KEYS}, {PLACE}, 'homepage' AS page, l_tax > 0.02 AS banner_found, l_discount > 0.03 AS banner_dismissed, l_tax > 0.01 AS banner_detected, 'accept' AS banner_selector,
       floor(l_quantity) / 50 AS coverage FROM {{lineitem}}
"""


@registry.add(
    "grade_overlays",
    rules_sql(
        "facts",
        [
            ("banner_found AND NOT banner_dismissed", "page", "ux", "MAJOR", "Cookie banner cannot be dismissed", "'It stayed after its button was pressed'"),
            ("NOT banner_found AND NOT banner_detected", "page", "technical", "MINOR", "No cookie consent banner", "'No request for consent was seen'"),
            ("coverage >= 0.4", "page", "cro", LOUD, "A popup covers the page", "'It was there when the page had loaded'", "concat(CAST(floor(coverage * 100 + 0.5) AS INT), '% of the viewport')"),
        ],
        facts=OVERLAY,
    ),
)
def grade_overlays(spark, sf):
    box = F.struct(F.lit("div.popup").alias("selector"), F.lit("Sale").alias("text"), F.col("coverage").alias("coverage"))
    return shown(grading.grade_overlays(spread(run_sql(spark, sf, OVERLAY)).withColumn("overlays", F.array(box)), VIEW))


STRUCTURE = f"""
SELECT {KEYS}, {PLACE}, 'homepage' AS page, l_linenumber - 1 AS nav_links, l_tax > 0.04 AS has_nav, l_discount > 0.05 AS has_toggle, CAST(floor(l_quantity / 10) AS INT) AS links_after_toggle,
       l_returnflag = 'A' AS has_search, l_suppkey > 9 AS has_header, l_partkey > 90 AS has_footer, CASE WHEN l_tax > 0.05 THEN 'Privacy policy' ELSE 'Blog' END AS link_text FROM {{lineitem}}
"""
NO_TOGGLE = "NOT (viewport = 'mobile' AND has_toggle)"


@registry.add(
    "grade_structure",
    rules_sql(
        "facts",
        [
            (f"nav_links < 3 AND NOT ({NO_TOGGLE}) AND links_after_toggle < 3", "page", "ux", "CRITICAL", "Mobile menu does not open", "'Its button was pressed and too few links came up'", "concat(links_after_toggle, ' links')", "'at least 3 links'"),
            (f"nav_links < 3 AND {NO_TOGGLE}", "page", "ux", "MAJOR", "No usable navigation menu", "CASE WHEN has_nav THEN 'There is a navigation element with too few links' ELSE 'There is no navigation element' END", "concat(nav_links, ' links: ', link_text)", "'at least 3 visible links'"),
            ("NOT has_search", "page", "cro", "MAJOR", "No product search", "'Neither a field nor a link to search was seen'", "''", "'a search field or /search link'"),
            ("NOT has_header", "page", "ux", "MINOR", "No page header"),
            ("NOT has_footer", "page", "ux", "MINOR", "No page footer"),
            ("has_footer AND link_text = 'Blog'", "page", "ux", "MINOR", "Footer has no policy or contact links", "'None of its links names terms, privacy, delivery, returns or contact'", "'Blog'", "'regulamin / polityka prywatności / kontakt'"),
        ],
        facts=STRUCTURE,
    ),
)
def grade_structure(spark, sf):
    links = F.array("link_text")
    return shown(grading.grade_structure(spread(run_sql(spark, sf, STRUCTURE)).withColumn("footer_links", links).withColumn("nav_samples", links), VIEW))


OBSERVED = """
SELECT user_id AS page_id, event_id AS seq,
       CASE WHEN event_type IN ('error', 'click') THEN 'console' WHEN event_type = 'view' THEN 'failed' ELSE 'http' END AS list,
       CASE event_type WHEN 'error' THEN 'exception' WHEN 'click' THEN 'console' END AS kind,
       CASE WHEN event_type = 'click' AND value > 70 THEN 'Failed to load resource x' ELSE concat('message ', props) END AS text,
       CASE WHEN event_type = 'purchase' AND value < 20 THEN 'https://page' WHEN value > 95 THEN 'https://s/.well-known/shopify/monorail' ELSE concat('https://r/', props) END AS url,
       CAST(CAST(floor(value) AS INT) % 2 AS INT) AS line, CAST(360 + floor(value) AS INT) AS status,
       CASE WHEN value < 10 THEN 'net::ERR_ABORTED' ELSE 'net::ERR_FAILED' END AS error_text,
       CASE WHEN value < 50 THEN 'script' WHEN value < 80 THEN 'image' ELSE 'font' END AS resource_type
FROM {events}
"""
KEPT = """
SELECT * FROM observed WHERE NOT ((list = 'console' AND kind = 'console' AND text LIKE 'Failed to load resource%')
    OR (list = 'failed' AND error_text = 'net::ERR_ABORTED') OR (list = 'http' AND status < 400))
"""
TALLIED = f"""
SELECT * FROM (
SELECT page_id, list, kind, text, url, line, error_text, status, resource_type, n AS count, first_seq, key_no, false AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, list ORDER BY first_seq) AS key_no
      FROM (SELECT page_id, list, k, count(*) AS n, min(seq) AS first_seq, arg_min(kind, seq) AS kind, arg_min(text, seq) AS text, arg_min(url, seq) AS url,
                   arg_min(line, seq) AS line, arg_min(error_text, seq) AS error_text, arg_min(status, seq) AS status, arg_min(resource_type, seq) AS resource_type
            FROM (SELECT *, CASE WHEN kind = 'exception' THEN concat('e|', text) WHEN list = 'console' THEN concat('c|', text, '|', url, '|', line)
                                 WHEN list = 'failed' THEN concat(url, '|', error_text) ELSE concat(url, '|', status) END AS k FROM ({KEPT}))
            GROUP BY page_id, list, k)))
"""


@registry.add("drop_noise", st.with_tables(f"SELECT page_id, seq, list FROM ({KEPT})", observed=OBSERVED))
def drop_noise(spark, sf):
    return findings.drop_noise(run_sql(spark, sf, OBSERVED)).select("page_id", "seq", "list")


def tallied(spark, sf):
    return findings.tally_observations(findings.drop_noise(run_sql(spark, sf, OBSERVED)))


@registry.add(
    "tally_observations",
    st.with_tables(
        f"SELECT page_id, list, count, first_seq, truncated FROM ({TALLIED})",
        observed=OBSERVED,
    ),
)
def tally_observations(spark, sf):
    return tallied(spark, sf).select("page_id", "list", "count", "first_seq", "truncated")


AUDITED = """
SELECT user_id AS page_id, user_id AS audit_id, user_id * 2 AS store_id, CASE WHEN user_id < 40 THEN 'cart' ELSE 'homepage' END AS page, 'https://page' AS url,
       'mobile' AS viewport, CAST(floor(max(value) * 40) AS INT) AS navigation_ms FROM {events} GROUP BY user_id
"""


def _tech(cond: str, category: str, base: str, cart: str, title: str, detail: str) -> str:
    return f"""SELECT page_id, any_value(page) AS page, '{category}' AS category, CASE WHEN any_value(page) = 'cart' THEN '{cart}' ELSE '{base}' END AS severity, '{title}' AS title,
    concat(count(*), '{detail}') AS detail, CAST(least(count(*), 10) AS INT) AS n_evidence FROM seen WHERE {cond} GROUP BY page_id"""


@registry.add(
    "grade_technical",
    st.with_tables(
        f"""WITH tallied AS ({TALLIED}), seen AS (SELECT t.*, p.page FROM tallied t JOIN pages_seen p USING (page_id) WHERE NOT (list = 'http' AND t.url = p.url))
        {_tech("list = 'console' AND kind = 'exception'", "technical", "MAJOR", "CRITICAL", "JavaScript errors break the page", " uncaught error(s) while loading the page")}
        UNION ALL {_tech("list = 'console' AND kind = 'console'", "technical", "MINOR", "MAJOR", "Scripts log errors to the console", " console error(s)")}
        UNION ALL {_tech("list <> 'console' AND resource_type IN ('script', 'font') AND NOT contains(url, '/.well-known/shopify/monorail')", "technical", "MAJOR", "CRITICAL", "Scripts or styles fail to load", " blocking resource(s) did not load")}
        UNION ALL {_tech("list <> 'console' AND resource_type NOT IN ('script', 'font')", "technical", "MINOR", "MINOR", "Some resources return errors", " resource(s) failed")}
        UNION ALL SELECT page_id, page, 'performance', 'MAJOR', 'Page takes too long to open', concat('The page needed ', printf('%.1f', CASE WHEN navigation_ms % 500 = 250 THEN navigation_ms + 1 ELSE navigation_ms END / 1000), 's to become interactive'), 1
        FROM pages_seen WHERE navigation_ms >= 8000""",
        observed=OBSERVED,
        pages_seen=AUDITED,
    ),
)
def grade_technical(spark, sf):
    issues = findings.grade_technical(run_sql(spark, sf, AUDITED), tallied(spark, sf))
    return issues.select("page_id", "page", "category", "severity", "title", "detail", F.size("evidence").alias("n_evidence"))


PROBES = """
SELECT l_orderkey AS audit_id, l_suppkey AS store_id, 'homepage' AS page, l_linestatus = 'O' AS internal, l_partkey * 10 + l_linenumber AS pos, concat('https://l/', CAST(l_partkey AS VARCHAR(20))) AS url,
       'go' AS text, CASE WHEN l_tax > 0.07 THEN NULL WHEN l_tax > 0.05 THEN 404 WHEN l_tax > 0.03 THEN 403 WHEN l_tax > 0.02 THEN 503 ELSE 200 END AS status,
       CASE WHEN l_returnflag = 'R' THEN 'ECONNRESET' END AS error FROM {lineitem}
"""
BROKEN = "(status IS NULL OR (status >= 400 AND status NOT IN (401, 403, 405, 406, 429, 999) AND (internal OR status < 500)))"


@registry.add("broken_links", st.with_tables(f"SELECT audit_id, store_id, pos, internal, status FROM probes WHERE {BROKEN}", probes=PROBES))
def broken_links(spark, sf):
    return findings.broken_links(run_sql(spark, sf, PROBES)).select("audit_id", "store_id", "pos", "internal", "status")


@registry.add(
    "grade_links",
    st.with_tables(
        f"""SELECT store_id, CASE WHEN internal THEN 'MAJOR' ELSE 'MINOR' END AS severity,
        CASE WHEN internal THEN 'Broken links on the site' ELSE 'Links to external pages that no longer exist' END AS title,
        CASE WHEN internal THEN concat(count(*), ' of ', any_value(checked), ' checked links lead nowhere') ELSE concat(count(*), ' outbound link(s) are dead') END AS detail,
        CAST(least(count(*), 10) AS INT) AS n_evidence
        FROM (SELECT *, count(*) OVER (PARTITION BY store_id) AS checked FROM probes) WHERE {BROKEN} GROUP BY store_id, internal""",
        probes=PROBES,
    ),
)
def grade_links(spark, sf):
    issues = findings.grade_links(run_sql(spark, sf, PROBES), ("store_id", "page"))
    return issues.select("store_id", "severity", "title", "detail", F.size("evidence").alias("n_evidence"))


@registry.add(
    "escalate_severity",
    st.with_tables(
        "SELECT id, CASE WHEN page IN ('cart', 'checkout') THEN CASE severity WHEN 'MINOR' THEN 'MAJOR' ELSE 'CRITICAL' END ELSE severity END AS severity FROM issues",
        issues=st.ISSUES,
    ),
)
def escalate_severity(spark, sf):
    issues = run_sql(spark, sf, st.ISSUES)
    return issues.select("id", grading.escalate(F.col("severity"), F.col("page")).alias("severity"))


LONG_ISSUES = """
SELECT doc_id AS id, source AS store_id, concat('  ', substr(text, 1, 260), ' ') AS title, text AS detail, n_chars AS n, lang AS evidence_text FROM {documents}
"""


@registry.add(
    "normalise_issues",
    st.with_tables(
        """SELECT id, CASE WHEN length(trim(title)) <= 200 THEN trim(title) ELSE concat(substr(trim(title), 1, 199), '…') END AS title,
        CASE WHEN length(detail) <= 2000 THEN detail ELSE concat(substr(detail, 1, 1999), '…') END AS detail, 10 AS n_evidence,
        CASE WHEN length(detail) <= 500 THEN detail ELSE concat(substr(detail, 1, 499), '…') END AS first_text FROM issues""",
        issues=LONG_ISSUES,
    ),
)
def normalise_issues(spark, sf):
    record = lambda i: grading.evidence(text=F.col("detail"), count=i)
    many = F.concat(F.array(grading.evidence(text="", count=F.lit(1))), F.transform(F.sequence(F.lit(1), F.lit(12)), record))
    out = grading.normalise_issues(run_sql(spark, sf, LONG_ISSUES).withColumn("evidence", many))
    return out.select("id", "title", "detail", F.size("evidence").alias("n_evidence"), F.col("evidence")[0]["text"].alias("first_text"))


def issues_with_evidence(spark, sf):
    return run_sql(spark, sf, st.ISSUES).withColumn("evidence", F.array(grading.evidence(text=F.col("evidence_text"))))


@registry.add(
    "merge_duplicate_issues",
    st.with_tables(
        """WITH seen AS (SELECT store_id, page, category, evidence_text, min(id) AS f FROM issues GROUP BY ALL),
        kept AS (SELECT store_id, page, category, string_agg(evidence_text, ';' ORDER BY f) AS evidence FROM (SELECT * FROM seen
            QUALIFY row_number() OVER (PARTITION BY store_id, page, category ORDER BY f) <= 10) GROUP BY ALL)
        SELECT i.store_id, i.page, i.category, CASE min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MAJOR' ELSE 'MINOR' END AS severity,
               arg_min(detail, id) FILTER (detail IS NOT NULL) AS detail, min(id) AS id, count(*) AS merged, any_value(k.evidence) AS evidence
        FROM issues i JOIN kept k USING (store_id, page, category) GROUP BY i.store_id, i.page, i.category""",
        issues=st.ISSUES,
    ),
)
def merge_duplicate_issues(spark, sf):
    merged = findings.merge_duplicate_issues(issues_with_evidence(spark, sf), ("store_id", "page", "category"))
    return merged.withColumn("evidence", F.array_join(F.col("evidence")["text"], ";"))


@registry.add(
    "union_findings",
    st.with_tables(
        "SELECT store_id, severity, count(*) AS n FROM (SELECT store_id, severity FROM issues UNION ALL SELECT store_id, severity FROM issues WHERE severity = 'CRITICAL') GROUP BY 1, 2",
        issues=st.ISSUES,
    ),
)
def union_findings(spark, sf):
    issues = issues_with_evidence(spark, sf)
    both = findings.union_findings(issues, issues.filter("severity = 'CRITICAL'").drop("detail"))
    return both.groupBy("store_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "worst_issue_first",
    st.with_tables(
        """SELECT store_id, id, severity, page, rn FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END,
        CASE page WHEN 'site' THEN 0 WHEN 'homepage' THEN 1 WHEN 'collection' THEN 2 WHEN 'product' THEN 3 WHEN 'cart' THEN 4 WHEN 'checkout' THEN 5 ELSE 6 END, id) AS rn FROM issues)""",
        issues=st.ISSUES,
    ),
)
def worst_issue_first(spark, sf):
    return findings.number_worst_first(run_sql(spark, sf, st.ISSUES), ["store_id"], "id", "rn").select("store_id", "id", "severity", "page", "rn")


@registry.add("issues_worst_first", st.with_tables("SELECT store_id, id, severity, page, title FROM issues ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 ELSE 2 END, CASE page WHEN 'product' THEN 3 WHEN 'cart' THEN 4 WHEN 'checkout' THEN 5 ELSE 6 END, title", issues=st.ISSUES))
def issues_worst_first(spark, sf):
    return findings.worst_first(run_sql(spark, sf, st.ISSUES)).select("store_id", "id", "severity", "page", "title")


CHECKS = """
SELECT l_orderkey AS audit_id, l_suppkey AS page_no, l_partkey AS check_no, concat('check ', CAST(l_partkey AS VARCHAR(20))) AS name,
       CASE WHEN l_tax > 0.06 THEN 'failed' ELSE 'ok' END AS status FROM {lineitem}
"""


@registry.add(
    "page_check_summary",
    st.with_tables(
        """SELECT audit_id, count(*) AS run, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
        string_agg(name, ',' ORDER BY check_no) FILTER (status = 'failed') AS failed_checks FROM checks GROUP BY audit_id""",
        checks=CHECKS,
    ),
)
def page_check_summary(spark, sf):
    out = findings.page_check_summary(run_sql(spark, sf, CHECKS), ("audit_id",))
    return out.withColumn("failed_checks", F.array_join("failed_checks", ","))


AUDIT_HEADS = "SELECT o_orderkey AS audit_id, o_orderpriority = '5-LOW' AS blocked, CASE WHEN o_orderstatus = 'F' THEN 'captcha' END AS vendor, CASE WHEN o_orderstatus <> 'O' THEN 'sig' END AS signal FROM {orders}"
AUDIT_PAGES = """SELECT l_orderkey AS audit_id, CASE WHEN l_linenumber < 4 THEN 'homepage' WHEN l_linenumber < 6 THEN 'collection' ELSE 'product' END AS page,
CASE WHEN l_discount > 0.07 THEN 'not_found' WHEN l_discount > 0.05 THEN 'timeout' ELSE 'ok' END AS availability FROM {lineitem}"""
FEW_CHECKS = CHECKS.replace("l_tax > 0.06", "l_tax > 0.07")


@registry.add(
    "audit_verdict",
    st.with_tables(
        """WITH seen AS (SELECT audit_id, bool_or(page = 'homepage' AND availability = 'ok') AS h, bool_or(page = 'collection' AND availability <> 'not_found') AS c,
            bool_or(page = 'product' AND availability <> 'not_found') AS p FROM pages_seen GROUP BY 1),
        f AS (SELECT audit_id, count(*) AS n, string_agg(name, ', ' ORDER BY check_no) AS names FROM checks WHERE status = 'failed' GROUP BY 1),
        s AS (SELECT a.*, n, names, CASE WHEN blocked THEN 'BLOCKED' WHEN NOT coalesce(h, false) THEN 'FAILED' WHEN n > 0 OR NOT p OR NOT c THEN 'PARTIAL' ELSE 'OK' END AS status
              FROM audits a LEFT JOIN seen USING (audit_id) LEFT JOIN f USING (audit_id))
        SELECT audit_id, status, CASE WHEN status = 'BLOCKED' THEN trim(concat('blocked by ', coalesce(vendor, 'bot protection'), ': ', coalesce(signal, '')))
            WHEN status = 'FAILED' THEN 'no homepage' WHEN status = 'PARTIAL' AND n > 0 THEN concat(n, ' failed: ', names)
            WHEN status = 'PARTIAL' THEN 'a key page is missing' END AS reason FROM s""",
        audits=AUDIT_HEADS,
        pages_seen=AUDIT_PAGES,
        checks=FEW_CHECKS,
    ),
)
def audit_verdict(spark, sf):
    return findings.audit_verdict(*[run_sql(spark, sf, t) for t in (AUDIT_HEADS, AUDIT_PAGES, FEW_CHECKS)])


FETCHES = """
SELECT event_id AS audit_id, user_id AS store_id, 'homepage' AS page, 'https://s/' AS url, CAST(300 + floor(value) AS INT) AS duration_ms,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(300 + floor(value) AS INT) END AS status,
       CASE WHEN event_type = 'error' AND value < 30 THEN 'page.goto: Timeout 30000ms exceeded' WHEN event_type = 'error' AND value < 60 THEN 'net::ERR_NAME' WHEN event_type = 'click' THEN '' END AS error
FROM {events}
"""
AVAILABLE = """CASE WHEN error <> '' THEN CASE WHEN error LIKE '%Timeout%' THEN 'timeout' ELSE 'unreachable' END
WHEN status IS NULL THEN 'unreachable' WHEN status >= 400 THEN 'http_error' ELSE 'ok' END"""


@registry.add("classify_navigations", st.with_tables(f"SELECT audit_id, {AVAILABLE} AS availability FROM fetches", fetches=FETCHES))
def classify_navigations(spark, sf):
    return findings.classify_navigations(run_sql(spark, sf, FETCHES)).select("audit_id", "availability")


@registry.add(
    "grade_navigations",
    st.with_tables(
        f"""SELECT audit_id, CASE WHEN a = 'http_error' AND status < 500 THEN 'MAJOR' ELSE 'CRITICAL' END AS severity,
        CASE a WHEN 'timeout' THEN 'Page did not finish loading' WHEN 'http_error' THEN concat('Page returns HTTP ', status) ELSE 'Page could not be opened' END AS title
        FROM (SELECT *, {AVAILABLE} AS a FROM fetches) WHERE a <> 'ok'""",
        fetches=FETCHES,
    ),
)
def grade_navigations(spark, sf):
    return findings.grade_navigations(run_sql(spark, sf, FETCHES)).select("audit_id", "severity", "title")


WALLED = """
SELECT doc_id, CASE WHEN source = 'src1' THEN 'Just a Moment...' WHEN source = 'src2' THEN 'Access Denied' ELSE '' END AS title,
       CASE WHEN source = 'src3' THEN concat('pardon our interruption ', text) WHEN source = 'src4' THEN concat('Press & Hold ', text) ELSE text END AS body_text,
       CASE WHEN source = 'src5' THEN '1' END AS datadome, n_chars > 300 AND lang = 'fr' AS has_challenge_frame,
       CASE WHEN lang = 'de' THEN 403 WHEN lang = 'es' THEN 429 ELSE 200 END AS status, text
FROM {documents}
"""


@registry.add(
    "classify_bot_walls",
    st.with_tables(
        """SELECT doc_id, signal IS NOT NULL AS blocked, CASE WHEN signal LIKE 'title%' THEN 'cloudflare' WHEN signal LIKE 'DataDome%' THEN 'datadome' WHEN signal LIKE 'Imperva%' THEN 'imperva'
            WHEN signal LIKE 'Perimeter%' THEN 'perimeterx' WHEN signal LIKE 'captcha%' THEN 'captcha' WHEN signal IS NOT NULL THEN 'unknown' END AS vendor, signal
        FROM (SELECT doc_id, CASE WHEN lower(title) LIKE '%just a moment%' THEN concat('title: ', title) WHEN datadome = '1' THEN 'DataDome interstitial'
            WHEN lower(body_text) LIKE '%pardon our interruption%' THEN 'Imperva/Incapsula block page' WHEN lower(body_text) LIKE '%press & hold%' THEN 'PerimeterX human-verification page'
            WHEN has_challenge_frame AND length(trim(body_text)) < 1500 THEN 'captcha challenge on an otherwise empty page'
            WHEN status IN (403, 429) AND regexp_matches(lower(concat(title, ' ', body_text)), 'access denied|forbidden|unusual traffic|blocked') THEN concat('HTTP ', status, ' with a block page')
            WHEN status IN (403, 429) AND length(trim(body_text)) < 1500 THEN concat('HTTP ', status, ' with a near-empty page (', length(trim(body_text)), ' chars)') END AS signal FROM fetches)""",
        fetches=WALLED,
    ),
)
def classify_bot_walls(spark, sf):
    headers = F.when(F.col("datadome").isNotNull(), F.create_map(F.lit("x-datadome"), F.col("datadome"))).otherwise(F.create_map().cast("map<string,string>"))
    fetches = run_sql(spark, sf, WALLED).withColumn("headers", headers)
    return walls.classify_bot_walls(fetches).select("doc_id", "blocked", "vendor", "signal")


PLAIN_PAGES = "SELECT doc_id, CASE WHEN source = 'src7' THEN 404 ELSE 200 END AS status, CASE WHEN lang = 'en' THEN concat('Page Not Found ', text) ELSE text END AS text FROM {documents}"


@registry.add(
    "drop_missing_pages",
    st.with_tables("SELECT doc_id FROM p WHERE NOT (status >= 400 OR (length(text) <= 400 AND regexp_matches(lower(text), '404|not found|nie znaleziono|strona nie istnieje')))", p=PLAIN_PAGES),
)
def drop_missing_pages(spark, sf):
    return walls.drop_missing_pages(run_sql(spark, sf, PLAIN_PAGES)).select("doc_id")


SKIP_CONTEXTS = """
SELECT o_orderkey AS store_id, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'FAILED' END AS audit_status, CASE WHEN o_totalprice < 50000 THEN 'boom' END AS audit_error,
       o_orderpriority = '5-LOW' AS blocked, CASE WHEN o_totalprice > 450000 THEN 423 ELSE 200 END AS home_status, 4 AS pages_seen,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE 3 END AS pages_ok, CASE WHEN o_totalprice < 90000 THEN 0 ELSE 9 END AS products_count,
       CASE WHEN o_totalprice > 100000 THEN CAST(floor(o_totalprice / 20) AS BIGINT) END AS revenue_estimate, CAST(floor(o_totalprice / 200) AS BIGINT) AS traffic_estimate,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 2 END AS contact_count
FROM {orders}
"""


@registry.add(
    "apply_skip_rules",
    st.with_tables(
        """SELECT store_id, r IS NOT NULL AS skip, r AS skip_reason FROM (SELECT store_id, CASE WHEN blocked THEN NULL WHEN home_status IN (402, 423) THEN 'closed'
            WHEN audit_status IS NULL OR audit_status = 'FAILED' THEN 'no_storefront' WHEN pages_seen > 0 AND pages_ok = 0 THEN 'no_storefront' WHEN products_count = 0 THEN 'closed'
            WHEN revenue_estimate < 10000 AND traffic_estimate < 1000 THEN 'too_small' WHEN contact_count = 0 THEN 'no_contacts' END AS r FROM contexts)""",
        contexts=SKIP_CONTEXTS,
    ),
)
def apply_skip_rules(spark, sf):
    return walls.apply_skip_rules(run_sql(spark, sf, SKIP_CONTEXTS)).select("store_id", "skip", "skip_reason")
