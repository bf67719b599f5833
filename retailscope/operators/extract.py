"""Facts read from fetched pages.

Every job is a projection of the page table, so pages of one busy host spread
over all tasks. ``page_keys`` names the columns that identify a page. Lists are
exploded with the outer form and filtered after: the inner form makes the
optimizer test the list for emptiness at the scan, and so work it out twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailscope.functions import html as h
from retailscope.functions import mail
from retailscope.functions.people import BEFORE_NAME, INTRODUCTION, NAME_THEN_ROLE, ROLE_THEN_NAME, detect_role, looks_like_person_name
from retailscope.functions.urls import url_host

# Page kinds by how telling they are for addresses and links.
CONTACT_PAGE_KINDS = ("contact", "about", "home", "privacy", "terms")
#: Characters of a link text that are kept.
MAX_TEXT = 80
# Wording and patterns of product, listing, cart and checkout pages.
ADD_TO_CART = "(?iu)do koszyka|dodaj|add to (cart|bag)|kup(uj[eę])?$"
BUY_NOW = "(?iu)kup teraz|buy it now|buy now|zamów teraz"
SOLD_OUT = "(?iu)wyprzedan|niedost[eę]pn|brak w magazynie|sold out|out of stock"
DELIVERY = "(?iu)dostaw|wysy[łl]k|przesy[łl]k|shipping|delivery"
RETURNS = "(?iu)zwrot|reklamacj|odst[aą]pieni|returns?|refund"
PRICE = "(?iu)(\\d[\\d\\s]*[,.]?\\d*)\\s*(zł|pln|eur|€|\\$|usd)|(€|\\$)\\s*\\d"
LOGIN_WALL = "(?iu)zaloguj|musisz się zalogować|sign in to continue|log in to continue"
GUEST = "(?iu)kontynuuj jako go[śs][ćc]|guest|bez rejestracji|continue as guest"
PAYMENTS = "(?i)blik|przelewy24|p24|payu|tpay|dotpay|paypal|apple\\s?pay|google\\s?pay|shop\\s?pay|karta|visa|mastercard|klarna|za pobraniem"
CHECKOUT_TEXT = "(?iu)do kasy|zam[oó]wienie|checkout|kasa"
COUNTRY_NAMES = {"PL": "(?i)polska|poland"}
CURRENCIES = {"PL": "(?i)\\d\\s*z[łl]|\\bPLN\\b"}


def read_page_corpus(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Fetched pages with the origin and host of each.

    Rows are spread by page, never by shop, so a shop with a third of all pages
    does not end up in one task.
    """
    pages = spark.read.parquet(path)
    located = pages.withColumn("host", url_host(F.col("url"))).withColumn(
        "origin", F.regexp_extract("url", "^(?i)(https?://[^/?#]+)", 1)
    )
    return located.repartition(partitions) if partitions else located


def with_text(pages: DataFrame) -> DataFrame:
    """Pages with their markup (``_m``), it in lower case (``_low``) and the text shown (``_text``), each worked out once."""
    marked = pages.withColumn("_m", h.markup(F.col("html"))).withColumn("_bare", h.bare_text(h.without_head(F.col("_m"))))
    return marked.withColumn("_low", F.lower("_m")).withColumn("_text", h.decoded_text(F.col("_bare")))


def extract_page_text(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Collapsed text of each page and its distinct ``mailto:`` addresses."""
    html = F.col("_m")
    links = F.filter(F.transform(h.open_tags(html, "a"), lambda t: h.attribute(t, "href")), lambda v: v.rlike("(?i)^mailto:"))
    addresses = F.transform(links, lambda v: F.regexp_extract(v, "(?is)^mailto:([^?]*)", 1))
    decoded = F.transform(
        addresses, lambda a: F.trim(F.coalesce(F.try_url_decode(F.replace(a, F.lit("+"), F.lit("%2B"))), a))
    )
    return with_text(pages).select(
        *page_keys,
        F.col("_text").alias("text"),
        F.array_distinct(F.filter(decoded, lambda a: a != "")).alias("mailtos"),
    )


@F.pandas_udf(T.StringType())
def _resolved(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return pd.Series([urljoin(b, r) if b is not None and r is not None else None for b, r in zip(bases, hrefs)], dtype=object)


def joined_url(base: Column, href: Column) -> Column:
    """A link put onto its page's address; dot segments stay."""
    link = F.trim(href)
    scheme = F.regexp_extract(base, "^([a-zA-Z]+):", 1)
    origin = F.regexp_extract(base, "^(?i)(https?://[^/?#]+)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    plain = (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", page)
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )
    return plain


def absolute_url(base: Column, href: Column) -> Column:
    """A link resolved against its page; dot segments by one vectorised step."""
    link = F.trim(href)
    dotted = link.rlike("(?:^|/)\\.{1,2}(?:/|$|[?#])")
    return F.when(dotted, _resolved(F.when(dotted, base), F.when(dotted, link))).otherwise(joined_url(base, href))


def footer_start() -> str:
    marks = (
        h.element("footer"),
        h.selector("role", "contentinfo"),
        h.selector("class", "footer", "contains"),
        h.selector("id", "shopify-section-footer"),
    )
    return "(?is)" + "|".join(f"(?:{m})" for m in marks)


def extract_links(pages: DataFrame, page_keys: Sequence[str] = ("page_id",), max_links: int | None = None, max_text: int = MAX_TEXT) -> DataFrame:
    """Links of each page in document order, absolute, with their text.

    A link is internal when it shares the page's origin, and in the footer when
    it follows the start of one. All links are listed unless a limit is given;
    texts are cut to ``max_text`` characters.
    """
    html = h.markup(F.col("html"))
    # the footer runs from its first mark to the end tag, or to the end of the page
    body = F.split(html, footer_start(), 2)
    anchors = "(?is)<a\\s[^>]*?\\bhref\\s*=[^>]*>.*?</a\\s*>"

    def listed(part: Column, in_footer: bool) -> Column:
        found = F.regexp_extract_all(part, F.lit(anchors), F.lit(0))
        return F.transform(found, lambda a: F.struct(a.alias("a"), F.lit(in_footer).alias("in_footer")))

    none = F.array().cast("array<struct<a:string,in_footer:boolean>>")
    after = F.try_element_at(body, F.lit(2))
    inside = F.regexp_extract(after, "(?is)^(.*?)(?:</footer\\s*>|\\z)", 1)
    beyond = F.regexp_extract(after, "(?is)</footer\\s*>(.*)\\z", 1)
    everything = F.concat(
        listed(body[0], False), F.coalesce(listed(inside, True), none), F.coalesce(listed(beyond, False), none)
    )
    rows = pages.withColumn("_links", everything if max_links is None else F.slice(everything, 1, max_links)).select(
        *page_keys, "url", F.posexplode_outer("_links").alias("pos", "l")
    ).filter(F.col("l").isNotNull())
    parts = rows.withColumn("href", h.entities(h.attribute(F.col("l.a"), "href"))).withColumn(
        "text", F.substring(F.trim(h.raw_text(h.content(F.col("l.a")))), 1, max_text)
    )
    absolute = parts.withColumn("absolute_url", absolute_url(F.col("url"), F.col("href")))
    origin = lambda c: F.lower(F.regexp_extract(c, "^(?i)(https?://[^/?#]+)", 1))
    own = origin(F.col("absolute_url"))
    return absolute.select(
        *page_keys, "pos", "href", "text", "absolute_url",
        ((own != "") & (own == origin(F.col("url")))).alias("internal"),
        F.col("l.in_footer").alias("in_footer"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _schema_types(documents: pd.Series) -> pd.Series:
    """Types declared at the top of JSON-LD blocks and in their graphs."""

    def read(blocks) -> list[str]:
        names: list[str] = []
        for block in blocks:
            try:
                parsed = json.loads(block)
            except ValueError:
                continue
            waiting = list(parsed) if isinstance(parsed, list) else [parsed]
            while waiting:
                node = waiting.pop(0)
                if not isinstance(node, dict):
                    continue
                declared = node.get("@type")
                names += [t for t in (declared if isinstance(declared, list) else [declared]) if isinstance(t, str)]
                if isinstance(node.get("@graph"), list):
                    waiting += node["@graph"]
        return list(dict.fromkeys(names))

    return documents.map(read, na_action="ignore")


def extract_seo_facts(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Title, description, headings, canonical link, robots meta, language,
    structured data types and image texts of each page."""
    html = h.markup(F.col("html"))
    blocks = h.json_ld_blocks(h.without_comments(F.col("html")))
    none = F.array().cast("array<string>")
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))

    def meta(name: str) -> Column:
        named = F.filter(h.open_tags(F.col("_m"), "meta"), lambda t: F.lower(h.attribute(t, "name")) == name)
        return filled(h.entities(h.attribute(F.try_element_at(named, F.lit(1)), "content")))

    canonical = F.try_element_at(
        F.filter(h.open_tags(F.col("_m"), "link"), lambda t: h.attribute(t, "rel") == "canonical"), F.lit(1)
    )
    heading = F.regexp_extract("_m", "(?is)<h1\\b[^>]*>(.*?)</h1\\s*>", 1)
    title = F.regexp_extract("_m", "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1)
    images = h.open_tags(F.col("_m"), "img")
    root = F.try_element_at(h.open_tags(F.col("_m"), "html"), F.lit(1))
    facts = pages.withColumn("_m", html).withColumn("_blocks", blocks).select(
        *page_keys,
        "url",
        filled(F.regexp_replace(h.entities(title), "(?U)\\s+", " ")).alias("title"),
        meta("description").alias("description"),
        F.size(h.open_tags(F.col("_m"), "h1")).alias("h1_count"),
        filled(F.substring(F.trim(h.raw_text(heading)), 1, 120)).alias("h1_text"),
        h.attribute(canonical, "href").alias("canonical"),
        meta("robots").alias("robots_meta"),
        h.attribute(root, "lang").alias("lang"),
        h.matches_any(F.col("_m"), h.selector("property", "og:", "starts", "meta")).alias("open_graph"),
        F.when(F.size("_blocks") > 0, _schema_types(F.when(F.size("_blocks") > 0, F.col("_blocks")))).otherwise(none).alias("schema_types"),
        F.size(images).alias("images"),
        F.size(F.filter(images, lambda t: h.attribute(t, "alt").isNotNull())).alias("images_with_alt"),
    )
    length = lambda name: F.coalesce(F.length(name), F.lit(0))
    return (
        facts.withColumn("title_length", length("title"))
        .withColumn("description_length", length("description"))
        .withColumn("noindex", F.coalesce(F.col("robots_meta").rlike("(?i)noindex"), F.lit(False)))
    )


_NODES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("node", T.StringType())]))


def _node_reader() -> Callable[[Sequence[str]], list[tuple[str, str]]]:
    def walk(node, depth: int, out: list) -> None:
        if depth > 8 or not isinstance(node, (dict, list)):
            return
        if isinstance(node, dict):
            declared = node.get("@type")
            text = json.dumps(node, ensure_ascii=False)
            out += [(t, text) for t in (declared if isinstance(declared, list) else [declared]) if isinstance(t, str)]
        for child in node if isinstance(node, list) else node.values():
            walk(child, depth + 1, out)

    def read(blocks: Sequence[str]) -> list[tuple[str, str]]:
        out: list = []
        for block in blocks:
            try:
                walk(json.loads(block), 0, out)
            except ValueError:
                continue
        return out

    return read


#: Typed nodes of JSON-LD blocks down to eight levels, with their text.
typed_nodes = _node_reader()


@F.pandas_udf(_NODES)
def _typed_nodes(documents: pd.Series) -> pd.Series:
    return documents.map(typed_nodes, na_action="ignore")


def extract_json_ld(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per typed JSON-LD node, as a variant; broken blocks are skipped."""
    blocks = h.json_ld_blocks(F.col("html"))
    with_blocks = pages.withColumn("_b", blocks).filter(F.size("_b") > 0)
    nodes = with_blocks.select(*page_keys, F.posexplode_outer(_typed_nodes(F.col("_b"))).alias("pos", "n")).filter(F.col("n").isNotNull())
    return nodes.select(*page_keys, "pos", F.col("n.type").alias("type"), F.try_parse_json("n.node").alias("node"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_ld_emails(documents: pd.Series) -> pd.Series:
    """Text under any ``email`` key of JSON-LD blocks, eight levels deep."""

    def walk(node, depth: int, out: list[str]) -> None:
        if depth > 8 or not isinstance(node, (dict, list)):
            return
        if isinstance(node, list):
            for child in node:
                walk(child, depth + 1, out)
            return
        for key, value in node.items():
            if key.lower() == "email" and isinstance(value, str):
                out.append(value.strip())
            else:
                walk(value, depth + 1, out)

    def read(blocks) -> list[str]:
        out: list[str] = []
        for block in blocks:
            try:
                walk(json.loads(block), 0, out)
            except ValueError:
                continue
        return out

    return documents.map(read, na_action="ignore")


_CANDIDATES = "array<struct<email:string,source:string,evidence:string>>"
EVIDENCE_PADDING = 60
# No pattern matches fewer characters, so a match and its neighbours fill what is shown around it.
MIN_MATCH = 4


def scan(df: DataFrame, name: str, text: str, pattern: str, only_if: Column, kind: str, build, near: int = EVIDENCE_PADDING) -> DataFrame:
    """Adds the matches of a pattern in a text column, each built into a struct.

    ``build(match, seen)`` gets a match, ``seen.evidence`` (the text around it,
    with ellipses where it was cut) and ``seen.near`` (``near`` characters on
    both sides and itself). These are put together from the next few matches
    and gaps, so the work is linear in the matches of a text.
    """
    neighbours = max(near, EVIDENCE_PADDING) // MIN_MATCH + 1
    none = F.array().cast("array<string>")
    w, g, led, followed = (F.col(f"_{k}_{name}") for k in "wglf")

    def evidence(m: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(led, F.greatest(i - neighbours, F.lit(0)) + 1, F.least(i, F.lit(neighbours))), ""), g[i])
        after = F.concat(g[i + 1], F.array_join(F.slice(followed, i + 2, F.lit(neighbours)), ""))
        cut = lambda side: F.when(F.length(side) > EVIDENCE_PADDING, F.lit("…")).otherwise(F.lit(""))
        around = lambda n: F.concat(F.right(before, F.lit(n)), m, F.left(after, F.lit(n)))
        return F.struct(F.concat(cut(before), F.trim(around(EVIDENCE_PADDING)), cut(after)).alias("evidence"), around(near).alias("near"))

    some = F.size(w) > 0
    staged = df.withColumn(f"_w_{name}", F.when(only_if, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    staged = staged.withColumn(f"_g_{name}", F.when(some, F.split(F.col(text), pattern)).otherwise(none))
    staged = staged.withColumns({
        f"_l_{name}": F.when(some, F.zip_with(F.slice(g, F.lit(1), F.size(w)), w, lambda a, b: F.concat(a, b))).otherwise(none),
        f"_f_{name}": F.when(some, F.zip_with(w, F.slice(g, F.lit(2), F.size(w)), lambda a, b: F.concat(a, b))).otherwise(none),
    })
    staged = staged.withColumn(f"_e_{name}", F.when(some, F.transform(w, evidence)))
    return staged.withColumn(name, F.when(some, F.zip_with(w, f"_e_{name}", build)).otherwise(F.array().cast(kind)))


def extract_emails(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Valid addresses of each page with source and evidence.

    ``pages``: text, html, mailtos, kind, url and store_domain. Sources are
    mailto links, JSON-LD, plain text and obfuscated text.
    """
    empty = F.array().cast(_CANDIDATES)
    text = F.coalesce("text", F.lit(""))
    html = F.coalesce("html", F.lit(""))
    mailto = F.transform(
        F.coalesce("mailtos", F.array().cast("array<string>")),
        lambda a: F.struct(F.lower(a).alias("email"), F.lit("mailto").alias("source"), F.concat(F.lit("mailto:"), a).alias("evidence")),
    )
    blocks = h.json_ld_blocks(html)
    declared = F.transform(
        _json_ld_emails(F.when(F.size(blocks) > 0, blocks)),
        lambda a: F.struct(F.lower(F.trim(F.regexp_replace(a, "(?i)^mailto:", ""))).alias("email"), F.lit("jsonld").alias("source"), F.lit("JSON-LD email").alias("evidence")),
    )
    opened = F.regexp_replace(F.regexp_replace(F.col("_text"), mail.BRACKETED_AT, "@"), mail.BRACKETED_DOT, ".")
    spelled = lambda m: F.concat(
        F.regexp_extract(m, mail.SPELLED_OUT, 1), F.lit("@"), F.regexp_extract(m, mail.SPELLED_OUT, 2), F.lit("."), F.regexp_extract(m, mail.SPELLED_OUT, 3)
    )
    bracketed = F.col("_text").rlike("(?iu)[(\\[{<]\\s*(?:at|malpa|małpa|dot|kropka)\\s*[)\\]}>]")
    worded = F.col("_text").rlike("(?iu)\\s(?:dot|kropka)\\s")

    def found(source: str, address=lambda m: m):
        return lambda m, seen: F.struct(F.lower(address(m)).alias("email"), F.lit(source).alias("source"), seen["evidence"].alias("evidence"))

    staged = pages.withColumn("_text", text).withColumn("_opened", F.when(bracketed, opened).otherwise(F.col("_text")))
    staged = scan(staged, "_plain", "_text", mail.EMAIL, F.col("_text").contains("@"), _CANDIDATES, found("text"))
    changed = F.col("_opened") != F.col("_text")
    staged = scan(staged, "_open", "_opened", mail.EMAIL, changed, _CANDIDATES, found("obfuscated"))
    staged = scan(staged, "_words", "_text", mail.SPELLED_OUT, worded, _CANDIDATES, found("obfuscated", spelled))
    known = F.col("_plain")["email"]
    staged = (
        staged.withColumn("_hidden", F.filter(F.concat("_open", "_words"), lambda c: ~F.array_contains(known, c["email"])))
        .withColumn("_all", F.concat(mailto, F.coalesce(declared, empty), F.col("_plain"), F.col("_hidden")))
    )
    rows = staged.select(*page_keys, "store_domain", F.col("kind").alias("page_kind"), F.col("url").alias("page_url"), F.posexplode_outer("_all").alias("pos", "c"))
    email = F.lower(F.trim("c.email"))
    return rows.filter(mail.valid_email(F.col("c.email"))).select(
        *page_keys, "pos", email.alias("email"),
        F.when(mail.is_generic_mailbox(email), F.lit("generic")).otherwise(F.lit("personal")).alias("bucket"),
        F.col("c.source").alias("source"), "page_kind", "page_url", F.col("c.evidence").alias("evidence"),
        mail.is_own_domain(email, F.col("store_domain")).alias("own_domain"),
    )


# A profile or company page, and slugs that are neither.
PROFILE_LINK = "(?i)https?://(?:[a-z]{2,3}\\.)?linkedin\\.com/(in|company|pub)/([a-z0-9%._-]{2,100})"
RESERVED_SLUGS = ("dir", "directory")


def profile_parts(link: Column) -> Column:
    """Canonical URL, kind and slug of a profile link, or null."""
    slug = F.lower(F.regexp_replace(F.regexp_extract(link, PROFILE_LINK, 2), "[._-]+$", ""))
    company = F.lower(F.regexp_extract(link, PROFILE_LINK, 1)) == "company"
    path = F.when(company, F.lit("company")).otherwise(F.lit("in"))
    return F.when(
        (slug != "") & ~slug.isin(*RESERVED_SLUGS),
        F.struct(
            F.concat(F.lit("https://www.linkedin.com/"), path, F.lit("/"), slug).alias("link"),
            F.when(company, F.lit("company")).otherwise(F.lit("profile")).alias("link_kind"),
            slug.alias("slug"),
        ),
    )


def extract_profile_links(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Profile and company links of each page in canonical form."""
    found = F.transform(F.regexp_extract_all("html", F.lit(PROFILE_LINK), F.lit(0)), profile_parts)
    rows = pages.select(*page_keys, F.col("kind").alias("page_kind"), F.col("url").alias("page_url"), F.posexplode_outer(found).alias("pos", "t"))
    return rows.filter(F.col("t").isNotNull()).select(*page_keys, "pos", "page_kind", "page_url", "t.*")


def extract_structure_facts(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Navigation, search field, header and footer as written in the markup."""
    m, has = F.col("_m"), partial(h.matches_any, F.col("_m"), low=F.col("_low"))
    nav = F.concat(h.elements(m, "nav"), h.elements(m, "header"))
    # links inside a nav inside a header are counted once
    nav_links = F.array_distinct(F.flatten(F.transform(nav, lambda n: h.elements(n, "a"))))
    labels = h.entities_list(F.transform(F.slice(nav_links, 1, 5), lambda a: F.trim(h.raw_text(h.content(a), decode=False))))
    after = F.try_element_at(F.split(m, _footer_marks(), 2), F.lit(2))
    inside = F.regexp_extract(after, "(?is)^(.*?)(?:</footer\\s*>|\\z)", 1)
    footer = h.entities_list(F.transform(F.slice(h.elements(inside, "a"), 1, 40), lambda a: F.trim(h.raw_text(h.content(a), decode=False))))
    return pages.withColumn("_m", h.markup(F.col("html"))).withColumn("_low", F.lower("_m")).select(
        *page_keys,
        "url",
        F.size(nav_links).alias("nav_links"),
        F.transform(labels, lambda t: F.substring(t, 1, 40)).alias("nav_samples"),
        has(h.element("nav"), h.selector("role", "navigation")).alias("has_nav"),
        has(
            h.selector("aria-label", "menu", "contains", "button|summary"),
            h.selector("aria-label", "nawigacj", "contains", "button"),
            h.selector("aria-controls", "menu", "contains", "button"),
            h.selector("data-menu-toggle"),
            h.selector("class", "header__icon--menu", "word"),
            h.selector("class", "js-mobile-nav-toggle", "word", "button"),
        ).alias("has_toggle"),
        has(
            h.selector("type", "search", tag="input"),
            h.selector("name", "q", tag="input"),
            h.selector("action", "/search", "contains", "form"),
            h.selector("href", "/search", "contains", "a"),
            h.selector("role", "search"),
        ).alias("has_search"),
        has(
            h.element("header"), h.selector("role", "banner"), h.selector("class", "site-header", "word"), h.selector("id", "shopify-section-header")
        ).alias("has_header"),
        m.rlike(_footer_marks()).alias("has_footer"),
        F.coalesce(footer, F.array().cast("array<string>")).alias("footer_links"),
        F.lit(True).alias("static"),
    )


def _footer_marks() -> str:
    marks = (h.element("footer"), h.selector("role", "contentinfo"), h.selector("class", "site-footer", "word"))
    return "(?is)" + "|".join(f"(?:{m})" for m in marks)


def _marked(attributes: str) -> str:
    """A pattern for elements by the attributes of their opening tag; group 2 is the content."""
    # a tag without these is left at once, not for each shorter name it could have
    return f"(?is)<(?=[a-z][^>]*(?:{attributes}))([a-z][a-z0-9]*)(?=[^>]*(?:{attributes}))[^>]*>(.*?)</\\1\\s*>"


def _texts(m: Column, name: str) -> Column:
    return F.transform(h.elements(m, name), lambda e: h.inner_text(h.content(e), decode=False))


def extract_product_facts(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """What a product page offers, from its markup."""
    m, text, low = F.col("_m"), F.col("_text"), F.col("_low")
    has = partial(h.matches_any, m, low=low)
    form = h.extract_any(m, low, ["/cart/add"], f"(?is)({h.selector('action', '/cart/add', 'contains', 'form')}[^>]*>.*?)</form\\s*>", 1)
    scope = F.when(F.col("_form") != "", F.col("_form")).otherwise(m)
    submit = F.regexp_extract(
        scope,
        "(?is)(" + "|".join([h.selector("name", "add"), h.selector("type", "submit", tag="button")]) + ")[^>]*>",
        0,
    )
    buttons = F.filter(h.elements(m, "button"), lambda b: F.trim(h.inner_text(h.content(b), decode=False)).rlike(ADD_TO_CART))
    inputs = F.filter(
        h.open_tags(m, "input"), lambda t: (F.lower(h.attribute(t, "type")) == "submit") & F.trim(h.attribute(t, "value")).rlike(ADD_TO_CART)
    )
    button = F.coalesce(F.when(submit != "", submit), F.try_element_at(buttons, F.lit(1)), F.try_element_at(inputs, F.lit(1)))
    tag = F.regexp_extract(F.col("_button"), "(?s)^<[^>]*>", 0)
    # what follows a pattern is optional, so it matches where any of these does
    has_variants = has(
        h.element("variant-selects|variant-radios"), h.selector("name", "id", tag="select"), h.selector("name", "option", "contains", "select"),
        h.selector("name", "options", "starts"), h.selector("class", "variant", "contains", "fieldset"), h.selector("class", "swatch", "contains"),
    )
    variant_select = h.extract_any(m, low, ["<select"], f"(?is)(?:{h.selector('name', 'id', tag='select')}|{h.selector('name', 'option', 'contains', 'select')})[^>]*>(.*?)</select\\s*>", 0)
    media = F.regexp_extract(
        m, "(?is)(?:" + "|".join(h.selector("class", v, "contains") for v in ("product__media", "product-media", "product-gallery", "product-single__photo", "product-image")) + "|" + h.element("main") + "|" + h.selector("role", "main") + ")(.*)\\z", 1
    )
    description = h.extract_any(
        m, low, ["description", "rte"], _marked("itemprop\\s*=\\s*[\"']description|class\\s*=\\s*[\"'][^\"']*(?:description|\\brte\\b)"), 2
    )
    links = F.filter(
        F.transform(h.open_tags(m, "a"), lambda t: F.regexp_replace(joined_url(F.col("url"), h.attribute(t, "href")), "[?#].*$", "")),
        lambda u: u.contains("/products/"),
    )
    path = lambda c: F.regexp_extract(c, "^(?i)https?://[^/?#]*([^?#]*)", 1)
    related = F.array_distinct(F.filter(F.transform(links, path), lambda p: p != path(F.col("url"))))
    staged = with_text(pages).withColumn("_form", form).withColumn("_button", button)
    staged = staged.withColumn("_label", h.raw_text(h.content(F.col("_button")), decode=False)).withColumn("_described", h.bare_text(description)).withColumn("_select", variant_select)
    return staged.select(
        *page_keys,
        "url",
        (F.col("_form") != "").alias("has_cart_form"),
        F.col("_button").isNotNull().alias("has_add_button"),
        F.coalesce(F.col("_button").isNotNull() & h.attribute(tag, "disabled").isNull() & ~F.coalesce(h.attribute(tag, "aria-disabled") == "true", F.lit(False)), F.lit(False)).alias("add_enabled"),
        F.substring(F.coalesce(h.attribute(tag, "value"), F.trim(h.entities(F.col("_label")))), 1, 80).alias("add_text"),
        (
            has(h.selector("class", "shopify-payment-button", "word"), h.selector("data-buy-now"))
            | F.exists(_texts(m, "button"), lambda t: t.rlike(BUY_NOW))
        ).alias("has_express"),
        (
            has(h.selector("itemprop", "price"), h.selector("class", "price", "contains"), h.selector("class", "money", "word"), h.selector("data-price"))
            | text.rlike(PRICE)
        ).alias("has_price"),
        F.size(h.open_tags(media, "img")).alias("images"),
        has_variants.alias("has_variants"),
        F.size(h.open_tags(F.col("_select"), "option")).alias("variant_options"),
        h.attribute(F.regexp_extract("_select", "(?s)^<[^>]*>", 0), "disabled").isNotNull().alias("variants_disabled"),
        has(h.selector("name", "quantity", tag="input"), h.element("quantity-input"), h.selector("class", "quantity", "contains") + "[^>]*>\\s*<input").alias("has_quantity"),
        F.length(h.decoded_text(F.col("_described"))).alias("description_chars"),
        has(
            h.selector("class", "review", "contains"), h.selector("id", "review", "contains"), h.selector("class", "spr-badge", "word"), h.selector("class", "jdgm-widget", "word"), h.selector("data-reviews")
        ).alias("has_reviews"),
        text.rlike(DELIVERY).alias("has_delivery"),
        text.rlike(RETURNS).alias("has_returns"),
        F.size(related).alias("related"),
        text.rlike(SOLD_OUT).alias("sold_out"),
        F.lit(True).alias("static"),
    )


def extract_listing_facts(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Product cards of a listing and its tools, from the markup.

    A card starts at a list item, article or card element and ends where the
    next one starts.
    """
    m, has = F.col("_m"), partial(h.matches_any, F.col("_m"), low=F.col("_low"))
    classes = ("card", "card-wrapper", "product-card", "product-item")
    start = "(?is)(?=<(?:li|article)[\\s>])|" + "|".join(f"(?={h.selector('class', v, 'word')})" for v in classes) + f"|(?={h.selector('data-product-card')})"
    product = "(?is)" + h.selector("href", "/products/", "contains", "a")
    cards = F.filter(F.split(m, start), lambda s: s.rlike(product))
    text = lambda s: h.inner_text(s, decode=False)
    has_image = lambda s: s.rlike("(?is)<img\\b|<image\\b|style\\s*=\\s*[\"'][^\"']*background-image")
    price_node = "(?is)" + "|".join([h.selector("class", "price", "contains"), h.selector("class", "money", "word"), h.selector("data-price")])
    has_price = lambda s: s.rlike(price_node) | text(s).rlike(PRICE)

    def name_of(s: Column) -> Column:
        tag = F.regexp_extract(s, "(?s)^<[^>]*>", 0)
        kind = F.lower(F.regexp_extract(tag, "^<([a-zA-Z0-9-]+)", 1))
        first = F.split_part(F.trim(F.coalesce(h.attribute(tag, "class"), F.lit(""))), F.lit(" "), F.lit(1))
        return F.coalesce(
            F.concat(F.lit("#"), F.when(h.attribute(tag, "id") != "", h.attribute(tag, "id"))),
            F.when(first != "", F.concat(kind, F.lit("."), first)),
            kind,
        )

    count = lambda test: F.size(F.filter("_cards", test))
    opening = "(?is)^" + h.selector("action", "/cart/add", "contains", "form") + "[^>]*>"
    inside = lambda form: F.element_at(F.split(form, "(?i)</form"), 1)
    buying_form = F.exists("_forms", lambda form: form.rlike(opening) & inside(form).rlike("(?i)<button"))
    return pages.withColumn("_m", h.markup(F.col("html"))).withColumn("_low", F.lower("_m")).withColumn("_cards", cards).withColumn("_forms", F.split(F.col("_m"), "(?i)(?=<form\\s)")).select(
        *page_keys,
        "url",
        F.size("_cards").alias("cards"),
        count(has_image).alias("with_image"),
        count(has_price).alias("with_price"),
        count(lambda s: text(s) != "").alias("with_title"),
        count(lambda s: text(s).rlike(SOLD_OUT)).alias("sold_out"),
        F.slice(F.transform(F.filter("_cards", lambda s: ~has_price(s)), name_of), 1, 5).alias("missing_price"),
        has(
            h.selector("id", "filter", "contains"), h.selector("class", "filter", "contains"), h.selector("id", "facet", "contains"), h.selector("class", "facet", "contains"),
            h.selector("data-filter"), h.selector("name", "filter", "starts", "input"), h.element("facet-filters-form"),
        ).alias("has_filters"),
        has(h.selector("name", "sort_by", tag="select"), h.selector("id", "sort", "contains"), h.selector("class", "sort-by", "contains"), h.selector("data-sort")).alias("has_sorting"),
        has(h.selector("class", "pagination", "contains"), h.selector("href", "page=", "contains", "a"), h.selector("data-infinite-scroll"), h.selector("class", "load-more", "contains")).alias("has_pagination"),
        (has(h.selector("data-quick-add"), h.selector("class", "quick-add", "contains"), h.selector("class", "quick-buy", "contains")) | buying_form).alias("has_quick_add"),
        F.lit(True).alias("static"),
    )


def extract_cart_facts(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Controls of a cart page, from its markup."""
    m, has = F.col("_m"), partial(h.matches_any, F.col("_m"), low=F.col("_low"))
    words = F.concat(_texts(m, "button"), _texts(m, "a"))
    return pages.withColumn("_m", h.markup(F.col("html"))).withColumn("_low", F.lower("_m")).select(
        *page_keys,
        "url",
        has(h.selector("class", "cart-item", "contains"), h.selector("class", "cart__item", "contains"), h.selector("class", "item", "contains", "tr"), h.selector("data-cart-item")).alias("has_lines"),
        has(h.selector("name", "quantity", tag="input"), h.selector("name", "updates", "starts", "input"), h.element("quantity-input"), h.selector("class", "quantity", "contains") + "[^>]*>\\s*<input").alias("has_quantity"),
        has(h.selector("href", "quantity=0", "contains", "a"), h.element("cart-remove-button"), h.selector("class", "cart-remove", "contains"), h.selector("aria-label", "usu", "contains"), h.selector("aria-label", "remove", "contains")).alias("has_remove"),
        has(h.selector("name", "discount", tag="input"), h.selector("id", "discount", "contains") + "[^>]*>\\s*<input", h.selector("class", "discount", "contains") + "[^>]*>\\s*<input").alias("has_discount_field"),
        has(h.selector("class", "shipping-calculator", "contains"), h.selector("id", "shipping-calculator", "contains"), h.selector("class", "shipping-estimate", "contains")).alias("has_delivery_estimate"),
        (has(h.selector("name", "checkout"), h.selector("href", "/checkout", "contains", "a")) | F.exists(words, lambda t: t.rlike(CHECKOUT_TEXT))).alias("has_checkout"),
        F.lit(True).alias("static"),
    )


def extract_checkout_facts(pages: DataFrame, country: str, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Form fields of a checkout page, from its markup."""
    m, text, has = F.col("_m"), F.col("_text"), partial(h.matches_any, F.col("_m"), low=F.col("_low"))
    code = country.upper()
    names = COUNTRY_NAMES.get(code, f"(?i)\\b{code}\\b")
    money = CURRENCIES.get(code, ".")
    select = h.extract_any(
        m, F.col("_low"), ["<select"], "(?is)(?:" + "|".join([h.selector("name", "country", "contains", "select"), h.selector("id", "country", "contains", "select"), h.selector("autocomplete", "country", tag="select")]) + ")[^>]*>.*?</select\\s*>", 0
    )
    options = h.elements(F.col("_select"), "option")
    offered = F.exists(options, lambda o: o.rlike(names))
    required = F.filter(h.open_tags(m, "input|select|textarea"), lambda t: h.attribute(t, "required").isNotNull())
    label_tags = F.transform(h.open_tags(m, "label"), lambda t: h.attribute(t, "for"))
    in_labels = F.flatten(F.transform(h.elements(m, "label"), lambda e: h.open_tags(h.content(e), "input|select|textarea")))

    def unlabelled(t: Column) -> Column:
        by_for = F.coalesce((h.attribute(t, "id") != "") & F.array_contains(label_tags, h.attribute(t, "id")), F.lit(False))
        named = h.attribute(t, "aria-label").isNotNull() | h.attribute(t, "aria-labelledby").isNotNull() | h.attribute(t, "placeholder").isNotNull()
        return ~(by_for | named | F.array_contains(in_labels, t))

    field_name = lambda t: F.coalesce(h.attribute(t, "name"), F.lower(F.regexp_extract(t, "^<([a-zA-Z]+)", 1)))
    payments = F.transform(F.regexp_extract_all(text, F.lit(PAYMENTS), F.lit(0)), F.lower)
    alert = _marked("role\\s*=\\s*[\"']alert|class\\s*=\\s*[\"'][^\"']*(?:error|alert)")
    none = F.array().cast("array<string>")
    alerts = F.when(~h.holds_any(F.col("_low"), ["alert", "error"]), none).otherwise(F.regexp_extract_all(m, F.lit(alert), F.lit(0)))
    errors = F.filter(
        F.transform(alerts, lambda e: h.inner_text(e, decode=False)),
        lambda t: (t != "") & (F.length(t) < 300),
    )
    staged = with_text(pages).withColumn("_select", select)
    return staged.select(
        *page_keys,
        "url",
        has(h.selector("type", "email", tag="input"), h.selector("name", "email", "contains", "input")).alias("has_email_field"),
        has(*[h.selector(a, v, "contains", "input") for a, v in (("name", "address"), ("autocomplete", "address"), ("name", "zip"), ("name", "postal"))]).alias("has_address_fields"),
        (has(h.selector("type", "password", tag="input")) & text.rlike(LOGIN_WALL) & ~text.rlike(GUEST)).alias("requires_login"),
        (F.col("_select") != "").alias("has_country_select"),
        F.size(options).alias("country_options"),
        offered.alias("has_target_country"),
        text.rlike(money).alias("has_local_currency"),
        F.array_distinct(payments).alias("payments"),
        F.size(required).alias("required_fields"),
        F.slice(F.transform(F.filter(required, unlabelled), field_name), 1, 5).alias("unlabelled_required"),
        F.slice(errors, 1, 5).alias("visible_errors"),
        F.lit(True).alias("static"),
    )


_PEOPLE = "array<struct<name:string,found:struct<role:string,matched:string>,title:string,source:string,evidence:string>>"
PERSON_PAGES = ("home", "about", "contact")
ROLE_WINDOW = 90


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])))
def _json_ld_people(documents: pd.Series) -> pd.Series:
    """Name and job title of ``Person`` nodes of JSON-LD blocks."""

    def walk(node, depth: int, out: list) -> None:
        if depth > 8 or not isinstance(node, (dict, list)):
            return
        if isinstance(node, dict):
            declared = node.get("@type")
            kinds = declared if isinstance(declared, list) else [declared]
            name, title = node.get("name"), node.get("jobTitle")
            if any(isinstance(k, str) and k.lower() == "person" for k in kinds) and isinstance(name, str) and name.strip():
                out.append((name.strip(), title.strip() if isinstance(title, str) else None))
        for child in node if isinstance(node, list) else node.values():
            walk(child, depth + 1, out)

    def read(blocks) -> list:
        out: list = []
        for block in blocks:
            try:
                walk(json.loads(block), 0, out)
            except ValueError:
                continue
        return out

    return documents.map(read, na_action="ignore")


def extract_people(pages: DataFrame, page_keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """People a shop's home, about and contact pages name, in page order.

    ``pages``: text, html, kind, url and store_domain. Sources are JSON-LD and
    three ways a text names a person beside a role.
    """
    kept = pages.filter(F.col("kind").isin(*PERSON_PAGES))
    blocks = h.json_ld_blocks(F.coalesce("html", F.lit("")))

    def person(name: Column, found: Column, title: Column, source: str, evidence: Column) -> Column:
        return F.struct(
            F.trim(name).alias("name"), found.alias("found"), title.alias("title"), F.lit(source).alias("source"), evidence.alias("evidence")
        )

    untitled = F.lit(None).cast("string")

    def named(p: Column) -> Column:
        said = F.concat(F.lit("JSON-LD Person"), F.coalesce(F.concat(F.lit(": "), p["title"]), F.lit("")))
        return person(p["name"], detect_role(p["title"]), p["title"], "jsonld", said)

    def introduced(m: Column, seen: Column) -> Column:
        return person(F.regexp_extract(m, INTRODUCTION, 1), detect_role(seen["near"]), untitled, "role_text", seen["evidence"])

    def beside(pattern: str, name_group: int, role_group: int):
        def build(m: Column, seen: Column) -> Column:
            role = detect_role(F.regexp_extract(m, pattern, role_group))
            return person(F.regexp_extract(m, pattern, name_group), role, untitled, "role_text", seen["evidence"])

        return build

    declared = F.transform(_json_ld_people(F.when(F.size(blocks) > 0, blocks)), named)
    staged = kept.withColumn("_text", F.coalesce("text", F.lit("")))
    always = F.lit(True)
    staged = scan(staged, "_intro", "_text", INTRODUCTION, always, _PEOPLE, introduced, ROLE_WINDOW)
    staged = scan(staged, "_before", "_text", NAME_THEN_ROLE, always, _PEOPLE, beside(NAME_THEN_ROLE, 1, 2))
    staged = scan(staged, "_after", "_text", ROLE_THEN_NAME, F.col("_text").rlike(BEFORE_NAME), _PEOPLE, beside(ROLE_THEN_NAME, 2, 1))
    titled = lambda c: F.filter(c, lambda p: p["found"].isNotNull())
    everyone = F.concat(F.coalesce(declared, F.array().cast(_PEOPLE)), F.col("_intro"), titled("_before"), titled("_after"))
    rows = staged.withColumn("_people", everyone).select(
        *page_keys, "store_domain", F.col("kind").alias("page_kind"), F.col("url").alias("page_url"), F.posexplode_outer("_people").alias("pos", "p")
    )
    return rows.filter(F.col("p").isNotNull() & looks_like_person_name(F.col("p.name"), F.col("store_domain"))).select(
        *page_keys, "store_domain", "page_kind", "page_url", "pos", "p.name", F.col("p.found.role").alias("role"),
        F.coalesce("p.title", "p.found.matched").alias("role_text"), "p.source", "p.evidence",
    )
