"""Links and documents of a site: robots rules, sitemaps, key pages, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.functions.ranks import rank_in
from retailscope.functions.urls import domain_key_any, url_path
from retailscope.operators.keyed import first_per_key, id_slice, number_rows

# Limits of what is listed and probed.
MAX_LINKS, MAX_EXTERNAL = 30, 10
# Collections that hold everything or nothing in particular.
LAST_RESORT_COLLECTION = "/collections/(all|frontpage|vendors|types)(\\?|$)"
# Page kinds, by path and by link text.
LINKED_KINDS = ("contact", "about", "privacy", "terms")
KIND_PATHS = {
    "contact": "(?i)(^|/)(contact|contact-us|kontakt|skontaktuj[a-z-]*)(\\.[a-z]+)?$",
    "about": "(?i)(^|/)(about|about-us|our-story|o-nas|o-firmie|kim-jestesmy)(\\.[a-z]+)?$",
    "privacy": "(?i)(^|/)(privacy[a-z-]*|polityka-prywatnosci|prywatnosc)(\\.[a-z]+)?$",
    "terms": "(?i)(^|/)(terms[a-z-]*|tos|regulamin)(\\.[a-z]+)?$",
}
KIND_TEXTS = {
    "contact": "(?i)\\b(contact|kontakt|skontaktuj)",
    "about": "(?iu)\\b(about|o nas|onas|our story|kim jesteśmy|kim jestesmy|nasza historia)",
    "privacy": "(?iu)\\b(privacy|prywatnoś|prywatnos)",
    "terms": "(?i)\\b(terms|regulamin|warunki)",
}
# Role terms of searches, by country.
ROLE_TERMS = ("founder", "CEO", "owner")
LOCAL_ROLE_TERMS = {"PL": ("założyciel", "właściciel", "prezes")}
PROFILE_SITE = "linkedin.com"


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^(?i)(https?://[^/?#]+)", 1))


def read_robots(documents: DataFrame, key: str = "host", text: str = "robots_txt") -> DataFrame:
    """Rules of robots documents: one row per agent and rule, in order.

    An agent without rules keeps a row of kind ``agent``, as its group still
    takes the place of ``*``. Lines are exploded with their positions; groups
    are running totals per document, so the work is linear in its lines.
    """
    lines = F.transform(F.split(text, "\\r?\\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", "")))
    named = documents.withColumn("_doc", F.monotonically_increasing_id())
    rows = named.select(key, "_doc", F.posexplode_outer(lines).alias("_pos", "_line"))
    rows = rows.filter(F.col("_line").contains(":")).select(
        key, "_doc", "_pos", F.lower(F.trim(F.regexp_extract("_line", "^([^:]*):", 1))).alias("kind"),
        F.trim(F.regexp_extract("_line", "^[^:]*:(.*)$", 1)).alias("value"),
    )
    along = W.partitionBy("_doc").orderBy("_pos")
    is_agent = F.col("kind") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(along), F.lit(False))
    grouped = rows.withColumn("_opens", opens).withColumn("_group", F.count_if("_opens").over(along)).filter(F.col("_group") > 0)
    members = F.array_distinct(F.collect_list(F.when(is_agent, F.lower("value"))).over(W.partitionBy("_doc", "_group")))
    numbered = grouped.withColumn("_members", members).withColumn("line_no", F.row_number().over(along) - 1)
    agents = F.when(is_agent, F.array(F.lower("value"))).otherwise(F.col("_members"))
    exploded = numbered.select(key, "line_no", F.explode(agents).alias("agent"), F.when(is_agent, F.lit("agent")).otherwise(F.col("kind")).alias("kind"), "value")
    rule = F.col("kind").isin("allow", "disallow") & (F.col("value") != "")
    delay = (F.col("kind") == "crawl-delay") & (F.col("value").try_cast("double") >= 0)
    return exploded.filter((F.col("kind") == "agent") | rule | delay).select(
        key, "agent", "line_no", "kind",
        F.when(rule, F.col("value")).alias("pattern"),
        F.when(delay, F.col("value").try_cast("double")).alias("crawl_delay"),
    )


def blocks_everything(text: Column) -> Column:
    """Whether a robots document tells every agent to stay out."""
    lines = F.transform(F.split(F.lower(text), "\\n"), F.trim)
    tidy = F.array_join(F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "\\r", ""))), "\n")
    groups = F.slice(F.split(tidy, "(?m)^user-agent:"), F.lit(2), F.length(tidy) + 1)
    rows = lambda g: F.transform(F.split(g, "\n"), lambda line: F.regexp_replace(line, "(?U)\\s+", ""))
    return F.coalesce(
        F.exists(groups, lambda g: (F.trim(F.split(g, "\n")[0]) == "*") & F.array_contains(rows(g), "disallow:/")), F.lit(False)
    )


def site_seo_facts(sites: DataFrame) -> DataFrame:
    """Robots and sitemap facts per site; a missing document is null."""
    return sites.select(
        "*",
        F.col("robots_txt").isNotNull().alias("has_robots"),
        blocks_everything(F.coalesce("robots_txt", F.lit(""))).alias("robots_blocks_all"),
        F.col("sitemap_xml").isNotNull().alias("has_sitemap"),
        F.size(F.regexp_extract_all(F.coalesce("sitemap_xml", F.lit("")), F.lit("(?i)<loc>"), F.lit(0))).alias("sitemap_urls"),
    )


def robots_parts(pattern: Column) -> Column:
    """A rule pattern as what its stars part, and whether a final ``$`` ties the last part to the end of the path."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    parts = F.split(body, "\\*")
    return F.struct(
        parts[0].alias("first"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p != "").alias("later"),
        F.element_at(parts, -1).alias("last"), anchored.alias("anchored"),
    )


def robots_match(pattern: Column, path: Column) -> Column:
    """Whether a rule pattern covers a path."""
    return parts_match(robots_parts(pattern), path)


def parts_match(rule: Column, path: Column) -> Column:
    """Whether a pattern, as ``robots_parts`` has it, covers a path.

    The parts are looked for one after another, each from where the one before
    ended; the earliest place leaves most to the rest, so none is tried twice.
    """
    step = lambda at, part: F.when(at > 0, F.position(part, path, at)).otherwise(0)
    beyond = F.aggregate(rule["later"], F.length(rule["first"]) + 1, lambda at, part: F.when(step(at, part) > 0, step(at, part) + F.length(part)).otherwise(0))
    return path.startswith(rule["first"]) & (beyond > 0) & (~rule["anchored"] | path.endswith(rule["last"]))


def apply_robots(urls: DataFrame, rules: DataFrame, agent: str, key: str = "host") -> DataFrame:
    """Whether each URL may be fetched, and the wait the site asks for.

    The rules of a site are one short list, so urls meet a single row per site
    and never fan out. The longest matching pattern decides; none allows.
    """
    token = agent.strip().replace("/", " ").split()[0].lower()
    mine = rules.filter(F.col("agent").isin(token, "*"))
    chosen = mine.groupBy(key).agg(F.bool_or(F.col("agent") == token).alias("_own"))
    picked = mine.join(chosen, key).filter(F.col("agent") == F.when(F.col("_own"), F.lit(token)).otherwise(F.lit("*")))
    is_rule = F.col("kind").isin("allow", "disallow")
    rule = F.struct(
        (-F.length("pattern")).alias("order"), F.col("line_no").alias("no"), robots_parts(F.col("pattern")).alias("parts"), (F.col("kind") == "allow").alias("allow")
    )
    per_site = picked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(is_rule, rule))).alias("_rules"),
        F.max_by("crawl_delay", F.when(F.col("crawl_delay").isNotNull(), F.col("line_no"))).alias("crawl_delay"),
    )
    path = url_path(F.col("url"))
    hits = F.filter("_rules", lambda r: parts_match(r["parts"], F.col("_path")))
    return (
        urls.withColumn("_path", path)
        .join(per_site, key, "left")
        .withColumn("allowed", F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True)))
        .drop("_rules", "_path")
    )


def expand_sitemaps(documents: DataFrame, key: str = "site", text: str = "sitemap_xml", max_locations: int | None = None) -> DataFrame:
    """Locations of sitemap documents in order, entities decoded; all of them unless a limit is given."""
    found = F.regexp_extract_all(text, F.lit("(?i)<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))
    listed = found if max_locations is None else F.slice(found, 1, max_locations)
    rows = documents.select(key, F.posexplode_outer(listed).alias("pos", "loc")).filter(F.col("loc").isNotNull())
    out = F.col("loc")
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return rows.withColumn("loc", out)


def classify_shop_links(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Product and collection pages of the same origin, each once, in order.

    ``links``: the keys, ``pos``, ``absolute_url`` and the page's ``origin``.
    """
    clean = F.regexp_replace("absolute_url", "[?#].*$", "")
    path = url_path(clean)
    kind = F.when(path.rlike("/products/[^/]+$"), F.lit("product")).when(path.rlike("^/collections/[^/]+$"), F.lit("collection"))
    own = links.withColumn("clean_url", clean).withColumn("link_kind", kind).filter(
        F.col("link_kind").isNotNull() & (origin_of(F.col("absolute_url")) == F.lower("origin"))
    )
    return own.groupBy(*keys, "link_kind", "clean_url").agg(F.min("pos").alias("pos"))


def pick_key_pages(links: DataFrame, key: str = "store_id") -> DataFrame:
    """The collection and product page of each shop to audit.

    ``links``: key, origin, source (collections_all, navigation, sitemap), pos
    and absolute_url. A page listing all products that has any decides both;
    then navigation goes before the sitemap, and collections of everything are
    a last resort within their source.
    """
    classified = classify_shop_links(links, [key, "origin", "source"])
    all_page = (F.col("source") == "collections_all")
    listing = classified.filter(all_page & (F.col("link_kind") == "product"))
    from_all = first_per_key(listing, [key], [F.col("pos")])
    all_pick = from_all.select(
        key, F.concat("origin", F.lit("/collections/all")).alias("_all_collection"), F.col("clean_url").alias("_all_product")
    )
    rest = classified.filter(~all_page)
    order = [
        F.when(F.col("source") == "navigation", 0).otherwise(1),
        F.when((F.col("link_kind") == "collection") & F.col("clean_url").rlike(LAST_RESORT_COLLECTION), 1).otherwise(0),
        F.col("pos"),
    ]
    firsts = first_per_key(rest, [key, "link_kind"], order)

    def side(kind: str) -> DataFrame:
        return firsts.filter(F.col("link_kind") == kind).select(key, F.col("clean_url").alias(kind), F.col("source").alias(f"{kind}_source"))

    stores = links.select(key).distinct()
    joined = stores.join(all_pick, key, "left").join(side("collection"), key, "left").join(side("product"), key, "left")
    from_list = F.col("_all_product").isNotNull()
    pick = lambda kind: F.when(from_list, F.col(f"_all_{kind}")).otherwise(F.col(kind)).alias(kind)
    source = lambda kind: F.when(from_list, F.lit("collections_all")).otherwise(F.col(f"{kind}_source")).alias(f"{kind}_source")
    return joined.select(key, pick("collection"), source("collection"), pick("product"), source("product"))


def select_links(links: DataFrame, keys: Sequence[str] = ("page_id",), max_links: int = MAX_LINKS, max_external: int = MAX_EXTERNAL) -> tuple[DataFrame, DataFrame]:
    """The links of each page to probe, and how many were left out.

    Web links once each, fragments dropped; internal ones first, at most ten to
    other sites, at most thirty in all.
    """
    cols = list(keys)
    web = F.col("absolute_url").rlike("^(?i)https?://[^/?#]")
    clean = F.regexp_replace("absolute_url", "#.*$", "")
    counted = links.groupBy(*cols).agg(F.count(F.lit(1)).alias("_all"))
    distinct = (
        links.filter(web).withColumn("link_url", clean)
        .groupBy(*cols, "link_url").agg(F.min_by(F.struct("pos", "text", "internal"), "pos").alias("l"))
        .select(*cols, "link_url", "l.pos", "l.text", "l.internal")
    )
    inside = first_per_key(distinct.filter("internal"), cols, [F.col("pos")], max_links)
    outside = first_per_key(distinct.filter("NOT internal"), cols, [F.col("pos")], max_external)
    kept = first_per_key(inside.unionByName(outside), cols, [F.col("internal").desc(), F.col("pos")], max_links, rank="link_no")
    skipped = (
        counted.join(kept.groupBy(*cols).agg(F.count(F.lit(1)).alias("_kept")), cols, "left")
        .select(*cols, (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("skipped"))
    )
    return kept, skipped


def page_kind(path: Column, text: Column) -> Column:
    """Kind of a linked page by its path, else by a short link text."""
    bare = F.regexp_replace(path, "/+$", "")
    label = F.trim(text)
    short = F.length(label).between(1, 60)
    return F.coalesce(
        *[F.when(bare.rlike(KIND_PATHS[k]), F.lit(k)) for k in LINKED_KINDS],
        *[F.when(short & label.rlike(KIND_TEXTS[k]), F.lit(k)) for k in LINKED_KINDS],
    )


def pick_contact_pages(links: DataFrame, key: str = "store_id") -> DataFrame:
    """Footer links to contact, about, privacy and terms pages, first per kind.

    ``links``: key, origin, pos, text, absolute_url, in footer order.
    """
    path = F.regexp_replace(url_path(F.col("absolute_url")), "/+$", "")
    clean = F.concat(origin_of(F.col("absolute_url")), F.when(path == "", F.lit("/")).otherwise(path))
    kinds = links.withColumn("page_url", clean).withColumn("page_kind", page_kind(path, F.coalesce("text", F.lit(""))))
    own = kinds.filter(F.col("page_kind").isNotNull() & (origin_of(F.col("absolute_url")) == F.lower("origin")))
    # a page keeps the kind of its first link
    once = own.groupBy(key, "page_url").agg(F.min_by(F.struct("page_kind", "pos"), "pos").alias("l")).select(key, "page_url", "l.*")
    return first_per_key(once, [key, "page_kind"], [F.col("pos")]).select(key, "page_kind", "page_url").withColumn(
        "kind_order", rank_in(F.col("page_kind"), LINKED_KINDS)
    )


def brand_name(domain: Column, name: Column) -> Column:
    """The shop's name, or its domain label as words when the name only
    repeats the domain."""
    key = F.coalesce(domain_key_any(domain), domain)
    label = F.split_part(key, F.lit("."), F.lit(1))
    given = F.trim(F.coalesce(name, F.lit("")))
    folded = mail.collapse(given)
    repeats = (folded == mail.collapse(key)) | ((folded == mail.collapse(label)) & ~given.rlike("(?U)\\s"))
    parts = F.filter(F.split(label, "[-_]+"), lambda p: p != "")
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), " ")
    return F.when((given != "") & (folded != "") & ~repeats, given).otherwise(titled)


def plan_searches(stores: DataFrame, key: str = "store_id", per_query: int = 5) -> DataFrame:
    """Three searches per shop: profiles, company page, open web."""
    c = F.col
    terms = F.lit("(" + " OR ".join(ROLE_TERMS) + ")")
    for country, local in LOCAL_ROLE_TERMS.items():
        terms = F.when(F.upper("country") == country, F.lit("(" + " OR ".join([*ROLE_TERMS, *local]) + ")")).otherwise(terms)
    quoted = lambda v: F.concat(F.lit('"'), F.trim(F.regexp_replace(v, "[\"']", "")), F.lit('"'))
    domain = F.coalesce(domain_key_any(c("domain")), c("domain"))
    brand = c("_brand")

    def plan(no: int, kind: str, query: Column, site: str | None) -> Column:
        return F.struct(
            F.lit(no).alias("query_no"), F.lit(kind).alias("kind"), query.alias("query"), F.lit(site).cast("string").alias("allowed_domain"), F.lit(per_query).alias("max_results")
        )

    plans = F.array(
        plan(0, "linkedin_profile", F.concat(quoted(brand), F.lit(" "), terms, F.lit(" linkedin.com/in")), PROFILE_SITE),
        plan(1, "linkedin_company", F.concat(quoted(domain), F.lit(" "), terms), PROFILE_SITE),
        plan(2, "open_web", F.concat(quoted(brand), F.lit(" "), terms, F.lit(" ecommerce")), None),
    )
    return stores.withColumn("_brand", brand_name(c("domain"), c("name"))).select(key, F.explode_outer(plans).alias("q")).select(key, "q.*")


def number_queries(plans: DataFrame, key: str = "store_id") -> DataFrame:
    """Planned searches in one order over all shops, for a budget."""
    return number_rows(plans, [], [F.col(key), F.col("query_no")], id_slice(key), "plan_no")
