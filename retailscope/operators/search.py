"""Web search results: grounded hits, people and company pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.functions.people import ATTRIBUTION, detect_role, looks_like_person_name, name_key
from retailscope.functions.ranks import rank_in, role_rank
from retailscope.functions.urls import url_key
from retailscope.operators.extract import profile_parts
from retailscope.operators.keyed import first_per_key
from retailscope.operators.once import once

# How a result title ends, and what parts it.
SITE_SUFFIX = "(?iu)\\s*[|\\-–—·]\\s*linkedin\\s*$"
TITLE_PARTS = "\\s+[–—|·]\\s+|\\s+-\\s+"
MATCHES = ("title", "slug")
MAX_EVIDENCE = 240


def ground_search_hits(hits: DataFrame, sources: DataFrame, max_results: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hits whose page the search really reached, and how many were not.

    ``hits``: search_id, pos, url, title, snippet; ``sources``: search_id, url
    and the citation title, if any. One hit per page, the first ``max_results``;
    ``surplus_search_hits`` counts the others.
    """
    keyed, reached = _keyed_hits(hits, sources)
    kept = first_per_key(_grounded_once(keyed, reached), ["search_id"], [F.col("pos")], max_results)
    dropped = (
        keyed.join(reached.select("search_id", "_key"), ["search_id", "_key"], "left_anti")
        .groupBy("search_id").agg(F.count(F.lit(1)).alias("dropped"))
    )
    return kept.select("search_id", "pos", "url", F.coalesce("_title", "title").alias("title"), "snippet"), dropped


def surplus_search_hits(hits: DataFrame, sources: DataFrame, max_results: int = 5) -> DataFrame:
    """How many pages each search reached beyond those ``ground_search_hits`` keeps."""
    pages = _grounded_once(*_keyed_hits(hits, sources)).groupBy("search_id").agg(F.count(F.lit(1)).alias("pages"))
    return pages.filter(F.col("pages") > max_results).select("search_id", (F.col("pages") - max_results).alias("surplus"))


def _keyed_hits(hits: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits by the key of their page, and the pages each search reached."""
    reached = (
        sources.withColumn("_key", url_key(F.col("url"))).filter(F.col("_key").isNotNull())
        .groupBy("search_id", "_key").agg(F.max("title").alias("_title"))
    )
    return hits.withColumn("_key", url_key(F.col("url"))), reached


def _grounded_once(keyed: DataFrame, reached: DataFrame) -> DataFrame:
    return first_per_key(keyed.join(reached, ["search_id", "_key"]), ["search_id", "_key"], [F.col("pos")])


def title_segments(title: Column) -> Column:
    parts = F.split(F.regexp_replace(title, SITE_SUFFIX, ""), TITLE_PARTS)
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def _speaks_of_another(snippet: Column, matched: Column, name: Column) -> Column:
    """Whether a name stands right before the role that is not the person's."""
    at = F.position(matched, snippet)
    before = F.substring(snippet, F.greatest(at - 60, F.lit(1)), F.least(at - 1, F.lit(60)))
    first, second, comma = (F.regexp_extract(before, ATTRIBUTION, i) for i in (1, 2, 3))
    said = name_key(F.concat_ws(" ", first, F.when(second != "", second)))
    own = name_key(name)
    return (
        (at > 1)
        & (first != "")
        & ((second != "") | (comma != ""))
        & (said != "")
        & (said != own)
        & ~F.array_contains(F.split(own, " "), said)
    )


def read_search_people(hits: DataFrame) -> DataFrame:
    """People whose profile a search found and that belong to the shop.

    ``hits``: store_id, store_domain, brand, query_no, query, pos, url, title,
    snippet. The employer in the title must name the shop; without one the
    profile's slug must.
    """
    c = F.col
    target = profile_parts(c("url"))
    segments = title_segments(F.trim(F.coalesce("title", F.lit(""))))
    staged = once(once(hits, _t=target).filter(c("_t").isNotNull() & (c("_t.link_kind") == "profile") & F.coalesce(F.trim("title") != "", F.lit(False))), _segments=segments)
    staged = staged.withColumn("name", F.try_element_at("_segments", F.lit(1)))
    staged = staged.filter(c("name").isNotNull() & looks_like_person_name(c("name"), c("store_domain")))
    others = F.filter(F.slice("_segments", F.lit(2), F.size("_segments")), lambda s: name_key(s) != c("_own"))
    first, label, brand = c("_first"), c("_keys.label"), c("_brand")
    is_brand = (F.length(first) >= 4) & (((F.length(label) >= 4) & (first == label)) | ((F.length(brand) >= 4) & (first == brand)))
    tied = F.when(
        c("_employer") != "", F.when(mail.names_brand(c("_said_by"), c("_keys"), brand), F.lit("title"))
    ).when(mail.slug_of_brand(c("_slug"), c("_keys")), F.lit("slug"))
    keys = once(
        staged,
        _first=mail.collapse(F.element_at(F.split(F.trim("name"), "\\s+"), 1)),
        _keys=mail.brand_keys(c("store_domain")),
        _brand=F.coalesce(mail.collapse(c("brand")), F.lit("")),
    ).filter(~is_brand)
    own = once(keys, _own=name_key(c("name")), _slug=mail.collapse(c("_t.slug")))
    employed = once(own, _employer=F.array_join(others, " · "))
    judged = once(once(employed, _said_by=mail.collapse(c("_employer"))), match=tied).filter(c("match").isNotNull())
    judged = once(judged, _from_title=F.when(c("_employer") != "", detect_role(c("_employer"))), _from_snippet=detect_role(c("snippet")))
    other = F.coalesce(_speaks_of_another(c("snippet"), c("_from_snippet.matched"), c("name")), F.lit(False))
    judged = once(judged, _said=F.when(~other, c("_from_snippet"))).withColumn("_role", F.coalesce("_from_title", "_said"))
    text = F.concat_ws(" — ", F.when(F.trim("title") != "", c("title")), F.when(F.trim("snippet") != "", c("snippet")))
    cut = F.when(F.length(text) > MAX_EVIDENCE, F.concat(F.substring(text, 1, MAX_EVIDENCE - 1), F.lit("…"))).otherwise(text)
    source = F.when(c("_from_title").isNotNull(), F.lit("title")).when(c("_said").isNotNull(), F.lit("snippet"))
    return judged.select(
        "store_id", "query_no", "query", "pos", "name", c("_role.role").alias("role"), c("_role.matched").alias("role_text"),
        source.alias("role_source"), c("_t.link").alias("link"), c("_t.slug").alias("slug"), "match", cut.alias("evidence"),
    )


def best_search_person(people: DataFrame) -> DataFrame:
    """Per query and profile the strongest reading: role, match, name; then the
    query that comes first."""
    order = [role_rank(F.coalesce("role", F.lit(""))), rank_in(F.col("match"), MATCHES), F.col("name"), F.col("pos")]
    per_query = first_per_key(people, ["store_id", "slug", "query_no"], order)
    return first_per_key(per_query, ["store_id", "slug"], [F.col("query_no")])


def stop_after_first_titled(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of the queries up to the first that found a titled person.

    The query to stop at is one aggregate per shop; shops without one keep all.
    """
    stops = people.filter(F.col("role").isNotNull()).groupBy("store_id").agg(F.min("query_no").alias("_stop"))
    return rows.join(stops, "store_id", "left").filter(F.col("_stop").isNull() | (F.col("query_no") <= F.col("_stop"))).drop("_stop")


def find_company_pages(hits: DataFrame) -> DataFrame:
    """The first company page of each shop that its slug or title ties to it."""
    c = F.col
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), SITE_SUFFIX, ""))
    staged = hits.withColumn("_t", profile_parts(c("url"))).filter(c("_t").isNotNull() & (c("_t.link_kind") == "company"))
    tied = mail.slug_matches_brand(c("_t.slug"), c("store_domain")) | (
        (title != "") & mail.text_mentions_brand(title, c("store_domain"), c("brand"))
    )
    first = first_per_key(staged.filter(tied), ["store_id"], [c("query_no"), c("pos")])
    return first.select("store_id", c("_t.link").alias("link"), c("_t.slug").alias("slug"))
