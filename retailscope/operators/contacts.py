"""Contact evidence per shop: people, mailboxes, links, and who to write to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions import mail
from retailscope.functions.numbers import round_half_up
from retailscope.functions.people import detect_role, long_parts, looks_like_person_name, mailbox_key, name_key
from retailscope.functions.ranks import rank_in, role_rank
from retailscope.functions.text import squeeze
from retailscope.functions.urls import domain_key_any
from retailscope.operators.keyed import first_per_key, hash_bits, id_slice, list_parts, number_rows
from retailscope.session import cut_lineage

# Evidence from strongest to weakest, by source and by page.
EMAIL_SOURCES = ("mailto", "jsonld", "obfuscated", "text")
EMAIL_PAGES = ("contact", "about", "home", "privacy", "terms")
PERSON_SOURCES = ("jsonld", "role_text", "ai_about", "email_local")
PERSON_PAGES = ("about", "contact", "home", "privacy", "terms")
TELLING_PAGES = ("about", "contact")
# Parts of the confidence of a contact.
PERSON_BASE = {"jsonld": 0.45, "role_text": 0.35, "ai_about": 0.35, "email_local": 0.2}
EMAIL_BONUS = {"mailto": 0.08, "jsonld": 0.08, "obfuscated": 0.04, "text": 0.0}
GENERIC_BASE, SEARCH_BASE = 0.2, 0.3
OWN_DOMAIN, FOREIGN_DOMAIN = 0.15, -0.08
HAS_ROLE, NAME_IN_MAILBOX, HAS_PROFILE = 0.08, 0.08, 0.08
BRAND_MATCH, TELLING_PAGE = 0.04, 0.04
# Sharing of a mailbox between shops.
SHARED_FROM, SHARED_FACTOR = 3, 0.5


def strongest_email(found: DataFrame, seen: Sequence[str]) -> DataFrame:
    """The best evidence per shop and address: source, page, first seen."""
    order = [rank_in(F.col("source"), EMAIL_SOURCES), rank_in(F.col("page_kind"), EMAIL_PAGES), *[F.col(c) for c in seen]]
    return first_per_key(found, ["store_id", "email"], order)


def strongest_profile_link(found: DataFrame, seen: Sequence[str]) -> DataFrame:
    """The best page per shop and profile link."""
    order = [rank_in(F.col("page_kind"), EMAIL_PAGES), *[F.col(c) for c in seen]]
    return first_per_key(found, ["store_id", "link"], order)


def email_order() -> Column:
    """Mailboxes as they are preferred: personal, own, strong, telling."""
    return F.struct(
        F.when(F.col("bucket") == "personal", 0).otherwise(1).alias("b"),
        F.when(F.col("own_domain"), 0).otherwise(1).alias("o"),
        rank_in(F.col("source"), EMAIL_SOURCES).alias("s"),
        rank_in(F.col("page_kind"), EMAIL_PAGES).alias("p"),
        F.col("email").alias("e"),
    )


def match_people_to_mailboxes(people: DataFrame, emails: DataFrame) -> DataFrame:
    """Adds to people the best mailbox whose local part spells their name.

    Full name, initial and surname, or both as one word. Per shop and spelling
    one mailbox is left before the join, so it never fans out.
    """
    key = F.col("_key")
    parts = long_parts(key)
    initial = F.substring(parts[0], 1, 1)
    surname = F.try_element_at(parts, F.lit(-1))
    spellings = F.array_distinct(F.array(key, F.concat_ws(" ", initial, surname), F.concat(initial, surname)))
    names = people.select("store_id", name_key(F.col("name")).alias("_key")).distinct()
    spelled = names.filter(F.size(parts) >= 2).select("store_id", "_key", F.explode(spellings).alias("_box"))
    boxes = (
        emails.withColumn("_box", mailbox_key(F.col("email"))).groupBy("store_id", "_box")
        .agg(F.min_by("email", email_order()).alias("_email"), F.min(email_order()).alias("_order"))
    )
    matched = spelled.join(boxes, ["store_id", "_box"]).groupBy("store_id", "_key").agg(F.min_by("_email", "_order").alias("mailbox"))
    return people.withColumn("_key", name_key(F.col("name"))).join(matched, ["store_id", "_key"], "left").drop("_key")


def people_from_mailboxes(emails: DataFrame) -> DataFrame:
    """People only a personal mailbox of two name parts speaks for."""
    parts = long_parts(mailbox_key(F.col("email")))
    titled = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    no_text = F.lit(None).cast("string")
    named = emails.filter((F.col("bucket") == "personal") & (F.size(parts) == 2)).withColumn("name", F.array_join(titled, " "))
    return named.filter(looks_like_person_name(F.col("name"), F.col("store_domain"))).select(
        "store_id", "name", no_text.alias("role"), no_text.alias("role_text"), F.lit("email_local").alias("source"),
        "page_kind", "page_url", F.concat(F.lit("derived from "), F.col("email")).alias("evidence"),
    )


def strongest_person(found: DataFrame, seen: Sequence[str]) -> DataFrame:
    """One row per shop and folded name.

    Taking candidates in order, a titled one displaces an untitled one and a
    better source the same kind. That comes to: titled first, then the best
    source, then the first seen.
    """
    order = [F.col("role").isNull(), rank_in(F.col("source"), PERSON_SOURCES), *[F.col(c) for c in seen]]
    keyed = found.withColumn("name_key", name_key(F.col("name")))
    return first_per_key(keyed, ["store_id", "name_key"], order)


def is_confirmed_person() -> Column:
    """A second piece of evidence: structured data, a mailbox, or a clear role."""
    return (
        F.col("source").isin("jsonld", "ai_about", "email_local")
        | F.col("mailbox").isNotNull()
        | F.coalesce(F.col("role") != "Other", F.lit(False))
    )


def confirm_people(page_people: DataFrame, emails: DataFrame, seen: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """People of pages and mailboxes, strongest per name, with a mailbox if
    one spells the name; those without second evidence, and names that are
    none of a person, are dropped."""
    domain = F.col("store_domain") if "store_domain" in page_people.columns else None
    from_pages = page_people.filter(looks_like_person_name(F.col("name"), domain)).withColumn("_from", F.lit(0)).withColumn("_seen", F.struct(*[F.col(c).cast("bigint").alias(c) for c in seen]))
    derived = people_from_mailboxes(emails).withColumn("_from", F.lit(1)).withColumn(
        "_seen", F.struct(*[F.lit(0).cast("bigint").alias(c) for c in seen])
    )
    columns = ["store_id", "name", "role", "role_text", "source", "page_kind", "page_url", "evidence", "_from", "_seen"]
    both = from_pages.select(*columns).unionByName(derived.select(*columns))
    best = strongest_person(both, ["_from", "_seen", "name"])
    return match_people_to_mailboxes(best, emails).filter(is_confirmed_person()).drop("_from", "_seen")


def person_order() -> Column:
    return F.struct(
        role_rank(F.coalesce("role", F.lit(""))).alias("r"),
        rank_in(F.col("source"), PERSON_SOURCES).alias("s"),
        rank_in(F.col("page_kind"), PERSON_PAGES).alias("p"),
        F.col("name").alias("n"),
    )


def _lookup(c: Column, table: dict[str, float]) -> Column:
    out = F.when(c == next(iter(table)), F.lit(table[next(iter(table))]))
    for key, value in list(table.items())[1:]:
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(0.0))


def contact_confidence(df: DataFrame) -> Column:
    """How sure a contact is, 0 to 1 in two places.

    Read from the columns there are: person_source, person_role,
    person_mailbox, person_page; search_slug, search_role; email_source,
    own_domain, email_page; link_kind, link_slug; store_domain.
    """
    none = F.lit(None).cast("string")
    has = lambda name: F.col(name) if name in df.columns else none
    bonus = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))
    person, search, email, link = has("person_source"), has("search_slug"), has("email_source"), has("link_slug")
    is_person, is_search, is_email, is_link = person.isNotNull(), search.isNotNull(), email.isNotNull(), link.isNotNull()
    domain = F.col("store_domain")
    score = F.when(is_person, _lookup(person, PERSON_BASE)).when(is_search, F.lit(SEARCH_BASE)).otherwise(F.lit(GENERIC_BASE))
    score = score + bonus(is_search & has("search_role").isNotNull(), HAS_ROLE) + bonus(is_search, HAS_PROFILE)
    score = score + bonus(is_search & mail.slug_matches_brand(search, domain), BRAND_MATCH)
    score = score + F.when(is_email, _lookup(email, EMAIL_BONUS)).otherwise(F.lit(0.0))
    own = has("own_domain").cast("boolean")
    score = score + F.when(is_email, F.when(own, F.lit(OWN_DOMAIN)).otherwise(F.lit(FOREIGN_DOMAIN))).otherwise(F.lit(0.0))
    score = score + bonus(is_email & has("email_page").isin(*TELLING_PAGES), TELLING_PAGE)
    score = score + bonus(is_person & has("person_role").isNotNull(), HAS_ROLE)
    score = score + bonus(is_person & has("person_mailbox").isNotNull(), NAME_IN_MAILBOX)
    score = score + bonus(is_person & ~is_email & has("person_page").isin(*TELLING_PAGES), TELLING_PAGE)
    score = score + bonus(is_link & (has("link_kind") == "profile"), HAS_PROFILE)
    score = score + bonus(is_link & mail.slug_matches_brand(link, domain), BRAND_MATCH)
    return round_half_up(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


_CANDIDATE = (
    "store_id", "name", "role", "role_text", "email", "linkedin_url", "source", "source_url", "confidence", "is_generic", "evidence",
)


def _candidates(df: DataFrame, **columns: Column) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.withColumn("_confidence", contact_confidence(df)).select(
        *[
            F.col("store_id") if c == "store_id" else F.col("_confidence").alias(c) if c == "confidence" else columns.get(c, text).alias(c)
            for c in _CANDIDATE
        ]
    )


def _place(kind: Column) -> Column:
    return F.when(kind == "about", F.lit("about_page")).otherwise(F.lit("footer"))


def first_links(links: DataFrame, kind: str) -> DataFrame:
    """The best link of a kind per shop."""
    order = [rank_in(F.col("page_kind"), EMAIL_PAGES), F.col("link")]
    return first_per_key(links.filter(F.col("link_kind") == kind), ["store_id"], order)


def merge_search_people(people: DataFrame, found: DataFrame, order: str = "seen") -> tuple[DataFrame, DataFrame]:
    """People of pages with what a search adds, and the people it alone found.

    ``people`` carry ``linkedin_url``. The first person found with the same
    name fills a missing link and then a missing role; who has a link already
    gains nothing.
    """
    keyed = found.withColumn("name_key", name_key(F.col("name")))
    first = first_per_key(keyed, ["store_id", "name_key"], [F.col(order)]).select(
        "store_id", "name_key", F.col("role").alias("_role"), F.col("role_text").alias("_role_text"), F.col("link").alias("_link"), F.col("slug").alias("_slug")
    )
    base = people if "name_key" in people.columns else people.withColumn("name_key", name_key(F.col("name")))
    joined = base.join(first, ["store_id", "name_key"], "left").withColumn(
        "_fill", F.col("linkedin_url").isNull() & F.col("_link").isNotNull()
    )
    gains = F.col("_fill") & F.col("role").isNull() & F.col("_role").isNotNull()
    filled = (
        joined.withColumn("shown_role", F.when(gains, F.col("_role")).otherwise(F.col("role")))
        .withColumn("shown_role_text", F.when(gains, F.col("_role_text")).otherwise(F.col("role_text")))
        .withColumn("link_slug", F.when(F.col("_fill"), F.col("_slug")).otherwise(F.col("link_slug")))
        .withColumn("link_kind", F.when(F.col("_fill"), F.lit("profile")).otherwise(F.col("link_kind")))
        .withColumn("linkedin_url", F.when(F.col("_fill"), F.col("_link")).otherwise(F.col("linkedin_url")))
        .drop("_role", "_role_text", "_link", "_slug", "_fill")
    )
    alone = keyed.join(base.select("store_id", "name_key"), ["store_id", "name_key"], "left_anti")
    return filled, alone


def union_candidates(
    stores: DataFrame, people: DataFrame, search_people: DataFrame, emails: DataFrame, links: DataFrame, search_companies: DataFrame
) -> DataFrame:
    """All contact candidates of every shop.

    ``stores``: store_id, store_domain. People of pages, people found by search,
    unused personal mailboxes, shared mailboxes, and the company page where
    nothing else carries a profile link.
    """
    profile = first_links(links, "profile").select("store_id", F.col("link").alias("linkedin_url"), F.col("slug").alias("link_slug"), "link_kind")
    domains = stores.select("store_id", "store_domain")
    boxes = emails.filter(F.col("bucket") == "personal").select(
        "store_id", F.col("email").alias("mailbox"), F.col("source").alias("email_source"), "own_domain", F.col("page_kind").alias("email_page")
    )
    own = people.drop("store_domain").join(domains, "store_id").join(profile, "store_id", "left").join(boxes, ["store_id", "mailbox"], "left")
    merged, alone = merge_search_people(own, search_people)
    scored = (
        merged.withColumn("person_source", F.col("source")).withColumn("person_role", F.col("role"))
        .withColumn("person_mailbox", F.col("mailbox")).withColumn("person_page", F.col("page_kind"))
    )
    used = F.when(F.col("email_source").isNotNull(), F.col("mailbox"))
    named = _candidates(
        scored, name=F.col("name"), role=F.col("shown_role"), role_text=F.col("shown_role_text"), email=used,
        linkedin_url=F.col("linkedin_url"), source=_place(F.col("page_kind")), source_url=F.col("page_url"), is_generic=F.lit(False), evidence=F.col("evidence"),
    )
    found = alone.join(domains, "store_id").withColumn("search_slug", F.col("slug")).withColumn("search_role", F.col("role"))
    searched = _candidates(
        found, name=F.col("name"), role=F.col("role"), role_text=F.col("role_text"), linkedin_url=F.col("link"), source=F.lit("linkedin_serp"),
        source_url=F.col("link"), is_generic=F.lit(False), evidence=F.concat(F.lit("web search ("), F.col("query"), F.lit(") — "), F.col("evidence")),
    )
    loose = (
        emails.drop("store_domain").join(domains, "store_id").join(named.select("store_id", "email"), ["store_id", "email"], "left_anti")
        .withColumn("email_source", F.col("source")).withColumn("email_page", F.col("page_kind"))
    )
    generic = F.col("bucket") == "generic"
    mailboxes = _candidates(
        loose, email=F.col("email"), source=F.when(generic, F.lit("generic_email")).otherwise(_place(F.col("page_kind"))),
        source_url=F.col("page_url"), is_generic=generic, evidence=F.col("evidence"),
    )
    linked = named.filter(F.col("linkedin_url").isNotNull()).select("store_id").unionByName(searched.select("store_id"))
    ours = first_links(links, "company").select("store_id", F.col("link").alias("_own"), F.col("slug").alias("_own_slug"), "page_kind", "page_url")
    theirs = search_companies.select("store_id", F.col("link").alias("_found"), F.col("slug").alias("_found_slug"))
    company = (
        domains.join(linked, "store_id", "left_anti").join(ours, "store_id", "left").join(theirs, "store_id", "left")
        .withColumn("_link", F.coalesce("_own", "_found")).filter(F.col("_link").isNotNull())
        .withColumn("link_slug", F.coalesce("_own_slug", "_found_slug")).withColumn("link_kind", F.lit("company"))
    )
    from_page = F.col("_own").isNotNull()
    pages = _candidates(
        company, linkedin_url=F.col("_link"), source=F.when(from_page, F.lit("footer")).otherwise(F.lit("linkedin_serp")),
        source_url=F.when(from_page, F.col("page_url")).otherwise(F.col("_link")), is_generic=F.lit(False),
        evidence=F.when(from_page, F.concat(F.lit("LinkedIn company page linked from "), F.col("page_kind"))).otherwise(F.lit("LinkedIn company page found by web search")),
    )
    return reduce(lambda a, b: a.unionByName(b), [named, searched, mailboxes, pages])


def candidate_order() -> list[Column]:
    """Named people first, by role, certainty and address; all ascending, of the certainty what it lacks."""
    return [
        F.col("is_generic"),
        F.col("name").isNull(),
        role_rank(F.coalesce("role", F.lit(""))),
        F.coalesce(-F.col("confidence").cast("double"), F.lit(float("inf"))),
        F.coalesce("email", "linkedin_url", F.lit("")),
    ]


def rank_contacts(candidates: DataFrame) -> DataFrame:
    """All candidates of every shop with their rank; a shop of any size is numbered in even slices."""
    tie = [F.coalesce("name", F.lit("")), F.coalesce("source_url", F.lit(""))]
    return number_rows(candidates, ["store_id"], [*candidate_order(), *tie], name="contact_rank")


def collect_store_contacts(stores: DataFrame, emails: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """How much evidence of each kind a shop has, and whether it has none."""
    kinds = emails.select("store_id", F.concat(F.col("bucket"), F.lit("_emails")).alias("k"))
    everything = kinds.unionByName(links.select("store_id", F.lit("profile_links").alias("k"))).unionByName(
        people.select("store_id", F.lit("people").alias("k"))
    )
    names = ("personal_emails", "generic_emails", "profile_links", "people")
    counted = everything.groupBy("store_id").agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])
    filled = stores.select("store_id").join(counted, "store_id", "left").select("store_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return filled.withColumn("empty", sum((F.col(n) for n in names), F.lit(0)) == 0)


def evidence_lists(emails: DataFrame, links: DataFrame, people: DataFrame, per_part: int = 200) -> DataFrame:
    """The evidence itself per shop and kind, best first, in bounded parts."""
    mails = emails.select("store_id", F.concat(F.col("bucket"), F.lit("_emails")).alias("kind"), rank_in(F.col("source"), EMAIL_SOURCES).alias("grade"), F.col("email").alias("item"))
    profiles = links.select("store_id", F.lit("profile_links").alias("kind"), F.when(F.col("link_kind") == "profile", 0).otherwise(1).alias("grade"), F.col("link").alias("item"))
    names = people.select("store_id", F.lit("people").alias("kind"), role_rank(F.coalesce("role", F.lit(""))).alias("grade"), F.col("name").alias("item"))
    rows = mails.unionByName(profiles).unionByName(names)
    return list_parts(rows, ["store_id", "kind"], [F.col("grade"), F.col("item")], None, F.col("item"), per_part)


def page_edges(texts: DataFrame, reach: int) -> DataFrame:
    """Where a shop's pages meet: ``store_id``, ``_ends`` and ``_begins``, up to ``reach`` characters of each side.

    ``texts``: store_id, page_no, _text (squeezed). Empty pages are passed over. Where a page is shorter than ``reach``, what
    is before it goes before it as well; each round reads twice as many pages back, so there are few.
    """
    # kept, so that the texts are read once and not for every use of their ends
    held = cut_lineage(texts.filter(F.col("_text") != "").select("store_id", "page_no", F.right("_text", F.lit(reach)).alias("_ends"), F.left("_text", F.lit(reach)).alias("_begins")))
    pages = cut_lineage(number_rows(held, ["store_id"], [F.col("page_no")], id_slice("page_no", 4096), "_no"))
    back = 1
    while pages.filter((F.length("_ends") < reach) & (F.col("_no") > back)).head(1):
        earlier = pages.select("store_id", (F.col("_no") + back).alias("_no"), F.col("_ends").alias("_earlier"))
        joined = F.right(F.concat_ws(" ", "_earlier", "_ends"), F.lit(reach))
        pages = cut_lineage(pages.join(earlier, ["store_id", "_no"], "left").select("store_id", "page_no", joined.alias("_ends"), "_begins", "_no"))
        back *= 2
    before = pages.select("store_id", (F.col("_no") + 1).alias("_no"), "_ends")
    return pages.select("store_id", "_no", "_begins").join(before, ["store_id", "_no"]).select("store_id", "_ends", "_begins")


def texts_with_quotes(quotes: DataFrame, texts: DataFrame, shown: Sequence[str]) -> DataFrame:
    """Texts of a shop that hold a quote: ``store_id``, ``_quote`` and the ``shown`` columns of the text.

    ``quotes``: store_id, _quote (squeezed); ``texts``: store_id, _text (squeezed) and ``shown``. A quote is looked up from its
    second word on, as long as it is, and by the letter before. A word of a text leaves its row only if it and what follows
    read like a quote of the shop: by the word (by its beginning, where a quote ends in it), by the first 64 letters, and as
    long as the quote is. These are looked up in an array of bits, so no text and no other place is shuffled, however common
    the words of a quote are.
    """
    c = F.col
    words = F.split("_quote", " ")
    distinct = quotes.select("store_id", "_quote").distinct().filter(c("_quote").contains(" "))
    cut = distinct.select("store_id", "_quote", F.get(words, F.lit(0)).alias("_first"), F.get(words, F.lit(1)).alias("_second"), (F.size(words) > 2).alias("_goes_on"))
    cut = cut.withColumn("_rest", F.expr("substring(_quote, length(_first) + 2)")).withColumn("_length", F.length("_rest")).withColumn("_before", F.right("_first", F.lit(1)))
    # beginnings looked at have a power of two of letters, so there are few kinds of them
    cut = cut.withColumn("_far", F.least(F.lit(64), F.expr("int(pow(2, length(bin(_length)) - 1))")))
    # how much of the word is looked at: a quote that goes on has it whole
    cut = cut_lineage(cut.withColumn("_near", F.when(c("_goes_on"), F.lit(0)).otherwise(F.least("_far", F.lit(8)))))
    n, lengths, far, near = cut.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(x)) for x in ("_length", "_far", "_near")]).head()
    among = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
    shop = F.xxhash64("store_id") if dict(quotes.dtypes)["store_id"] == dict(texts.dtypes)["store_id"] else F.lit(0).cast("bigint")
    word_key = lambda word, letters: F.xxhash64("_shop", F.lit(letters), F.left(word, F.lit(letters)) if letters else word)
    key = lambda part: F.xxhash64("_shop", "_before", part)
    begun = F.coalesce(*[F.when(c("_near") == x, word_key(c("_second"), x)) for x in near or [0]])
    keys = cut.withColumn("_shop", shop).select(F.explode_outer(F.array(begun, key(F.left("_rest", c("_far"))), key(c("_rest")))).alias("_key"))
    known = hash_bits(keys, 3 * n)

    spoken = texts.select("store_id", *shown, shop.alias("_shop"), F.split("_text", " ").alias("_w")).select("*", F.posexplode_outer("_w").alias("_i", "_word"))
    # keys are exploded, for else the optimizer writes one out wherever the filter reads it
    begins = F.array(*[F.when(F.length("_word") >= x, word_key(c("_word"), x)) for x in near or [0]])
    places = spoken.select("*", F.posexplode_outer(begins).alias("_kind", "_key")).filter((c("_i") > 0) & known(c("_key")))
    # never null, or the optimizer asks of every word, before its key, whether they are
    held = lambda part: F.coalesce(part, F.lit(""))
    prev = held(F.get("_w", c("_i") - 1))
    ahead = lambda letters: held(F.left(F.array_join(F.slice("_w", c("_i") + 1, F.lit(letters // 2 + 1)), " "), F.lit(letters)))
    places = places.withColumn("_near", F.get(among(near or [0]), c("_kind"))).withColumn("_before", F.right(prev, F.lit(1)))
    places = places.withColumn("_ahead", ahead(64)).withColumn("_far", F.explode_outer(among(far or [1])))
    places = places.filter((F.length("_ahead") >= c("_far")) & ((c("_near") == 0) | (c("_near") == F.least("_far", F.lit(8)))) & known(key(F.left("_ahead", c("_far")))))
    places = places.withColumn("_ahead", ahead(max(lengths, default=1))).withColumn("_length", F.explode_outer(among(lengths or [1])))
    fits = (c("_length") >= c("_far")) & ((c("_far") == 64) | (c("_length") < 2 * c("_far"))) & (F.length("_ahead") >= c("_length"))
    places = places.filter(fits & known(key(F.left("_ahead", c("_length")))))
    placed = places.select("store_id", held(F.left("_ahead", c("_length"))).alias("_rest"), "_before", "_near", prev.alias("_prev"), *shown)
    found = placed.join(cut.select("store_id", "_quote", "_first", "_rest", "_before", "_near"), ["store_id", "_rest", "_before", "_near"])
    return found.filter(c("_prev").endswith(c("_first"))).select("store_id", "_quote", *shown)


def quotes_over_edges(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes (``store_id``, ``_quote``) that run over the edge of a page."""
    reach = asked.agg(F.max(F.length("_quote"))).head()[0] or 0
    edges = page_edges(texts, reach).withColumn("_text", F.concat("_ends", F.lit(" "), "_begins"))
    found = texts_with_quotes(asked, edges, ["_ends", "_begins"])
    across = ~F.col("_ends").contains(F.col("_quote")) & ~F.col("_begins").contains(F.col("_quote"))
    return found.filter(across).select("store_id", "_quote").distinct()


def ground_quotes(people: DataFrame, pages: DataFrame) -> DataFrame:
    """People an about-page reader named, judged by the page text.

    ``people``: store_id, person_no, name, role, quote; ``pages``: store_id,
    page_no, kind, url, text, store_domain per person row. A quote is grounded
    when the shop's pages, read one after another, hold it and it holds the
    name. Quotes are looked up by ``texts_with_quotes``, so people never meet
    all pages of their shop; quotes over the edge of a page are looked up in
    ``page_edges``. Such a quote is shown with the shop's first page.
    """
    plain = lambda c: F.lower(squeeze(F.coalesce(c, F.lit(""))))
    name, quote = plain(F.col("name")), plain(F.col("quote"))
    judged = (
        people.withColumn("_name", name).withColumn("_quote", quote)
        .withColumn("_shape", looks_like_person_name(F.trim("name"), F.col("store_domain")))
        .withColumn("_says", (F.col("_quote") != "") & F.col("_quote").contains(F.col("_name")))
    )
    texts = pages.withColumn("_text", plain(F.col("text")))
    asked = cut_lineage(judged.filter(F.col("_shape") & F.col("_says")).select("store_id", "person_no", "_quote"))
    shown = F.struct(F.col("kind").alias("page_kind"), F.col("url").alias("page_url"))
    held = texts.filter(F.col("page_no").isNotNull()).select("store_id", "_text", F.struct("page_no", shown.alias("page")).alias("_at"))
    inside = texts_with_quotes(asked, held, ["_at"]).groupBy("store_id", "_quote").agg(F.min("_at").alias("_inside"))
    over = quotes_over_edges(asked, texts).withColumn("_over", F.lit(True))
    start = texts.groupBy("store_id").agg(F.min_by(shown, "page_no").alias("_start"))
    found = inside.join(over, ["store_id", "_quote"], "full").join(start, "store_id")
    # a row per person_no; of its quotes the one on the earliest page counts
    first = (
        asked.join(found, ["store_id", "_quote"]).groupBy("store_id", "person_no")
        .agg(F.coalesce(F.min("_inside")["page"], F.first("_start")).alias("_page"))
    )
    stated = F.trim(F.coalesce("role", F.lit("")))
    verdict = (
        F.when(~F.col("_shape"), F.lit("rejected"))
        .when(~F.col("_says") | F.col("_page").isNull(), F.lit("ungrounded"))
        .otherwise(F.lit("grounded"))
    )
    out = judged.join(first, ["store_id", "person_no"], "left").withColumn("verdict", verdict)
    kept = out.filter(F.col("verdict") == "grounded").groupBy("store_id", "_name").agg(F.min("person_no").alias("_kept_no"))
    return (
        out.join(kept, ["store_id", "_name"], "left")
        .withColumn("verdict", F.when((F.col("verdict") == "grounded") & (F.col("person_no") != F.col("_kept_no")), F.lit("repeated")).otherwise(F.col("verdict")))
        .select(
            "store_id", "person_no", F.trim("name").alias("name"), "verdict",
            F.when(stated != "", detect_role(stated)["role"]).alias("role"), F.when(stated != "", stated).alias("role_text"),
            F.lit("ai_about").alias("source"), "_page.page_kind", "_page.page_url", F.trim("quote").alias("evidence"),
        )
    )


# ------------------------------------------------------------------ saving


# Parts a join key is dealt over where one value may be very frequent.
SALTS = 16


def _mail_domain(email: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(email)), "^[^@]*@", "")


def drop_suppressed(candidates: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts nobody asked to forget, and those that were dropped."""
    flagged = flag_suppressed(candidates, suppressions)
    return flagged.filter(~F.col("_suppressed")).drop("_suppressed"), flagged.filter("_suppressed").drop("_suppressed")


def flag_suppressed(candidates: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Contacts with ``_suppressed``: whether somebody asked to forget them.

    ``candidates`` carry ``store_domain``. Address, mail domain and shop domain
    are three joins on equality, never one on an OR. Candidates are dealt over
    ``SALTS`` parts of each key, so missing keys and popular mail domains are
    split; the suppressions, far fewer, are repeated for every part.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    addresses = suppressions.filter(F.col("email").isNotNull()).select(F.col("email").alias("_email")).distinct().select("_email", F.lit(True).alias("_by_email"), parts.alias("_salt"))
    domains = suppressions.filter(F.col("domain").isNotNull()).select(F.col("domain").alias("_domain")).distinct().select("_domain", parts.alias("_salt"))
    keyed = candidates.withColumn("_email", F.lower(F.trim("email"))).withColumn("_mail_domain", _mail_domain(F.col("email")))
    shop_key = F.coalesce(domain_key_any(F.col("store_domain")), F.lower(F.trim("store_domain")))
    marked = (
        keyed.withColumn("_store_domain", shop_key).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        .join(addresses, ["_email", "_salt"], "left")
        .join(domains.select(F.col("_domain").alias("_mail_domain"), "_salt", F.lit(True).alias("_by_mail")), ["_mail_domain", "_salt"], "left")
        .join(domains.select(F.col("_domain").alias("_store_domain"), "_salt", F.lit(True).alias("_by_store")), ["_store_domain", "_salt"], "left")
    )
    hit = F.coalesce("_by_email", "_by_mail", "_by_store", F.lit(False))
    return marked.select(*candidates.columns, hit.alias("_suppressed"))


def _contact_key() -> Column:
    """Address, else lower-cased name; null for rows with only a link."""
    return F.coalesce(F.concat(F.lit("@"), F.col("email")), F.concat(F.lit("n"), F.lower("name")))


def dedupe_candidates(candidates: DataFrame, order: str = "contact_rank") -> DataFrame:
    """First candidate per shop and address, or per name without one.

    Rows with only a link are all kept, empty rows are dropped. The first row
    per key is a partial aggregate; duplicates are counted by the caller from
    the difference.
    """
    some = candidates.filter(F.coalesce("email", "name", "linkedin_url").isNotNull()).withColumn("_key", _contact_key())
    links = some.filter(F.col("_key").isNull())
    keyed = first_per_key(some.filter(F.col("_key").isNotNull()), ["store_id", "_key"], [F.col(order)])
    return keyed.unionByName(links).drop("_key")


def flag_shared_mailboxes(candidates: DataFrame, held: DataFrame, others: int = SHARED_FROM) -> DataFrame:
    """Halves the confidence of addresses that many other shops list too.

    ``held`` are the contacts on record. Shops are counted per address first; a
    shop that itself lists the address is taken off its own count. Candidates
    without an address are many and take no part in the joins.
    """
    pairs = held.filter(F.col("email").isNotNull()).select("email", "store_id").distinct()
    counted = pairs.groupBy("email").agg(F.count(F.lit(1)).alias("_stores"))
    mine = pairs.withColumn("_mine", F.lit(1))
    addressed = candidates.filter(F.col("email").isNotNull()).join(counted, "email", "left").join(mine, ["email", "store_id"], "left")
    joined = addressed.unionByName(candidates.filter(F.col("email").isNull()), allowMissingColumns=True)
    elsewhere = F.coalesce(F.col("_stores") - F.coalesce("_mine", F.lit(0)), F.lit(0))
    return (
        joined.withColumn("stores_elsewhere", elsewhere)
        .withColumn("is_shared", F.col("stores_elsewhere") >= others)
        .withColumn(
            "confidence",
            F.when(F.col("is_shared"), round_half_up(F.col("confidence") * SHARED_FACTOR, 2)).otherwise(F.col("confidence")),
        )
        .drop("_stores", "_mine")
    )


def mark_primary(candidates: DataFrame, order: str = "contact_rank") -> DataFrame:
    """One primary contact per shop: the first that is no shared inbox, else
    the most certain one. Both are aggregates joined back."""
    picks = candidates.groupBy("store_id").agg(
        F.min(F.when(~F.col("is_generic"), F.col(order))).alias("_person"),
        F.min_by(order, F.struct(-F.col("confidence"), F.col(order))).alias("_surest"),
    )
    joined = candidates.join(picks, "store_id")
    return joined.withColumn("is_primary", F.col(order) == F.coalesce("_person", "_surest")).drop("_person", "_surest")


def save_contacts(contacts: DataFrame, candidates: DataFrame, suppressions: DataFrame, stores: DataFrame, order: str = "contact_rank") -> tuple[DataFrame, DataFrame]:
    """The contacts table after replacing those of every shop in the batch,
    and per shop what was written, repeated, shared and suppressed.

    ``candidates``: store_id, the order column and the candidate columns;
    ``stores``: store_id, store_domain. The shared count looks at contacts of
    other shops on record and in this batch. Candidates are flagged once; what
    is kept and all counts are read from the flagged ones.
    """
    domains = stores.select("store_id", "store_domain")
    flagged = cut_lineage(flag_suppressed(candidates.join(domains, "store_id"), suppressions))
    unique = dedupe_candidates(flagged.filter(~F.col("_suppressed")).drop("_suppressed"), order)
    batch = candidates.select("store_id").distinct()
    others = contacts.join(batch, "store_id", "left_anti").select("store_id", "email").unionByName(unique.select("store_id", "email"))
    final = mark_primary(flag_shared_mailboxes(unique, others), order)
    columns = [c for c in contacts.columns if c in final.columns]
    written = contacts.join(batch, "store_id", "left_anti").unionByName(final.select(*columns), allowMissingColumns=True)

    def tally(df: DataFrame, **flags: Column) -> DataFrame:
        names = ("written", "shared", "some", "suppressed")
        return df.select("store_id", *[flags.get(n, F.lit(False)).cast("int").alias(n) for n in names])

    filled = F.coalesce("email", "name", "linkedin_url").isNotNull()
    rows = (
        tally(candidates)
        .unionByName(tally(flagged, some=filled & ~F.col("_suppressed"), suppressed=F.col("_suppressed")))
        .unionByName(tally(final, written=F.lit(True), shared=F.col("is_shared")))
    )
    sums = rows.groupBy("store_id").agg(*[F.sum(n).alias(n) for n in ("written", "shared", "some", "suppressed")])
    counts = sums.select("store_id", "written", (F.col("some") - F.col("written")).alias("duplicates"), "shared", "suppressed")
    return written, counts


# ------------------------------------------------------------------ erasure


def forget(contacts: DataFrame, suppressions: DataFrame, requests: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts without those asked to be forgotten, and the suppressions that
    keep them out. Both halves belong together; neither is offered alone.

    ``requests``: email or domain, reason. Repeating a request changes nothing.
    """
    asked = requests.select(
        F.lower(F.trim("email")).alias("email"),
        F.coalesce(domain_key_any(F.col("domain")), F.lower(F.trim("domain"))).alias("domain"),
        "reason",
    )
    domains = stores.select("store_id", "store_domain")
    kept, _ = drop_suppressed(contacts.join(domains, "store_id", "left"), asked)
    fresh = asked.groupBy("email", "domain").agg(F.min("reason").alias("reason"))
    known = suppressions.select("email", "domain")
    same = F.col("n.email").eqNullSafe(F.col("k.email")) & F.col("n.domain").eqNullSafe(F.col("k.domain"))
    added = fresh.alias("n").join(known.alias("k"), same, "left_anti")
    return kept.select(*contacts.columns), suppressions.unionByName(added, allowMissingColumns=True)


def purge_expired(contacts: DataFrame, now, days: int = 180) -> DataFrame:
    """Contacts within the retention period."""
    instant = now if isinstance(now, Column) else F.lit(now)
    return contacts.filter(F.col("created_at") >= instant - F.expr(f"INTERVAL {int(days)} DAYS"))


def unsuppress(suppressions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Suppressions without the ones named by address or domain."""
    asked = identifiers.select(F.lower(F.trim("identifier")).alias("_id")).distinct()
    return (
        suppressions.join(asked.withColumnRenamed("_id", "email"), "email", "left_anti")
        .join(asked.withColumnRenamed("_id", "domain"), "domain", "left_anti")
        .select(*suppressions.columns)
    )

