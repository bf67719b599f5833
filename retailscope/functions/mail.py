"""Address column builders: validity, kind of mailbox, ownership, brand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailscope.functions.text import fold
from retailscope.functions.urls import domain_key

# An address in running text.
_LOCAL = "[a-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL = f"(?i){_LOCAL}(?:\\.{_LOCAL})*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{{2,24}}"
# Address spelled out in words, and bracketed signs.
SPELLED_OUT = (
    "(?iu)([a-z0-9._%+-]{1,64})\\s+(?:at|malpa|małpa)\\s+([a-z0-9-]{1,63}(?:\\.[a-z0-9-]{1,63})*)"
    "\\s+(?:dot|kropka)\\s+([a-z]{2,24})"
)
BRACKETED_AT = "(?iu)\\s*[(\\[{<]\\s*(?:at|malpa|małpa)\\s*[)\\]}>]\\s*"
BRACKETED_DOT = "(?iu)\\s*[(\\[{<]\\s*(?:dot|kropka)\\s*[)\\]}>]\\s*"
# Endings that are file names, not domains.
FILE_EXTENSIONS = (
    "png jpg jpeg gif webp svg avif ico css js mjs json woff woff2 ttf eot mp4 webm pdf zip"
).split()
# Domains and mailboxes that stand for none.
NOISE_DOMAINS = (
    "example.com example.org example.net domain.com yourdomain.com mydomain.com email.tld sentry.io "
    "sentry.wixpress.com shopify.com shopifyapps.com"
).split()
NOISE_LOCALS = (
    "youremail your-email your.email yourname email e-mail name firstname lastname username user someone example test"
).split()
# Words of shared mailboxes, and mailboxes shared only as a whole.
GENERIC_TOKENS = (
    "info hello contact contacts office support help helpdesk sales shop store orders order service customer "
    "customercare care team admin administrator webmaster postmaster hostmaster abuse billing invoice finance "
    "accounting legal privacy press media marketing newsletter wholesale partners partnership careers jobs "
    "recruitment noreply donotreply mailer kontakt biuro sklep zamowienia zamowienie reklamacje reklamacja obsluga "
    "pomoc bok poczta sekretariat ksiegowosc faktury hurt wspolpraca praca kariera prasa rodo iod dpo serwis zespol "
    "firma allegro"
).split()
GENERIC_EXACT = "hi hey pr mail e we us b2b faq crm".split()
# Domain labels that name no brand.
GENERIC_LABELS = (
    "sklep sklepy sklepik zakupy moda buty odziez meble kosmetyki prezenty shop store shopping market online ecommerce "
    "outlet boutique butik fashion style home design brand group company"
).split()
# The longest address and the longest part before the @.
MAX_EMAIL, MAX_LOCAL = 254, 64


def local_part(email: Column) -> Column:
    return F.regexp_extract(email, "(?s)^(.*)@[^@]*$", 1)


def host_part(email: Column) -> Column:
    return F.regexp_extract(email, "@([^@]*)$", 1)


def valid_email(c: Column) -> Column:
    """Whether text is an address somebody may read."""
    email = F.lower(F.trim(c))
    local, host = local_part(email), host_part(email)
    return F.coalesce(
        (F.length(email) <= MAX_EMAIL)
        & F.length(local).between(1, MAX_LOCAL)
        & ~local.rlike("^\\.|\\.$|\\.\\.")
        & ~local.isin(*NOISE_LOCALS)
        & ~local.rlike("^[0-9a-f]{32,}$")
        & host.rlike("^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,24}$")
        & ~host.isin(*NOISE_DOMAINS)
        & ~F.regexp_extract(host, "([^.]*)$", 1).isin(*FILE_EXTENSIONS),
        F.lit(False),
    )


def is_generic_mailbox(email: Column) -> Column:
    """Whether a mailbox is shared: named like the brand or like a function."""
    local = F.lower(local_part(email))
    label = F.regexp_replace(F.split_part(host_part(email), F.lit("."), F.lit(1)), "[^a-z0-9]", "")
    branded = (F.length(label) > 2) & (F.regexp_replace(local, "[^a-z0-9]", "") == label)
    collapsed = F.regexp_replace(local, "[^a-z]", "")
    untagged = F.split_part(local, F.lit("+"), F.lit(1))
    segments = F.transform(F.split(untagged, "[._-]+"), lambda s: F.regexp_replace(s, "[^a-z]", ""))
    tokens = F.array(*map(F.lit, GENERIC_TOKENS))
    return (local != "") & (
        branded | collapsed.isin(*GENERIC_EXACT, *GENERIC_TOKENS) | F.arrays_overlap(segments, tokens)
    )


def is_own_domain(email: Column, store_domain: Column) -> Column:
    """Whether the mailbox is on the shop's domain or a subdomain of it."""
    host, own = F.lower(host_part(email)), domain_key(store_domain)
    return F.coalesce((local_part(email) != "") & ((host == own) | host.endswith(F.concat(F.lit("."), own))), F.lit(False))


def collapse(c: Column) -> Column:
    """Folded text reduced to letters a–z and digits."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def domain_label(store_domain: Column) -> Column:
    first = F.split_part(F.coalesce(domain_key(store_domain), F.lit("")), F.lit("."), F.lit(1))
    return F.regexp_replace(first, "[^a-z0-9]", "")


def _domain_text(store_domain: Column) -> Column:
    return collapse(F.coalesce(domain_key(store_domain), store_domain))


def distinctive(c: Column) -> Column:
    return (F.length(c) >= 4) & ~c.isin(*GENERIC_LABELS)


def brand_keys(store_domain: Column) -> Column:
    """The folded domain and its first label, as a struct to be kept in a column."""
    return F.struct(_domain_text(store_domain).alias("key"), domain_label(store_domain).alias("label"))


def slug_of_brand(text: Column, keys: Column) -> Column:
    """A collapsed slug and the shop's domain contain one another."""
    key, label = keys["key"], keys["label"]
    either = lambda name: text.contains(name) | name.contains(text)
    return (text != "") & (((F.length(key) >= 4) & either(key)) | (distinctive(label) & either(label)))


def names_brand(text: Column, keys: Column, brand: Column | None = None) -> Column:
    """Collapsed text names the domain, its distinctive label or the brand."""
    key, label = keys["key"], keys["label"]
    found = ((F.length(key) >= 4) & text.contains(key)) | (distinctive(label) & text.contains(label))
    if brand is not None:
        found = found | (distinctive(brand) & text.contains(brand))
    return (text != "") & found


def slug_matches_brand(slug: Column, store_domain: Column) -> Column:
    return slug_of_brand(collapse(slug), brand_keys(store_domain))


def text_mentions_brand(text: Column, store_domain: Column, brand: Column | None = None) -> Column:
    name = F.coalesce(collapse(brand), F.lit("")) if brand is not None else None
    return names_brand(collapse(text), brand_keys(store_domain), name)
