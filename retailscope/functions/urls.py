"""URL and domain column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hosts that never identify a shop.
PLACEHOLDER_HOSTS = ("localhost", "example.com", "example.org", "example.net")
# Hosts whose country subdomains name the same site.
LOCALE_SUBDOMAIN_HOSTS = ("linkedin.com",)


@F.pandas_udf(T.StringType())
def punycode(hosts: pd.Series) -> pd.Series:
    """Hosts with non-ASCII letters in their ASCII form, null when invalid.

    By the standard library's codec (IDNA 2003), so keys are alike on every machine.
    """

    def ascii_form(host: str | None) -> str | None:
        if host is None or host.isascii():
            return host
        try:
            return host.encode("idna").decode("ascii")
        except (UnicodeError, ValueError):
            return None

    return hosts.map(ascii_form, na_action="ignore")


# The host of an http(s) URL or of text without a scheme; no credentials.
_HOST = "^(?i)(?:https?://|(?![a-z][a-z0-9+.-]*:))/*([^/?#\\\\@:]+)(?::[0-9]*)?(?:[/?#\\\\]|$)"
_LABEL = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"


def _host_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(c), _HOST, 1))


def _clean_host(host: Column, placeholders: tuple[str, ...]) -> Column:
    names = "|".join(p.replace(".", "\\.") for p in placeholders) or "-"
    bare = F.regexp_replace(host, "^www\\.|\\.$", "")
    valid = f"^(?!\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}$)(?!(?:{names})$){_LABEL}(?:\\.{_LABEL})+$"
    # bound in a lambda, so that the host is taken once
    return F.get(F.transform(F.array(bare), lambda b: F.when(b.rlike(valid), b)), F.lit(0))


def domain_key(c: Column, placeholders: tuple[str, ...] = PLACEHOLDER_HOSTS) -> Column:
    """The normalised registrable key of an ASCII domain or URL, else null."""
    return _clean_host(_host_of(c), placeholders)


def domain_key_any(c: Column, placeholders: tuple[str, ...] = PLACEHOLDER_HOSTS) -> Column:
    """``domain_key`` for international names too, by one vectorised step."""
    host = _host_of(c)
    plain = host.rlike("^[\\x00-\\x7f]*$")
    # ASCII hosts stay in the JVM: the Python step only receives the others
    return _clean_host(F.when(plain, host).otherwise(punycode(F.when(~plain, host))), placeholders)


def canonical_host(c: Column) -> Column:
    """A host without ``www.``; country subdomains of listed sites folded."""
    bare = F.regexp_replace(F.lower(c), "^www\\.", "")
    out = bare
    for host in LOCALE_SUBDOMAIN_HOSTS:
        out = F.when((bare == host) | bare.endswith("." + host), F.lit(host)).otherwise(out)
    return out


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_path(c: Column) -> Column:
    path = F.regexp_extract(c, "^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_key(c: Column) -> Column:
    """Host and lower-cased path without trailing slash; null if not http(s)."""
    text = F.trim(c)
    path = F.regexp_replace(url_path(text), "/+$", "")
    return F.when(
        text.rlike("^(?i)https?://[^/?#]+"), F.concat(canonical_host(url_host(text)), F.lower(path))
    )


def mail_domain(c: Column) -> Column:
    """The part after the first ``@`` of an address, lower-cased."""
    text = F.lower(F.trim(c))
    return F.regexp_replace(text, "^[^@]*@", "")
