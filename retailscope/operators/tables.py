"""Table functions: links and JSON-LD nodes of a page, for use in SQL.

    register(spark)
    SELECT p.page_id, l.* FROM pages p, LATERAL page_links(p.html, p.url) l

They give what ``extract_links`` and ``extract_json_ld`` give, row for row; the
DataFrame forms stay in the JVM and are the ones to use for a whole corpus.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from retailscope.functions import html as h
from retailscope.operators.extract import MAX_TEXT, footer_start, typed_nodes

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.ASCII)


HIDDEN = [_pattern("(?s)<!--.*?-->")] + [_pattern(f"(?is)<{n}\\b[^>]*>.*?</{n}\\s*>") for n in ("script", "style", "template", "noscript")]
ANCHOR = _pattern("(?is)<a\\s[^>]*?\\bhref\\s*=[^>]*>.*?</a\\s*>")
HREF = _pattern(f"(?is)^<[^>]*?\\shref\\s*=\\s*{h._VALUE}")
BARE_HREF = _pattern("(?is)^<[^>]*?\\shref(?=[\\s/>])")
FOOTER, FOOTER_END = _pattern(footer_start()), _pattern("(?is)</footer\\s*>")
TAG, RARE = _pattern("(?s)</?[a-zA-Z][^>]*>|<![^>]*>"), _pattern(h.RARE_ENTITY)
FIRST_TAG, LAST_TAG = _pattern("(?s)^<[^>]*>"), _pattern("(?s)<[^<]*>$")
ORIGIN, SCHEME = _pattern("(?i)^https?://[^/?#]+"), _pattern("^[a-zA-Z][a-zA-Z0-9+.-]*:")
DOTTED = _pattern("(?:^|/)\\.{1,2}(?:/|$|[?#])")
LD_BLOCK = _pattern("(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>")


def decoded(text: str) -> str:
    """Character references decoded, as ``html.entities`` does."""
    if RARE.search(text):
        return _html.unescape(text)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        text = text.replace(f"&{name};", char)
    return text


def _href(anchor: str) -> str | None:
    found = HREF.search(anchor)
    if found:
        return decoded("".join(g or "" for g in found.groups()))
    return "" if BARE_HREF.search(anchor) else None


def _absolute(base: str, href: str) -> str:
    """A link on its page's address, as ``absolute_url`` gives it."""
    link = href.strip(" ")
    if DOTTED.search(link):
        return urljoin(base, link)
    at = ORIGIN.search(base)
    origin = at.group() if at else ""
    page = re.sub("[?#].*$", "", base)
    if SCHEME.search(link):
        return link
    if link.startswith("//"):
        scheme = re.search("^([a-zA-Z]+):", base)
        return (scheme.group(1) if scheme else "") + ":" + link
    if link.startswith("/"):
        return origin + link
    if link == "":
        return page
    if link.startswith("#"):
        return re.sub("#.*$", "", base) + link
    if link.startswith("?"):
        return page + link
    return (origin + "/" if page == origin else re.sub("[^/]*$", "", page, count=1)) + link


def _own_origin(url: str) -> str:
    found = ORIGIN.search(url)
    return found.group().lower() if found else ""


@udtf(returnType="pos int, href string, text string, absolute_url string, internal boolean, in_footer boolean")
class PageLinks:
    """Links of a page in document order; a null page has none."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        if html is None:
            return
        for i, hidden in enumerate(HIDDEN):
            html = hidden.sub(" " if i else "", html)
        start = FOOTER.search(html)
        parts = [(html, False)]
        if start:
            after = html[start.end() :]
            end = FOOTER_END.search(after)
            parts = [(html[: start.start()], False), (after[: end.start()] if end else after, True), (after[end.end() :] if end else "", False)]
        pos = 0
        for part, in_footer in parts:
            for anchor in ANCHOR.findall(part):
                href = _href(anchor)
                inside = LAST_TAG.sub("", FIRST_TAG.sub("", anchor))
                text = decoded(TAG.sub("", inside)).strip(" ")[:MAX_TEXT]
                absolute = None if href is None or url is None else _absolute(url, href)
                internal = None if absolute is None else _own_origin(absolute) not in ("",) and _own_origin(absolute) == _own_origin(url)
                yield pos, href, text, absolute, internal, in_footer
                pos += 1


@udtf(returnType="pos int, type string, node string")
class PageJsonLd:
    """Typed JSON-LD nodes of a page as JSON text; broken blocks are skipped."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is None:
            return
        for pos, (kind, node) in enumerate(typed_nodes(LD_BLOCK.findall(html))):
            yield pos, kind, node


def register(spark: SparkSession) -> None:
    """Makes ``page_links(html, url)`` and ``page_json_ld(html)`` known to SQL."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_json_ld", PageJsonLd)
