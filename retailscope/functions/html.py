"""Static markup read with JVM regular expressions.

Markup is read as written: nothing is rendered, so visibility and layout are
not known here.
"""

from __future__ import annotations

import html as _html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VALUE = "(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
#: The same as written, with its quotes.
_WRITTEN = "(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
#: White space of any script but the blank, as ``(?U)\\s`` has it.
_WHITE = "\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Elements that are followed or preceded by a line break on screen.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|button|caption|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h[1-6]|head|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|select|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul"
)


def literal(text: str) -> str:
    """A regular expression for exactly this text."""
    return "".join("\\" + ch if ch in "\\.[]{}()*+?^$|" else ch for ch in text)


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


def markup(html: Column) -> Column:
    """The document without comments, scripts and styles."""
    out = without_comments(html)
    for name in ("script", "style", "template", "noscript"):
        out = F.regexp_replace(out, f"(?is)<{name}\\b[^>]*>.*?</{name}\\s*>", " ")
    return out


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(_html.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [None if t is None else _html.unescape(t) for t in texts], na_action="ignore")


RARE_ENTITY = "&(?!(?:amp|lt|gt|quot|apos|nbsp|#39);)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def common_entities(c: Column) -> Column:
    """The character references every writer uses, decoded in the JVM."""
    out = c
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\u00a0")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def entities(c: Column) -> Column:
    """Character references decoded; rare ones by one vectorised step."""
    rare = c.rlike(RARE_ENTITY)
    return F.when(rare, _unescape(F.when(rare, c))).otherwise(common_entities(c))


def entities_list(texts: Column) -> Column:
    """The same for every text of a list."""
    rare = F.exists(texts, lambda t: t.rlike(RARE_ENTITY))
    return F.when(rare, _unescape_list(F.when(rare, texts))).otherwise(F.transform(texts, common_entities))


def bare_text(fragment: Column) -> Column:
    """Text of a fragment before references are decoded and white space is collapsed."""
    spaced = F.regexp_replace(fragment, f"(?i)</?(?:{BLOCK_TAGS})\\b[^>]*>", " ")
    return F.regexp_replace(spaced, "(?s)</?[a-zA-Z][^>]*>|<![^>]*>", "")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, ends trimmed; a blank that stands alone is passed over."""
    return F.trim(F.regexp_replace(text, f" [{_WHITE} ]+|[{_WHITE}][{_WHITE} ]*", " "))


def decoded_text(bare: Column) -> Column:
    """``bare_text`` as shown. Give it a column: decoding reads its text several times."""
    return collapsed(entities(bare))


def inner_text(fragment: Column, decode: bool = True) -> Column:
    """Text of a fragment: block tags part words, inline tags do not."""
    bare = bare_text(fragment)
    return decoded_text(bare) if decode else collapsed(bare)


def raw_text(fragment: Column, decode: bool = True) -> Column:
    """Text content as a document holds it: tags dropped, white space kept."""
    bare = F.regexp_replace(fragment, "(?s)</?[a-zA-Z][^>]*>|<![^>]*>", "")
    return entities(bare) if decode else bare


def without_head(marked: Column) -> Column:
    return F.regexp_replace(marked, "(?is)<head\\b[^>]*>.*?</head\\s*>", " ")


def body_text(html: Column) -> Column:
    """What the document shows, white space collapsed."""
    return inner_text(without_head(markup(html)))


def open_tags(html: Column, name: str) -> Column:
    """All opening tags of an element as written."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<(?:{name})\\b[^>]*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag; null when it is not there."""
    found = F.regexp_extract(tag, f"(?is)^<[^>]*?\\s{literal(name)}\\s*=\\s*{_WRITTEN}", 1)
    bare = f"(?is)^<[^>]*?\\s{literal(name)}(?=[\\s/>])"

    def value(raw: Column) -> Column:
        quoted = raw.startswith('"') | raw.startswith("'")
        return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).when(raw != "", raw).when(tag.rlike(bare), F.lit(""))

    # in a lambda: the value is matched once and not for every use of it
    return F.get(F.transform(F.array(found), value), F.lit(0))


class Mark(str):
    """A pattern for a tag, with texts of which one stands in every match in some letter case."""

    needs: tuple[str, ...] = ()

    def __new__(cls, pattern: str, *needs: str) -> Mark:
        mark = super().__new__(cls, pattern)
        mark.needs = tuple(n.lower() for n in needs)
        return mark

    def __add__(self, other: str) -> Mark:
        return Mark(str.__add__(self, other), *self.needs)


def selector(attr: str, value: str | None = None, how: str = "is", tag: str = "[a-z][a-z0-9-]*") -> Mark:
    """A pattern for opening tags by attribute, as a CSS selector would say it.

    ``how``: ``is``, ``contains``, ``starts`` or ``word`` (one class of many).
    """
    head = f"<(?:{tag})\\s(?:[^>]*?\\s)?{literal(attr)}"
    if value is None:
        return Mark(f"{head}(?=[\\s=/>])", attr)
    text = literal(value)
    inside = {
        "is": f"\"{text}\"|'{text}'|{text}(?=[\\s/>])",
        "contains": f"\"[^\"]*{text}[^\"]*\"|'[^']*{text}[^']*'|[^\\s\"'>]*{text}",
        "starts": f"\"{text}|'{text}|{text}",
        "word": f"\"(?:[^\"]*\\s)?{text}(?:\\s[^\"]*)?\"|'(?:[^']*\\s)?{text}(?:\\s[^']*)?'|{text}(?=[\\s/>])",
    }[how]
    return Mark(f"{head}\\s*=\\s*(?:{inside})", value)


def holds_any(low: Column, needs: Sequence[str]) -> Column:
    """Whether a lower-case text holds any of these; far cheaper than a pattern."""
    out = low.contains(needs[0])
    for text in needs[1:]:
        out = out | low.contains(text)
    return out


def matches_any(html: Column, *patterns: Mark, low: Column | None = None) -> Column:
    """Whether any of the tag patterns occurs; each is looked for only where its text is.

    ``low``: a column with ``lower(html)``, so that many tests share one.
    """
    low = F.lower(html) if low is None else low
    out = None
    for p in patterns:
        found = holds_any(low, p.needs) & html.rlike(f"(?is){p}")
        out = found if out is None else out | found
    return out


def extract_any(html: Column, low: Column, needs: Sequence[str], pattern: str, group: int) -> Column:
    """``regexp_extract`` for a pattern whose every match holds one of ``needs``, tried only where one is."""
    return F.when(~holds_any(low, needs), F.lit("")).otherwise(F.regexp_extract(html, pattern, group))


def element(name: str) -> Mark:
    return Mark(f"<(?:{name})[\\s/>]", *[f"<{n}" for n in name.split("|")])


def elements(html: Column, name: str) -> Column:
    """Elements that do not nest, as written: opening tag to closing tag."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<({name})\\b[^>]*>.*?</\\1\\s*>"), F.lit(0))


def content(whole: Column) -> Column:
    """What stands between the first tag and the last of an element."""
    return F.regexp_replace(F.regexp_replace(whole, "(?s)^<[^>]*>", ""), "(?s)<[^<]*>$", "")


def json_ld_blocks(html: Column) -> Column:
    """Texts of the JSON-LD scripts of a document."""
    pattern = "(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
