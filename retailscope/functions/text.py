"""Text column builders: folding, words, shingles, versions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose decomposition is one base letter and combining marks, spelled for
# translate(). Derived from the Unicode tables of the whole basic plane, so text of
# any script that builds letters so is folded without leaving the JVM.
_FOLD_FROM, _FOLD_TO = "", ""
for _code in (*range(0x00C0, 0xD800), *range(0xE000, 0x10000)):
    _plain = unicodedata.normalize("NFD", chr(_code).lower())
    _base = "".join(ch for ch in _plain if not "̀" <= ch <= "ͯ")
    if len(_base) == 1 and _base != chr(_code):
        _FOLD_FROM += chr(_code)
        _FOLD_TO += _base
_FOLD_FROM += "łŁ"
_FOLD_TO += "ll"

COMBINING = "[\\u0300-\\u036f]"


def fold(c: Column) -> Column:
    """Lower case without accents, ``ł`` as ``l``; native.

    Letters that come apart into several (Hangul syllables, kana with sound
    marks) stay whole; ``fold_any`` parts those too.
    """
    # in a lambda: compiled on its own, translate builds its table of letters again for every row
    plain = lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(F.regexp_replace(F.translate(t, _FOLD_FROM, _FOLD_TO), COMBINING, ""))
    return F.get(F.transform(F.array(F.lower(c)), plain), F.lit(0))


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """The same folding for any script, by full canonical decomposition."""
    low = texts.str.lower().str.normalize("NFD")
    return low.str.replace("[̀-ͯ]", "", regex=True).str.replace("ł", "l")


def squeeze(c: Column) -> Column:
    """White space runs (no-break spaces included) as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def words(c: Column) -> Column:
    """Folded tokens of letters and digits."""
    gap = lambda t: F.when(F.length(t) == F.octet_length(t), F.regexp_replace(t, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", " "))
    # in a lambda, so that the text is folded once; folded ASCII text has no capitals, and its gaps are found faster so
    plain = F.trim(F.get(F.transform(F.array(fold(c)), gap), F.lit(0)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_count(c: Column) -> Column:
    """Tokens between white space that hold at least one letter or digit."""
    return F.size(F.filter(F.split(c, "(?U)\\s+"), lambda w: w.rlike("[\\p{L}\\p{N}]")))


def shingles(tokens: Column, k: int = 4) -> Column:
    """Distinct windows of ``k`` words; short text is one shingle, empty none."""
    n = F.size(tokens)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(tokens, i, k), " "),
    )
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two distinct arrays, three places."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.floor(shared / union * 1000 + 0.5) / 1000
    )


def version_struct(c: Column) -> Column:
    """``v?major[.minor[.patch]]`` as three numbers, or null."""
    pattern = "^v?(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?"
    text = F.trim(c)

    def part(i: int) -> Column:
        found = F.regexp_extract(text, pattern, i)
        return F.when(found == "", F.lit(0)).otherwise(found.try_cast("bigint")).cast("bigint")

    return F.when(
        text.rlike(pattern),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def non_empty(c: Column, sentinels: tuple[str, ...] = ("unknown", "n/a", "none")) -> Column:
    """Trimmed text, null when empty or a placeholder for an unknown value."""
    text = F.trim(c)
    return F.when((text != "") & ~F.lower(text).isin(*sentinels), text)


def first_name(c: Column) -> Column:
    """The first word of a name when it has at least two characters."""
    head = F.element_at(F.split(F.trim(c), "(?U)\\s+"), 1)
    return F.when(F.length(head) >= 2, head)


def cut(c: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, the last one an ellipsis if cut."""
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit - 1), F.lit("…"))
    )
