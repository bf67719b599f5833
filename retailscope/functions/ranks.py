"""Ranks of enumerated values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities worst first.
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")
# Audited pages in the order a reader meets them.
PAGES = ("site", "homepage", "collection", "product", "cart", "checkout")
# Roles by how likely they are to decide.
ROLES = (
    "CEO",
    "Founder",
    "Owner",
    "Co-Founder",
    "Head of Ecommerce",
    "CTO",
    "Ecommerce Manager",
    "Other",
)


def rank_in(c: Column, values: Sequence[str]) -> Column:
    """Zero-based position in a fixed list; unlisted values come last."""
    out = F.when(c == values[0], F.lit(0))
    for i, value in enumerate(values[1:], start=1):
        out = out.when(c == value, F.lit(i))
    return out.otherwise(F.lit(len(values)))


def severity_rank(c: Column) -> Column:
    return rank_in(c, SEVERITIES)


def page_rank(c: Column) -> Column:
    return rank_in(c, PAGES)


def role_rank(c: Column) -> Column:
    return rank_in(c, ROLES)
