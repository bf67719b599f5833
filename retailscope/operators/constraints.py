"""Rules of the tables that nothing enforces at write time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(violations: DataFrame, rule: str, subject: str) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), "violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str, where=None) -> DataFrame:
    """Keys that occur more than once (where the condition holds)."""
    rows = df.filter(where) if where is not None else df
    return _count(rows.groupBy(*keys).count().filter("count > 1"), "unique", f"{name}({', '.join(keys)})")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    """Rows that refer to nothing."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return _count(df.filter(F.col(column).isNotNull()).join(known, column, "left_anti"), "reference", f"{name}.{column}")


def not_exactly_one(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows in which none or several of the columns are set."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return _count(df.filter(filled != 1), "one_of", f"{name}({', '.join(columns)})")


def not_allowed(df: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    return _count(df.filter(~F.col(column).isin(*values)), "allowed", f"{name}.{column}")


def check_constraints(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)
