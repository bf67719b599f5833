"""Columns that are worked out once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that no later filter or column works out again.

    The optimizer moves a filter below the columns it reads by writing these out in it. It does not do so across an
    outer explode, here of a list of one.
    """
    others = [c for c in df.columns if c not in columns]
    read = df.withColumn("_once", F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = read.select(*others, F.explode_outer(F.array("_once")).alias("_once"))
    return kept.select(*others, *[F.col("_once")[name].alias(name) for name in columns])
