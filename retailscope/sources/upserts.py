"""Keyed writes: snapshots, upserts, replacement and versioned drafts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.operators.keyed import id_slice, number_rows
from retailscope.session import cut_lineage

INSERT_ONLY, OVERWRITE, KEEP_IF_NULL = "insert_only", "overwrite", "keep_if_null"
# Letter statuses a later version retires.
SUPERSEDABLE = ("DRAFT", "QC_FAILED", "READY")


def append_snapshots(df: DataFrame, path: str, partition_by: Sequence[str] = ("run_id", "source")) -> None:
    """Adds raw payloads to the history, one folder per run and source."""
    df.write.partitionBy(*partition_by).mode("append").parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Rewrites exactly the partitions that occur in the frame.

    The rows are first written to the checkpoint folder, as they may come from
    the partitions about to be replaced.
    """
    ready = cut_lineage(df)
    (
        ready.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    policy: str | Mapping[str, str],
    order: str | None = None,
) -> DataFrame:
    """The target with the source rows merged in by key.

    ``policy`` per column: ``insert_only`` keeps what the target has,
    ``overwrite`` takes the source, nulls too, ``keep_if_null`` takes the
    source unless it is null. With several source rows for one key they are
    merged one after the other by ``order``; each column is one partial
    aggregate, so copies of a key are reduced before the join.
    """
    columns = [c for c in target.columns if c not in keys]
    rule = {c: policy if isinstance(policy, str) else policy.get(c, OVERWRITE) for c in columns}
    rows = source
    if order is not None:
        when = F.col(order)

        def merged(c: str):
            if rule[c] == INSERT_ONLY:
                return F.min_by(c, when)
            if rule[c] == OVERWRITE:
                return F.max_by(c, when)
            return F.max_by(c, F.when(F.col(c).isNotNull(), when))

        rows = source.groupBy(*keys).agg(*[merged(c).alias(c) for c in columns])
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    new = rows.select(*keys, F.struct(*columns).alias("_new"))
    joined = old.join(new, list(keys), "full_outer")

    def chosen(c: str):
        mine, theirs = F.col("_old")[c], F.col("_new")[c]
        both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
        if rule[c] == KEEP_IF_NULL:
            return F.coalesce(theirs, mine)
        if rule[c] == INSERT_ONLY:
            return F.when(F.col("_old").isNotNull(), mine).otherwise(theirs)
        return F.when(both | F.col("_old").isNull(), theirs).otherwise(mine)

    return joined.select(*[F.col(c) if c in keys else chosen(c).alias(c) for c in target.columns])


def replace_by_key(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All rows of every key in the source replaced, other keys untouched."""
    kept = target.join(source.select(key).distinct(), key, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def append_versioned(target: DataFrame, drafts: DataFrame, key: str = "store_id", order: str = "seq") -> DataFrame:
    """Drafts added as the next versions; what they supersede becomes SKIPPED.

    Only the newest version of a shop stays live. A decision of a person
    (approved or skipped) is never overwritten.
    """
    heads = target.groupBy(key).agg(F.max("version").alias("_head"))
    lasts = drafts.groupBy(key).agg(F.max(order).alias("_last"))
    numbered = number_rows(drafts, [key], [F.col(order)], id_slice(order), "_no").join(heads, key, "left").join(lasts, key)
    added = numbered.withColumn("version", (F.coalesce("_head", F.lit(0)) + F.col("_no")).cast("bigint")).withColumn(
        "status",
        F.when((F.col(order) < F.col("_last")) & F.col("status").isin(*SUPERSEDABLE), F.lit("SKIPPED")).otherwise(
            F.col("status")
        ),
    )
    touched = lasts.select(key, F.lit(True).alias("_touched"))
    retired = target.join(heads, key, "left").join(touched, key, "left").withColumn(
        "status",
        F.when(
            F.col("_touched") & (F.col("version") == F.col("_head")) & F.col("status").isin(*SUPERSEDABLE),
            F.lit("SKIPPED"),
        ).otherwise(F.col("status")),
    )
    return retired.select(*target.columns).unionByName(
        added.select(*[c for c in target.columns if c in added.columns]), allowMissingColumns=True
    )
