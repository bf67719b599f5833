"""Feed ingestion: new against known shops, and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.operators.keyed import id_slice, running_sum

#: Positions that are read ahead at first.
MIN_RANGE = 1024


def split_new_and_duplicate(feed: DataFrame, stores: DataFrame, position: str = "pos") -> DataFrame:
    """Feed rows labelled new, duplicate or unusable by domain.

    A row is new when its domain is unknown and no earlier row of the feed has
    it. The first position per domain is a partial aggregate, so copies of one
    domain are reduced before they meet.
    """
    first = feed.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.min(position).alias("_first"))
    known = stores.select("domain").filter(F.col("domain").isNotNull()).distinct().withColumn("_known", F.lit(True))
    firsts = first.join(known, "domain", "left")
    label = (
        F.when(F.col("domain").isNull(), F.lit("unusable"))
        .when(F.col("_known") | (F.col(position) != F.col("_first")), F.lit("duplicate"))
        .otherwise(F.lit("new"))
    )
    return feed.join(firsts, "domain", "left").withColumn("feed_label", label).drop("_first", "_known")


def next_batch(feed: DataFrame, stores: DataFrame, cursor: int, n: int, position: str = "pos") -> DataFrame:
    """Rows from the cursor on until ``n`` new shops are found.

    Duplicates and unusable rows on the way are consumed too. Whether a row is
    new depends on the rows before it alone, so only a range of positions from
    the cursor on is read: it grows fourfold until it holds ``n`` new shops or
    the feed ends. The running count is summed by position ranges.
    """
    label = lambda rows: split_new_and_duplicate(rows, stores, position)
    at = F.col(position)
    ahead, width = feed.filter(at >= cursor), max(MIN_RANGE, 2 * n)
    while True:
        part = ahead.filter(at < cursor + width)
        if label(part).agg(F.count_if(F.col("feed_label") == "new")).first()[0] >= n or ahead.filter(at >= cursor + width).isEmpty():
            break
        width *= 4
    is_new = F.when(F.col("feed_label") == "new", 1).otherwise(0)
    counted = running_sum(label(part), [], [at], id_slice(position), is_new, "_new_so_far")
    return counted.filter(F.col("_new_so_far") - is_new < n).drop("_new_so_far")


def batch_cursor(batch: DataFrame, cursor: int, position: str = "pos") -> DataFrame:
    """Where the next batch starts, and what this one consumed."""
    label = F.col("feed_label")
    return batch.agg(
        F.coalesce(F.max(position) + 1, F.lit(cursor)).cast("bigint").alias("cursor_after"),
        F.count_if(label == "new").alias("created"),
        F.count_if(label == "duplicate").alias("duplicates"),
        F.count_if(label == "unusable").alias("unusable"),
        F.max_by("rank", F.when((label == "new") & F.col("rank").isNotNull(), F.col(position))).alias("last_rank"),
    )


def diff_snapshots(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Two versions of a catalog: what each entry was and is.

    Both sides hold ``version`` and ``releases``. An entry whose refresh failed
    (``error`` in ``fresh``) or that was not refreshed keeps its old values.
    """
    before = old.select(key, F.col("version").alias("version_before"), F.col("releases").alias("_releases_before"), F.lit(True).alias("_old"))
    error = F.col("error") if "error" in fresh.columns else F.lit(None).cast("string")
    after = fresh.select(
        key, F.col("version").alias("_version"), F.col("releases").alias("_releases"), error.alias("error"), F.lit(True).alias("_new")
    )
    kept = F.col("_new").isNull() | F.col("error").isNotNull()
    return (
        before.join(after, key, "full_outer")
        .withColumn("version_after", F.when(kept, F.col("version_before")).otherwise(F.col("_version")))
        .withColumn("releases", F.when(kept, F.col("_releases_before")).otherwise(F.col("_releases")))
        .withColumn(
            "changed",
            ~kept
            & (
                ~F.col("version_before").eqNullSafe(F.col("_version"))
                | ~F.col("_releases_before").eqNullSafe(F.col("_releases"))
            ),
        )
        .select(key, "version_before", "version_after", "releases", "changed", "error")
    )
