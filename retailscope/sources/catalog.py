"""Theme catalog, release feeds and settings schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.operators.keyed import number_rows

CATALOG_SCHEMA = """
    updatedAt STRING, note STRING,
    themes MAP<STRING, STRUCT<displayName STRING, architecture STRING, source STRING, github STRING,
        latest STRUCT<version STRING, releasedAt STRING>,
        releases ARRAY<STRUCT<version STRING, releasedAt STRING>>>>
"""
RELEASE_SCHEMA = "ARRAY<STRUCT<tag_name STRING, published_at STRING, prerelease BOOLEAN, draft BOOLEAN>>"
SETTINGS_SCHEMA = "ARRAY<STRUCT<name STRING, theme_version STRING>>"


def read_theme_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog document as one row per theme and release.

    Themes without releases keep one row with an empty release.
    """
    document = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    themes = document.select(F.explode("themes").alias("theme_key", "t"))
    newest = F.try_element_at("t.releases", F.lit(1))
    return themes.select(
        "theme_key",
        F.col("t.displayName").alias("display_name"),
        F.col("t.architecture").alias("architecture"),
        F.coalesce(newest["version"], F.col("t.latest.version")).alias("latest_version"),
        F.coalesce(newest["releasedAt"], F.col("t.latest.releasedAt")).cast("date").alias("latest_released_at"),
        F.posexplode_outer("t.releases").alias("pos", "release"),
    ).select(
        "theme_key", "display_name", "architecture", "latest_version", "latest_released_at", "pos",
        F.col("release.version").alias("version"), F.col("release.releasedAt").cast("date").alias("released_at"),
    )


def catalog_entries(rows: DataFrame) -> DataFrame:
    return rows.select("theme_key", "display_name", "architecture", "latest_version").distinct()


def catalog_releases(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("version").isNotNull()).select("theme_key", "version", "released_at", "pos")


def clean_releases(items: DataFrame, key: str = "theme_key") -> DataFrame:
    """Published releases, first of every version, newest first.

    ``items``: key, pos, tag_name, published_at, prerelease, draft. The first
    row of a version is a partial aggregate; positions are numbered by month.
    """
    no = F.lit(False)
    published = items.filter(
        ~F.coalesce("prerelease", no) & ~F.coalesce("draft", no) & (F.col("tag_name") != "") & (F.col("published_at") != "")
    ).withColumn("version", F.regexp_replace("tag_name", "^[vV]", ""))
    first = published.groupBy(key, "version").agg(
        F.min_by(F.substring("published_at", 1, 10), "pos").alias("released_at"), F.min("pos").alias("_pos")
    )
    order = [F.col("released_at").desc(), F.col("_pos").asc()]
    numbered = number_rows(first, [key], order, F.substring("released_at", 1, 7), "_no", descending=True)
    return numbered.select(key, "version", F.col("released_at").cast("date").alias("released_at"), (F.col("_no") - 1).alias("pos"))


def parse_release_feed(documents: DataFrame, key: str = "theme_key") -> DataFrame:
    """Release documents (``releases_json``) as releases of their theme."""
    items = documents.select(
        key, F.col("page_no") if "page_no" in documents.columns else F.lit(0).alias("page_no"),
        F.posexplode(F.from_json("releases_json", RELEASE_SCHEMA)).alias("_pos", "r"),
    )
    flat = items.select(
        key, F.struct(F.col("page_no").cast("bigint").alias("page_no"), F.col("_pos").alias("nth")).alias("pos"), "r.tag_name", "r.published_at", "r.prerelease", "r.draft"
    )
    return clean_releases(flat, key)


def settings_version(documents: DataFrame, key: str = "theme_key") -> DataFrame:
    """The version a settings schema (``settings_json``) declares, if any."""
    blocks = F.filter(
        F.from_json("settings_json", SETTINGS_SCHEMA),
        lambda b: (b["name"] == "theme_info") & (F.trim(b["theme_version"]) != ""),
    )
    return documents.select(key, F.trim(F.try_element_at(blocks, F.lit(1))["theme_version"]).alias("version")).filter(
        F.col("version").isNotNull()
    )
