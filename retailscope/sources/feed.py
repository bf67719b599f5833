"""Shop feed: landed list responses to shop, app and theme rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.functions.numbers import whole_number
from retailscope.functions.text import non_empty
from retailscope.functions.urls import domain_key_any

# Numbers are declared as text: a feed sends 12, "12" and "n/a" alike.
FEED_SCHEMA = """
    domains ARRAY<STRUCT<
        name STRING, platform_domain STRING, merchant_name STRING, title STRING, platform STRING,
        country_code STRING, currency_code STRING, city STRING, rank STRING, platform_rank STRING,
        estimated_sales STRING, estimated_visits STRING, product_count STRING, theme VARIANT,
        apps ARRAY<STRUCT<name STRING, token STRING, state STRING, categories VARIANT, installs STRING, installed_at STRING>>,
        technologies VARIANT, categories VARIANT, created_at STRING, last_updated_at STRING>>,
    has_next_page BOOLEAN, next_cursor STRING, total BIGINT, _corrupt_record STRING
"""


def read_store_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per shop of landed responses, one JSON document per line.

    A theme is text or an object with a name, version, style and vendor.
    """
    pages = (
        spark.read.schema(FEED_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("source_file", F.input_file_name())
    )
    shops = pages.select(
        "source_file", "has_next_page", "next_cursor", F.posexplode_outer("domains").alias("pos", "shop")
    ).filter(F.col("shop").isNotNull())
    theme = F.col("shop.theme")
    is_text = F.schema_of_variant(theme) == "STRING"

    def theme_part(name: str) -> Column:
        return F.try_variant_get(theme, f"$.{name}", "string")

    plain = [
        "name", "platform_domain", "merchant_name", "title", "platform", "country_code", "currency_code", "city",
        "rank", "platform_rank", "estimated_sales", "estimated_visits", "product_count", "created_at", "last_updated_at",
    ]
    return shops.select(
        "source_file",
        "pos",
        *[F.col(f"shop.{c}").alias(c) for c in plain],
        F.when(is_text, F.try_variant_get(theme, "$", "string")).otherwise(theme_part("name")).alias("theme_name"),
        F.when(~is_text, theme_part("version")).alias("theme_version"),
        F.when(~is_text, theme_part("style")).alias("theme_style"),
        F.when(~is_text, theme_part("vendor")).alias("theme_vendor"),
        F.transform(
            "shop.apps",
            lambda a: F.struct(
                a["name"].alias("name"), a["state"].alias("state"), text_list(a["categories"]).alias("categories")
            ),
        ).alias("apps"),
        text_list(F.col("shop.technologies")).alias("technologies"),
        text_list(F.col("shop.categories")).alias("categories"),
    )


def text_list(items: Column) -> Column:
    """Texts of a list whose members are text or objects with a ``name``."""
    entries = F.coalesce(F.try_variant_get(items, "$", "array<variant>"), F.array().cast("array<variant>"))
    texts = F.transform(
        entries,
        lambda e: F.when(
            F.schema_of_variant(e) == "STRING", non_empty(F.try_variant_get(e, "$", "string"))
        ).otherwise(non_empty(F.try_variant_get(e, "$.name", "string"))),
    )
    return F.filter(texts, lambda t: t.isNotNull())


def normalise_store_feed(raw: DataFrame, placeholders: tuple[str, ...] | None = None) -> DataFrame:
    """Feed rows as shop rows; ``usable`` is false where no domain is valid.

    Columns the feed does not carry may be missing from ``raw``.
    """
    known = {"placeholders": placeholders} if placeholders is not None else {}
    has = set(raw.columns)

    def text(name: str) -> Column:
        return non_empty(F.col(name)) if name in has else F.lit(None).cast("string")

    def number(name: str) -> Column:
        return whole_number(F.col(name)) if name in has else F.lit(None).cast("bigint")

    key = F.coalesce(domain_key_any(F.col("name"), **known), domain_key_any(F.col("platform_domain"), **known))
    given = [c for c in raw.columns if c in ("pos", "source_file", "store_key")]
    app_count = (
        F.size(active_apps(F.col("apps"))) if "apps" in has else F.lit(None).cast("int")
    )
    return (
        raw.withColumn("domain", key)
        .withColumn("_apps", app_count)
        .select(
            *given,
            "domain",
            F.concat(F.lit("https://"), F.col("domain")).alias("url"),
            F.coalesce(text("merchant_name"), text("title")).alias("name"),
            F.upper(text("country_code")).alias("country"),
            F.lower(text("platform")).alias("platform"),
            number("rank").alias("rank"),
            number("estimated_sales").alias("revenue_estimate"),
            number("estimated_visits").alias("traffic_estimate"),
            F.lit(None).cast("double").alias("growth_rate"),
            number("product_count").alias("products_count"),
            F.when(F.col("_apps") > 0, F.col("_apps")).alias("apps_count"),
            text("theme_name").alias("theme_name"),
            text("theme_version").alias("theme_version"),
            F.col("domain").isNotNull().alias("usable"),
        )
    )


def feed_counts(shops: DataFrame) -> DataFrame:
    return shops.agg(
        F.count_if("usable").alias("mapped"), F.count_if(~F.col("usable")).alias("skipped")
    )


def active_apps(apps: Column) -> Column:
    """Named apps in active or unstated state, first of every name kept.

    One feed record carries its own app list, so the array is as long as that
    record and no longer.
    """
    kept = F.filter(
        F.transform(
            apps,
            lambda a: F.struct(
                non_empty(a["name"]).alias("name"),
                F.lower(non_empty(a["state"])).alias("state"),
                F.try_element_at(
                    F.filter(F.transform(a["categories"], lambda c: non_empty(c)), lambda c: c.isNotNull()), F.lit(1)
                ).alias("category"),
            ),
        ),
        lambda a: a["name"].isNotNull() & (a["state"].isNull() | (a["state"] == "active")),
    )
    names = F.transform(kept, lambda a: F.lower(a["name"]))
    return F.filter(kept, lambda a, i: F.array_position(names, F.lower(a["name"])) == i + 1)


def explode_store_apps(df: DataFrame, key: str) -> DataFrame:
    """One row per active app of a shop with its first category."""
    listed = df.select(key, F.posexplode_outer(active_apps(F.col("apps"))).alias("pos", "app")).filter(F.col("app").isNotNull())
    return listed.select(key, "pos", F.col("app.name").alias("name"), F.col("app.category").alias("category"))


def check_feed_filter(df: DataFrame, country: str, platform: str | None = None, limit: float = 0.5) -> DataFrame:
    """Whether the country and platform asked for were applied by the feed.

    Rows that state neither are not counted; more than half wrong fails.
    """
    wrong_country = F.upper("country_code") != country
    wrong_platform = F.lower("platform") != (platform or "").lower()
    counted = df.agg(
        F.count("country_code").alias("with_country"),
        F.count_if(wrong_country).alias("wrong_country"),
        F.count("platform").alias("with_platform"),
        F.count_if(wrong_platform).alias("wrong_platform"),
    )

    def holds(wrong: str, checked: str) -> Column:
        return (F.col(checked) == 0) | (F.col(wrong) <= F.col(checked) * limit)

    platform_ok = holds("wrong_platform", "with_platform") if platform else F.lit(True)
    return counted.withColumn("country_applied", holds("wrong_country", "with_country")).withColumn(
        "platform_applied", platform_ok
    )


def require_feed_filter(df: DataFrame, country: str, platform: str | None = None) -> DataFrame:
    """The feed itself, or an error when its filter was not applied."""
    verdict = check_feed_filter(df, country, platform).first()
    for what in ("country", "platform"):
        if not verdict[f"{what}_applied"]:
            raise ValueError(
                f"feed {what} filter did not apply: {verdict[f'wrong_{what}']} of {verdict[f'with_{what}']} rows differ"
            )
    return df
