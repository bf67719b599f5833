"""App stack and theme state of a shop."""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numbers import bucket, months_since
from retailscope.functions.text import version_struct
from retailscope.operators.keyed import running_sum

# App groups in canonical order.
APP_GROUPS = (
    "marketing",
    "reviews",
    "analytics",
    "upsell",
    "loyalty",
    "subscription",
    "search",
    "personalization",
    "tracking",
    "other",
)
# The feed's app categories and the group of each.
CATEGORY_GROUPS = {
    "email marketing": "marketing",
    "ads": "marketing",
    "pop-ups": "marketing",
    "banners": "marketing",
    "countdown timer": "marketing",
    "affiliate programs": "marketing",
    "discounts": "marketing",
    "social proof": "marketing",
    "marketing - other": "marketing",
    "forms": "marketing",
    "stock alerts": "marketing",
    "product reviews": "reviews",
    "social trust - other": "reviews",
    "analytics": "analytics",
    "upsell and cross-sell": "upsell",
    "product bundles": "upsell",
    "loyalty and rewards": "loyalty",
    "wishlists": "loyalty",
    "subscriptions": "subscription",
    "search and filters": "search",
    "navigation and menus": "search",
    "geolocation": "personalization",
    "currency and translation": "personalization",
    "language and translation": "personalization",
    "order tracking": "tracking",
}
# Upper bounds of the stack sizes.
STACK_SIZES = ((5, "low"), (12, "medium"), (20, "high"))
# Freshness from best to worst, with bounds by gap and by age.
FRESHNESS = ("fresh", "slightly_outdated", "outdated", "very_outdated", "severely_outdated")
GAP_BOUNDS = ((0, "fresh"), (3, "slightly_outdated"), (8, "outdated"), (16, "very_outdated"))
AGE_BOUNDS = ((6, "fresh"), (12, "slightly_outdated"), (24, "outdated"), (48, "very_outdated"))


def app_group(category: Column, groups: dict[str, str] = CATEGORY_GROUPS) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in groups.items()))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(category))), F.lit("other"))


def map_app_groups(apps: DataFrame, groups: dict[str, str] = CATEGORY_GROUPS) -> DataFrame:
    return apps.withColumn("app_group", app_group(F.col("category"), groups))


def app_stack(apps: DataFrame, stores: DataFrame, key: str = "store_id", groups: dict[str, str] = CATEGORY_GROUPS) -> DataFrame:
    """Counts per app group of every shop, groups present and stack size."""
    category = F.trim(F.coalesce("category", F.lit("")))
    counted = (
        map_app_groups(apps, groups)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(category == "").alias("uncategorised"),
            *[F.count_if(F.col("app_group") == g).alias(f"n_{g}") for g in APP_GROUPS],
        )
    )
    numbers = ["total", "uncategorised", *[f"n_{g}" for g in APP_GROUPS]]
    joined = stores.select(key, "apps_count").join(counted, key, "left")
    filled = joined.select(key, "apps_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    size_of = F.greatest(F.col("total"), F.coalesce("apps_count", F.lit(0)))
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{g}") > 0, F.lit(g)) for g in APP_GROUPS]))
    return (
        filled.withColumn("counted", size_of)
        .withColumn("size", F.when(F.col("counted") > 0, bucket(F.col("counted"), STACK_SIZES, "very_high")))
        .withColumn("groups_present", present)
        .withColumn(
            "reason",
            F.when(F.col("counted") == 0, F.lit("no apps recorded for this store")).otherwise(
                F.concat(
                    F.col("counted").cast("string"),
                    F.lit(" app(s), "),
                    F.size(F.array_remove("groups_present", "other")).cast("string"),
                    F.lit(" of 9 groups covered"),
                )
            ),
        )
    )


def other_categories(apps: DataFrame, key: str = "store_id", groups: dict[str, str] = CATEGORY_GROUPS) -> DataFrame:
    """How often each category outside the groups occurs, per shop."""
    named = map_app_groups(apps, groups).withColumn("category", F.trim("category"))
    other = named.filter((F.col("app_group") == "other") & (F.col("category") != ""))
    return other.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"))


def theme_gaps(points: DataFrame, releases: DataFrame) -> DataFrame:
    """Releases newer than each (theme_key, version) asked for.

    Counted by one running total along the versions of a theme, so a theme with
    many releases or many shops never pairs the two.
    """
    version = version_struct(F.col("version"))
    parsed = releases.select("theme_key", version.alias("v")).filter(F.col("v").isNotNull())
    asked = points.select("theme_key", "version", version.alias("v")).filter(F.col("v").isNotNull()).distinct()
    line = parsed.select("theme_key", F.lit(None).cast("string").alias("version"), "v", F.lit(0).alias("kind")).unionByName(
        asked.withColumn("kind", F.lit(1))
    )
    is_release = F.when(F.col("kind") == 0, 1).otherwise(0)
    summed = running_sum(
        line,
        ["theme_key"],
        [F.col("v"), F.col("kind"), F.col("version")],
        F.struct(F.col("v.major").alias("major"), F.col("v.minor").alias("minor")),
        is_release,
        "_not_newer",
    )
    totals = parsed.groupBy("theme_key").agg(F.count(F.lit(1)).alias("_all"))
    return (
        summed.filter(F.col("kind") == 1)
        .join(totals, "theme_key", "left")
        .select("theme_key", "version", (F.coalesce("_all", F.lit(0)) - F.col("_not_newer")).alias("version_gap"))
    )


# Parts the shops of one theme are dealt over.
THEME_PARTS = 16


def theme_staleness(stores: DataFrame, entries: DataFrame, releases: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """How far behind its catalog a shop's theme is.

    ``entries``: theme_key, display_name, architecture, latest_version;
    ``releases``: theme_key, version, released_at, pos (0 is the newest).
    Freshness is the worst of release gap, age of the installed release and the
    architecture's floor.
    """
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    shops = stores.withColumn("_name", clean(F.col("theme_name"))).withColumn("_version", clean(F.col("theme_version")))
    shops = shops.withColumn("theme_key", F.lower("_name"))
    heads = releases.groupBy("theme_key").agg(
        F.min_by("version", "pos").alias("_newest"), F.count(F.lit(1)).alias("_history")
    )
    catalog = entries.join(heads, "theme_key", "left").select(
        "theme_key",
        "display_name",
        "architecture",
        F.coalesce("_newest", "latest_version").alias("latest_version"),
        F.coalesce("_history", F.lit(0)).alias("_history"),
        F.lit(True).alias("_listed"),
    )
    # all that is known of a theme and version, in a row each; shops join it once
    asked = shops.filter(F.col("theme_key").isNotNull()).select("theme_key", F.col("_version").alias("version")).distinct()
    exact = releases.groupBy("theme_key", "version").agg(F.min_by("released_at", "pos").alias("released_at"))
    known = (
        asked.join(catalog, "theme_key", "left")
        .join(theme_gaps(asked.filter(F.col("version").isNotNull()), releases), ["theme_key", "version"], "left")
        .join(exact, ["theme_key", "version"], "left")
    )
    # a struct compares equal where its fields are both null
    at = lambda version: F.struct(F.col("theme_key"), F.col(version).alias("version")).alias("_at")
    # shops of one popular theme, and those without one, are dealt over parts
    parts = F.explode(F.sequence(F.lit(0), F.lit(THEME_PARTS - 1))).alias("_part")
    dealt = shops.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(THEME_PARTS)).cast("int")).select("*", at("_version"))
    facts = known.select(at("version"), *[c for c in known.columns if c not in ("theme_key", "version")], parts)
    joined = dealt.join(facts, ["_at", "_part"], "left").drop("_at", "_part")

    number = lambda name: F.col(name).cast("string")
    level_of = {label: i for i, label in enumerate(FRESHNESS)}

    def level(value: str, bounds) -> Column:
        out = F.when(F.col(value) <= bounds[0][0], F.lit(level_of[bounds[0][1]]))
        for limit, label in bounds[1:]:
            out = out.when(F.col(value) <= limit, F.lit(level_of[label]))
        return out.when(F.col(value).isNotNull(), F.lit(len(FRESHNESS) - 1))

    # Each step is a column of its own, so no expression is written out twice.
    stepped = (
        joined.withColumn("_current", version_struct(F.col("_version")))
        .withColumn("_newest", version_struct(F.col("latest_version")))
        .withColumn("_with_history", F.coalesce(F.col("_history") > 0, F.lit(False)))
        .withColumn("_measured", F.col("_with_history") & F.col("_current").isNotNull())
        .withColumn("_unmeasured", F.col("_listed") & ~F.col("_with_history") & F.col("_current").isNotNull())
        .withColumn("_behind", F.coalesce(F.col("_unmeasured") & (F.col("_newest") > F.col("_current")), F.lit(False)))
        .withColumn("version_gap", F.when(F.col("_measured"), F.col("version_gap")))
        .withColumn("released_at", F.when(F.col("_measured"), F.col("released_at")))
        .withColumn("_months", months_since(F.col("released_at"), today))
        .withColumn("age_months", F.when(F.col("_months").isNotNull(), F.greatest("_months", F.lit(0))))
        .withColumn("_worst", F.greatest(level("version_gap", GAP_BOUNDS), level("age_months", AGE_BOUNDS)))
        .withColumn("_signal", F.when(F.col("_behind"), F.lit(level_of["slightly_outdated"])).otherwise(F.col("_worst")))
        .withColumn(
            "_level",
            F.when(F.col("architecture") == "vintage", F.greatest("_signal", F.lit(level_of["very_outdated"])))
            .when(F.col("architecture") == "theme_blocks", F.coalesce("_signal", F.lit(0)))
            .otherwise(F.col("_signal")),
        )
    )
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("_measured"), F.concat(F.lit("newer releases up to "), F.col("latest_version"), F.lit(": "), number("version_gap"))),
        F.concat(F.lit("age of the installed release in months: "), number("age_months")),
        F.when(F.col("_current").isNull(), F.lit("installed version not given, nothing to compare")),
        F.when(
            F.col("_behind"),
            F.concat(
                F.lit("older than "),
                F.col("latest_version"),
                F.lit(", by how many releases cannot be told without a list of them"),
            ),
        ),
        F.when(
            F.col("_unmeasured") & ~F.col("_behind"),
            F.coalesce(
                F.concat(F.lit("not older than "), F.col("latest_version")),
                F.lit("no release of this theme is on file"),
            ),
        ),
        F.when(F.col("architecture") == "vintage", F.lit("built on the vintage architecture, which counts as very outdated")),
        F.when(
            (F.col("architecture") == "theme_blocks") & F.col("_signal").isNull(),
            F.lit("built of theme blocks, which counts as current"),
        ),
    )
    reason = (
        F.when(F.col("_listed"), reasons)
        .when(F.col("_name").isNotNull(), F.concat(F.lit("unlisted theme: "), F.col("_name")))
        .otherwise(F.lit("theme not given"))
    )
    return stepped.select(
        "store_id",
        F.coalesce("display_name", "_name").alias("theme_name"),
        F.col("_version").alias("current_version"),
        "latest_version",
        "version_gap",
        "released_at",
        "age_months",
        "architecture",
        F.try_element_at(F.array(*map(F.lit, FRESHNESS)), F.col("_level") + 1).alias("freshness"),
        F.coalesce("_listed", F.lit(False)).alias("catalogued"),
        reason.alias("reason"),
    )
