"""Page-speed reports: scores and metrics from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numbers import round_half_up

REPORT_SCHEMA = """
    id STRING, analysisUTCTimestamp STRING,
    loadingExperience STRUCT<metrics MAP<STRING, STRUCT<percentile DOUBLE, category STRING>>>,
    originLoadingExperience STRUCT<metrics MAP<STRING, STRUCT<percentile DOUBLE, category STRING>>>,
    lighthouseResult STRUCT<
        requestedUrl STRING, finalUrl STRING, finalDisplayedUrl STRING, fetchTime STRING, lighthouseVersion STRING,
        runtimeError STRUCT<code STRING, message STRING>,
        categories MAP<STRING, STRUCT<score DOUBLE>>,
        audits MAP<STRING, STRUCT<score DOUBLE, scoreDisplayMode STRING, numericValue DOUBLE>>>
"""
# Report categories and audits by name.
SCORES = {
    "performance": "performance",
    "accessibility": "accessibility",
    "best_practices": "best-practices",
    "seo": "seo",
}
LAB_MILLISECONDS = {
    "fcp_ms": "first-contentful-paint",
    "lcp_ms": "largest-contentful-paint",
    "speed_index_ms": "speed-index",
    "_ttfb_lab_ms": "server-response-time",
}
LAYOUT_SHIFT = "cumulative-layout-shift"
FIELD_TTFB = "EXPERIMENTAL_TIME_TO_FIRST_BYTE"
FIELD_INP = "INTERACTION_TO_NEXT_PAINT"
NO_ERROR = "NO_ERROR"


def _usable(c: Column) -> Column:
    return F.when((c >= 0) & ~F.isnan(c) & (c != float("inf")), c)


def parse_speed_reports(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Scores, lab and field metrics of each report.

    Lab numbers come from the audits; INP is field only, TTFB field first; a
    number of the page precedes one of its origin. Failed audits, negative and
    non-finite numbers are null, and a score of 0 stays 0.
    """
    parsed = df.withColumn("_r", F.from_json(raw, REPORT_SCHEMA) if dict(df.dtypes)[raw] == "string" else F.col(raw))
    lab = F.col("_r.lighthouseResult")

    def audit(name: str) -> Column:
        entry = F.try_element_at(lab["audits"], F.lit(name))
        return F.when(~entry["scoreDisplayMode"].eqNullSafe(F.lit("error")), _usable(entry["numericValue"]))

    def field(metric: str) -> Column:
        at = lambda level: _usable(F.try_element_at(F.col(f"_r.{level}.metrics"), F.lit(metric))["percentile"])
        return F.coalesce(at("loadingExperience"), at("originLoadingExperience"))

    def score(category: str) -> Column:
        value = F.try_element_at(lab["categories"], F.lit(category))["score"]
        return round_half_up(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value) * 100).cast("bigint")

    code = lab["runtimeError"]["code"]
    has_error = (code != "") & (code != NO_ERROR)
    staged = parsed.select(
        "store_id",
        "strategy",
        F.coalesce(lab["finalDisplayedUrl"], lab["finalUrl"], lab["requestedUrl"], F.col("_r.id")).alias("url"),
        F.coalesce(lab["fetchTime"], F.col("_r.analysisUTCTimestamp")).alias("fetched_at"),
        lab["lighthouseVersion"].alias("lighthouse_version"),
        *[score(category).alias(name) for name, category in SCORES.items()],
        *[round_half_up(audit(a)).cast("bigint").alias(name) for name, a in LAB_MILLISECONDS.items()],
        round_half_up(audit(LAYOUT_SHIFT), 3).alias("cls"),
        round_half_up(field(FIELD_INP)).cast("bigint").alias("inp_ms"),
        round_half_up(field(FIELD_TTFB)).cast("bigint").alias("_ttfb_field_ms"),
        (F.col("_r.loadingExperience").isNotNull() | F.col("_r.originLoadingExperience").isNotNull()).alias("has_field_data"),
        F.when(has_error, code).alias("runtime_error"),
        F.when(has_error, lab["runtimeError"]["message"]).alias("runtime_error_message"),
    )
    source = (
        F.when(F.col("_ttfb_field_ms").isNotNull(), F.lit("field")).when(F.col("_ttfb_lab_ms").isNotNull(), F.lit("lab"))
    )
    return staged.withColumn("ttfb_ms", F.coalesce("_ttfb_field_ms", "_ttfb_lab_ms")).withColumn("ttfb_source", source).drop(
        "_ttfb_field_ms", "_ttfb_lab_ms"
    )
