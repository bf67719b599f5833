"""Step log analytics: final attempts, run report, errors, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.ranks import rank_in
from retailscope.operators.keyed import first_per_key, id_slice, list_parts

# The order in which a run takes its steps.
STEP_ORDER = (
    "fetch_stores",
    "audit",
    "pagespeed",
    "theme_apps",
    "ai_analysis",
    "contact_search",
    "email_generation",
)
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _number_at(document: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.coalesce(F.when(kind.rlike(_NUMBER), F.try_variant_get(document, path, "double")), F.lit(0.0))


def parse_usage_meta(df: DataFrame, meta: str = "meta_json") -> DataFrame:
    """Adds the tokens a step's meta accounts for.

    A ``usage`` list is summed; otherwise the writer, reviewer and search
    counters are. Text that is no JSON, and values that are no numbers, are 0.
    """
    document = F.col("_meta")
    usage = F.try_variant_get(document, "$.usage", "variant")
    is_list = F.coalesce(F.schema_of_variant(usage).startswith("ARRAY"), F.lit(False))
    entries = F.coalesce(F.try_variant_get(document, "$.usage", "array<variant>"), F.array().cast("array<variant>"))

    def total(name: str) -> Column:
        listed = F.aggregate(F.transform(entries, lambda e: _number_at(e, f"$.{name}")), F.lit(0.0), lambda a, b: a + b)
        plain = sum((_number_at(document, f"$.{key}") for key in _counter_names(name)), F.lit(0.0))
        return F.when(is_list, listed).otherwise(plain).cast("bigint")

    return (
        df.withColumn("_meta", F.try_parse_json(meta))
        .withColumn("tokens_in", total("tokensIn"))
        .withColumn("tokens_out", total("tokensOut"))
        .drop("_meta")
    )


def _counter_names(name: str) -> tuple[str, str, str]:
    upper = name[0].upper() + name[1:]
    return name, f"qc{upper}", f"search{upper}"


def final_attempts(step_logs: DataFrame) -> DataFrame:
    """The row that counts per run, step and shop: last attempt, then last row."""
    ended = step_logs.filter(F.col("status") != "RUNNING")
    return first_per_key(ended, ["run_id", "step", "store_id"], [F.col("attempt").desc(), F.col("id").desc()])


def _outcomes() -> list[Column]:
    status = F.col("status")
    return [
        F.count_if(status == "OK").alias("ok"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(~status.isin("OK", "FAILED")).alias("skipped"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    ]


def run_report(step_logs: DataFrame) -> DataFrame:
    """Outcome, time and tokens of every step of every run."""
    counted = parse_usage_meta(final_attempts(step_logs))
    return counted.groupBy("run_id", "step").agg(*_outcomes()).withColumn("step_rank", rank_in(F.col("step"), STEP_ORDER))


def run_totals(step_logs: DataFrame) -> DataFrame:
    """The report rows of each run and its total (step is null)."""
    counted = parse_usage_meta(final_attempts(step_logs))
    return (
        counted.rollup("run_id", "step")
        .agg(F.grouping_id().alias("_level"), *_outcomes())
        .filter(F.col("_level") < 3)
        .withColumn("is_total", F.col("_level") == 1)
        .drop("_level")
    )


def failed_stores(step_logs: DataFrame, per_part: int = 500) -> DataFrame:
    """Shops that failed per run and step, ascending, in parts of bounded size."""
    failed = final_attempts(step_logs).filter((F.col("status") == "FAILED") & F.col("store_id").isNotNull())
    return list_parts(
        failed, ["run_id", "step"], [F.col("store_id")], id_slice("store_id"), F.col("store_id"), per_part
    ).withColumnRenamed("items", "failed_stores")


def error_histogram(step_logs: DataFrame) -> DataFrame:
    failed = final_attempts(step_logs).filter(
        (F.col("status") == "FAILED") & F.col("error").isNotNull() & (F.col("error") != "")
    )
    return failed.groupBy("run_id", "step", F.col("error").alias("message")).agg(F.count(F.lit(1)).alias("n"))


def completed_stores(step_logs: DataFrame) -> DataFrame:
    """Shops seen in a run that failed at no step of it."""
    final = final_attempts(step_logs).filter(F.col("store_id").isNotNull())
    seen = final.groupBy("run_id", "store_id").agg(F.bool_or(F.col("status") == "FAILED").alias("_failed"))
    return seen.filter(~F.col("_failed")).select("run_id", "store_id")


def last_failures(step_logs: DataFrame) -> DataFrame:
    """Steps whose newest log row, per shop, is a failure."""
    newest = first_per_key(step_logs, ["store_id", "step"], [F.col("id").desc()])
    return newest.filter(F.col("status") == "FAILED").select("store_id", "step", "error", "finished_at")
