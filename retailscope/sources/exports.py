"""Approved letters and their spreadsheet export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.operators.keyed import latest_per_key
from retailscope.operators.overview import CLASSIFIER

# Columns of the export and the column each is read from.
EXPORT_COLUMNS = {
    "domain": "domain",
    "contact_name": "contact_name",
    "contact_role": "contact_role",
    "contact_email": "contact_email",
    "subject": "subject",
    "body": "body",
    "category": "category",
    "lead_score": "lead_score",
    "words": "word_count",
    "version": "version",
    "approved_at": "created_at",
}
BYTE_ORDER_MARK = "﻿"


def approved_letters(letters: DataFrame, stores: DataFrame, contacts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Approved letters with shop, contact and the newest lead score."""
    approved = letters.filter(F.col("status") == "APPROVED")
    scores = latest_per_key(
        analyses.filter(F.col("agent") == CLASSIFIER).select("store_id", "id", "lead_score"), ["store_id"], ["id"]
    ).drop("id")
    people = contacts.select(
        F.col("id").alias("contact_id"),
        F.col("name").alias("contact_name"),
        F.col("role").alias("contact_role"),
        F.col("email").alias("contact_email"),
    )
    shops = stores.select(F.col("id").alias("store_id"), "domain")
    return (
        approved.join(shops, "store_id")
        .join(people, "contact_id", "left")
        .join(scores, "store_id", "left")
        .select(
            "id", "domain", "contact_name", "contact_role", "contact_email", "subject", "body", "category",
            "lead_score", "word_count", "version", "created_at",
        )
    )


def csv_cell(c: Column) -> Column:
    """A quoted cell; text a spreadsheet would run as a formula is defused."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    safe = F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def export_lines(approved: DataFrame) -> DataFrame:
    """One text line per letter, to be ordered by ``id``."""
    cells = [csv_cell(F.col(source)) for source in EXPORT_COLUMNS.values()]
    return approved.select("id", F.concat_ws(",", *cells).alias("line"))


def export_approved(approved: DataFrame, path: str) -> None:
    """Writes the export, oldest letter first; the header opens the first file."""
    head = ",".join(f'"{name}"' for name in EXPORT_COLUMNS)
    header = approved.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("id"), F.lit(BYTE_ORDER_MARK + head).alias("line")
    )
    lines = header.unionByName(export_lines(approved))
    lines.orderBy("id").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
