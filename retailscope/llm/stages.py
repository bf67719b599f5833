"""Stages of the corpus pipeline: (spark, docs, sf_dir) to documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm import decontaminate, language, sentencepieces, simhash, suffixes
from retailscope.session import table


def _kept(docs: DataFrame, *leave_out: str) -> Column:
    """The columns of the documents as one, so that their names meet no name of a result."""
    return F.struct(*[c for c in docs.columns if c not in leave_out]).alias("_kept")


def _restored(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return found.select(*[new[c].alias(c) if c in new else F.col("_kept")[c].alias(c) for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and those without a letter go. ``lang`` stays as it was.

    If no document outside the held-out fold has a ``lang``, no language can be told from another, and every text with a
    letter stays.
    """
    languages, chances = language.learn(docs)
    if not languages:
        return docs.where(F.coalesce(F.col("text").rlike(language.LETTERS), F.lit(False)))
    found = language.predict(docs.select("text", _kept(docs, "text")), languages, chances, ("_kept",), with_text=True)
    return _restored(found.where(F.col("lang_pred") != language.UNKNOWN), docs, text=F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, unchanged: that with the smallest id, a null id last.

    Rows are judged, not ids: of rows that repeat an id and a text one stays, also if the id is null, and an id with texts
    of several groups may stay in one and go from another. ``keep_first_copies`` states how ties are broken.
    """
    return simhash.keep_first_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that a smaller id holds.

    A character of which only some bytes would go stays whole. ``n_chars`` follows the text; a document of which nothing
    is left goes.
    """
    rows = docs.select("doc_id", "text", _kept(docs, "text"), F.col("text").isNull().alias("_no_text"))
    found = suffixes.find_repeats(rows, ("_kept", "_no_text"), characters=True)
    cut, rest = F.size("spans") > 0, F.col("kept").cast("string")
    found = found.where(~cut | (F.octet_length("kept") > 0))
    n_chars = F.when(cut, F.length(rest).cast("long"))
    if "n_chars" in docs.columns:
        n_chars = F.coalesce(n_chars, F.col("_kept")["n_chars"])
    return _restored(found, docs, text=F.when(~F.col("_no_text"), rest), n_chars=n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window, unchanged."""
    found = decontaminate.find_contamination(docs.select("text", _kept(docs, "text")), table(spark, sf_dir, "benchmark"), carry=("_kept",), with_text=True)
    return _restored(found.where("n_hit = 0"), docs, text=F.col("text"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the ``text`` decoded from them."""
    found = sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))
