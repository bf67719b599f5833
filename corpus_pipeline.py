"""The corpus pipeline: five stages, each written as Parquet and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retailscope.llm import stages
from retailscope.llm.common import documents, stored

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("suffix_array_dedup", stages.cut_repeated_passages),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("sentencepiece", stages.encode_texts),
]
#: The stages are no SQL; the result is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
