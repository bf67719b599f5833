"""Session helpers: table loading and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the parquet tables, naming each as ``{table}``."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    escaped = text.replace("{", "{{").replace("}", "}}")
    for name in used:
        escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(escaped, **used)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Spreads a frame over all cores when its files make fewer tasks, ``per_core`` for each.

    For work that is heavy per row on small files; an input of many files or
    row groups has its tasks already and is left as it is read.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without
    that setting gets a folder of its own, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if named is None:
        named = tempfile.mkdtemp(prefix="retailscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared checkpoint folder and continues from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
