"""Connected components of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.session import cut_lineage


def connect(links: DataFrame) -> DataFrame:
    """links: ``a``, ``b`` of one ordered type. Returns ``node`` and its component's smallest node as ``label``.

    Links to itself are dropped; nodes without links do not appear. A large-star step hangs all larger neighbours of a
    node on its smallest neighbour, a small-star step joins the smaller ones; links never grow in number. The frame is
    cut to shared storage each round, and rounds end when links no longer change.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("sum")).head()
        if now == before or not now["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        rest = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = cut_lineage(rest.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
