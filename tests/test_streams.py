"""Streams over several files against their batch twins."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from retailscope.operators.runs import final_attempts
from retailscope.session import run_sql
from retailscope.plans import standins as st
from retailscope.streaming import jobs

EVENTS = "domain string, ts timestamp, outcome string, reason string, status int, retry_after string"
START = dt.datetime(2024, 3, 1)


def files(spark, frames, path):
    """One file per frame, in order."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def states_left(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "cooldown").load(checkpoint)


def test_cooldowns_equal_their_batch_twin(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(9)}.pl", START + dt.timedelta(minutes=37 * i), rng.choice(["refused", "refused", "ok"]), "r", 429, rng.choice([None, "60", "90000"])) for i in range(240)]
    frames = [spark.createDataFrame(rng.sample(rows[i : i + 40], 40), EVENTS) for i in range(0, 240, 40)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = jobs.track_cooldowns(files(spark, frames, str(tmp_path / "in")))
    jobs.write_stream(stream, out, check).awaitTermination()
    want = jobs.fold_cooldowns(spark.createDataFrame(rows, EVENTS)).where("not cleared")
    got = jobs.newest_cooldowns(spark, out)
    columns = ["domain", "strikes", "blocked_until_ms", "ts_ms"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))

    after = [("late.pl", START, "refused", "r", 403, None), ("z.pl", START + dt.timedelta(days=30), "ok", "r", 200, None)]
    stream = jobs.track_cooldowns(files(spark, [spark.createDataFrame(after, EVENTS)], str(tmp_path / "in")))
    jobs.write_stream(stream, out, check).awaitTermination()
    assert "late.pl" not in {r["domain"] for r in jobs.newest_cooldowns(spark, out).collect()}
    assert states_left(spark, check).count() == 0


def test_report_over_ten_files(spark, sf_dir, tmp_path):
    logs = run_sql(spark, sf_dir, st.STEP_LOGS)
    edges = [r[0] for r in logs.selectExpr("explode(percentile(unix_micros(cast(started_at as timestamp)), array(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))) AS e").collect()]
    part = sum((F.unix_micros(F.col("started_at").cast("timestamp")) > e).cast("int") for e in edges)
    logs = logs.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumn("_part", part).cache()
    frames = [logs.where(F.col("_part") == i).drop("_part") for i in range(10)]
    frames[9] = frames[9].unionByName(frames[8].limit(3))
    path = str(tmp_path / "out")
    query = jobs.stream_final_attempts(files(spark, frames, str(tmp_path / "in")), path, str(tmp_path / "check"), "400 days")
    query.awaitTermination()
    held = spark.read.parquet(os.path.join(path, "table"))
    columns = ["run_id", "step", "store_id", "id", "attempt", "status"]
    assert sorted(map(tuple, held.select(columns).collect())) == sorted(map(tuple, final_attempts(logs).select(columns).collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = "id long, run_id long, step string, store_id long, status string, attempt int"
    first = spark.createDataFrame([(1, 1, "a", 1, "OK", 1), (2, 2, "a", 1, "OK", 1), (3, None, "a", 1, "OK", 1)], schema)
    second = spark.createDataFrame([(4, 1, "a", 1, "FAILED", 2), (5, 1, "b", 1, "OK", 1), (6, None, "a", 2, "OK", 1)], schema)
    path = str(tmp_path / "out")
    for batch_id, batch in ((0, first), (1, second), (1, second), (1, second.limit(0).unionByName(second))):
        jobs.merge_attempts(batch, batch_id, path)
    held = spark.read.parquet(os.path.join(path, "table"))
    assert sorted(r["id"] for r in held.collect()) == [2, 3, 4, 5, 6]


def test_shops_are_new_once(spark, tmp_path):
    schema = "domain string, pos long, name string"
    frames = [
        spark.createDataFrame([("a.pl", 1, "x"), ("b.pl", 3, "x"), ("b.pl", 2, "y"), (None, 4, "z")], schema),
        spark.createDataFrame([("b.pl", 5, "x"), ("c.pl", 6, "x"), ("known.pl", 7, "x")], schema),
    ]
    stores = spark.createDataFrame([("known.pl",)], "domain string")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    jobs.ingest_feed_incrementally(files(spark, frames, source), stores, str(tmp_path / "one"), check).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "one"))
    assert sorted((r["domain"], r["pos"], r["name"]) for r in found.collect()) == [("a.pl", 1, "x"), ("b.pl", 2, "y"), ("c.pl", 6, "x")]
    # what was written before is elsewhere, so it cannot be read again
    more = files(spark, [spark.createDataFrame([("a.pl", 8, "x"), ("d.pl", 9, "x")], schema)], source)
    jobs.ingest_feed_incrementally(more, stores, str(tmp_path / "two"), check).awaitTermination()
    assert [r["domain"] for r in spark.read.parquet(str(tmp_path / "two")).collect()] == ["d.pl"]
