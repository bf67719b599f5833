"""Structured Streaming jobs: back-off, run report, feed ingest, lost runs.

Each job reads a stream and writes to a folder on shared storage; progress is
kept by the stream's checkpoint, so a lost driver or executor resumes where the
last finished batch ended. A repeated batch replaces what it wrote: folders
carry the batch's number, and merged rows are staged before they go in.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from retailscope.functions.dates import retry_after
from retailscope.functions.urls import domain_key_any
from retailscope.operators.ingest import split_new_and_duplicate
from retailscope.operators.keyed import first_per_key
from retailscope.operators.runs import final_attempts, run_report
from retailscope.session import checkpoint_dir

# State functions are sent by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# First wait after a refusal and the longest.
BASE_WAIT_MS, MAX_WAIT_MS = 3_600_000, 86_400_000
_COOLDOWN = "domain string, change_no bigint, ts_ms bigint, blocked_until_ms bigint, reason string, strikes int, last_status int, cleared boolean"


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stream beside the session's checkpoints."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def _next_wait(strikes: int, blocked_until: int, ts: int, retry_ms: float | None) -> tuple[int, int]:
    """Strikes and end of the wait after a refusal at ``ts``."""
    strikes = strikes + 1 if blocked_until > ts else 1
    backoff = MAX_WAIT_MS if strikes > 6 else min(BASE_WAIT_MS * 2 ** (strikes - 1), MAX_WAIT_MS)
    asked = 0 if retry_ms is None or retry_ms != retry_ms else min(max(int(retry_ms), 0), MAX_WAIT_MS)
    return strikes, ts + max(asked, backoff)


def fold_outcomes(strikes: int, until: int, frames: Iterator[pd.DataFrame]) -> tuple[int, int, dict]:
    """Strikes and end of the wait after the outcomes of a domain, taken by time (success first), and the last one's details.

    Success clears what went before, so only refusals after the last one are kept while the frames are read; times and
    waits are held as plain arrays.
    """
    kept, cleared, last = np.zeros((0, 2)), None, None
    for frame in frames:
        refused = (frame["outcome"] == "refused").to_numpy()
        times = frame["ts_ms"].to_numpy(dtype=np.int64)
        at = np.lexsort((refused, times))[-1]
        key = (int(times[at]), bool(refused[at]))
        if last is None or key >= last[0]:
            last = key, frame.iloc[at]
        if (~refused).any():
            newest = int(times[~refused].max())
            cleared = newest if cleared is None else max(cleared, newest)
        rows = np.column_stack([times.astype(float), frame["retry_ms"].to_numpy(dtype=float, na_value=np.nan)])[refused]
        kept = np.concatenate([kept, rows])
        if cleared is not None:
            kept = kept[kept[:, 0] >= cleared]
    if cleared is not None:
        strikes, until = 0, 0
    for ts, retry_ms in kept[np.argsort(kept[:, 0], kind="stable")].tolist():
        strikes, until = _next_wait(strikes, until, int(ts), retry_ms)
    return strikes, until, last[1].to_dict()


def _cooldown_row(domain: str, strikes: int, until: int, last: dict) -> pd.DataFrame:
    status = None if pd.isna(last["status"]) else int(last["status"])
    return pd.DataFrame(
        {
            "domain": [domain], "change_no": [int(last["batch_ms"])], "ts_ms": [int(last["ts_ms"])], "blocked_until_ms": [until], "reason": [last["reason"]],
            "strikes": [strikes], "last_status": pd.array([status], dtype="Int32"), "cleared": [until == 0],
        }
    )


class Cooldowns(StatefulProcessor):
    """A domain's strikes and wait; a timer at the end of the wait drops them, as no later event can count on them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cooldown", "strikes int, blocked_until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        strikes, until, last = fold_outcomes(*(before or (0, 0)), rows)
        if before and before[1] != until:
            self.handle.deleteTimer(before[1])
        if until:
            self.state.update((strikes, until))
            self.handle.registerTimer(until)
        elif before:
            self.state.clear()
        yield _cooldown_row(key[0], strikes, until, last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _outcomes(events: DataFrame) -> DataFrame:
    """Events with canonical domains and milliseconds; ``batch_ms`` is when their batch began, also if it is repeated."""
    return events.select(
        F.coalesce(domain_key_any(F.col("domain")), F.lower(F.trim("domain"))).alias("domain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "outcome", "reason", F.col("status").cast("int").alias("status"),
        (retry_after(F.col("retry_after"), F.col("ts")) * 1000).cast("double").alias("retry_ms"), F.col("ts").cast("timestamp").alias("event_time"),
        F.unix_millis(F.current_timestamp()).alias("batch_ms"),
    )


def track_cooldowns(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The back-off state of each domain after every batch that touched it.

    ``events``: domain, ts, outcome (refused or ok), reason, status,
    retry_after. A refusal while the last wait stands is one more strike and
    doubles the wait up to a day; a longer ``Retry-After`` wins; success clears.
    The order of events decides, so those of one domain and batch are taken by
    time; the trigger bounds how many that are. ``change_no`` is the time of the
    batch: the highest is the newest, whatever the events' times.

    State ends with the wait: when no event older than ``lateness`` behind the
    newest is taken any more and a wait lies before that, a timer drops it. Later
    events are left out. State is kept in RocksDB, which this sets for streams
    the session starts from then on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    flat = _outcomes(events).withWatermark("event_time", lateness)
    return flat.groupBy("domain").transformWithStateInPandas(Cooldowns(), _COOLDOWN, "append", "EventTime")


def fold_cooldowns(events: DataFrame) -> DataFrame:
    """The same over a finished table: the last state of each domain."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _cooldown_row(key[0], *fold_outcomes(0, 0, iter((frame,))))

    return _outcomes(events).drop("event_time").groupBy("domain").applyInPandas(fold, _COOLDOWN)


def newest_cooldowns(spark: SparkSession, path: str) -> DataFrame:
    """Waits still on record: the newest state of each domain, not cleared."""
    newest = first_per_key(spark.read.schema(_COOLDOWN).parquet(path), ["domain"], [F.col("change_no").desc()])
    return newest.filter(~F.col("cleared")).withColumn("blocked_until", F.timestamp_millis("blocked_until_ms"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a stream that takes what there is and stops."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def _held(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_attempts(batch: DataFrame, batch_id: int, path: str) -> None:
    """Puts a batch's counting attempts into the table, which has a folder per run; only the batch's runs are read.

    What those runs come to is staged first, under the batch's number. A batch that is repeated after its table was
    half written goes on from there, so nothing merged before is lost.
    """
    spark, schema = batch.sparkSession, batch.schema
    staged, table = os.path.join(path, "staging", str(batch_id % 2)), os.path.join(path, "table")
    marked = StructType([*schema.fields, StructField("_batch", LongType())])
    ready = _held(spark, staged, marked)
    if ready is None or (ready.agg(F.min("_batch")).head()[0] != batch_id):
        merged, held = batch, _held(spark, table, StructType([*schema.fields, StructField("_folder", StringType())]))
        if held is not None:
            touched = batch.select(F.col("run_id").cast("string").alias("_run")).distinct()
            merged = held.join(touched, held["_folder"].eqNullSafe(touched["_run"]), "left_semi").drop("_folder").unionByName(batch)
        final_attempts(merged).withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(marked).parquet(staged).drop("_batch")
    rows = rows.withColumn("_folder", F.col("run_id").cast("string"))
    rows.write.partitionBy("_folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)


def stream_final_attempts(logs: DataFrame, path: str, checkpoint: str, lateness: str = "2 days"):
    """Keeps the counting attempt per run, step and shop as the log grows.

    Rows that come again are dropped by ``id`` while the watermark remembers them; rows that started over ``lateness``
    before the newest are left out. Neither state nor the rows a batch reads grow with the batches before it.
    """
    timed = logs.withColumn("started_at", F.col("started_at").cast("timestamp"))
    fresh = timed.withWatermark("started_at", lateness).dropDuplicatesWithinWatermark(["id"]).filter(F.col("status") != "RUNNING")

    def save(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            merge_attempts(batch, batch_id, path)

    return (
        fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def read_streamed_report(spark: SparkSession, path: str) -> DataFrame:
    """The run report over what ``stream_final_attempts`` has written."""
    return run_report(spark.read.parquet(os.path.join(path, "table")).drop("_folder"))


def ingest_feed_incrementally(feed: DataFrame, stores: DataFrame, path: str, checkpoint: str):
    """Adds the new shops of a feed as its files arrive.

    The stream's checkpoint takes the place of a cursor, and its state has a row per domain: when it was first seen. A
    domain is new in the batch that saw it first, so what earlier batches wrote is never read.
    """
    rest = [c for c in feed.columns if c != "domain"]
    seen = feed.filter(F.col("domain").isNotNull()).withColumn("_at", F.current_timestamp())
    firsts = seen.groupBy("domain").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min_by(F.struct(*rest), F.struct("_at", "pos")).alias("_row")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("_first = _last").select("domain", "_row.*").select(*feed.columns)
        labelled = split_new_and_duplicate(new, stores)
        labelled.filter(F.col("feed_label") == "new").drop("feed_label").write.mode("overwrite").parquet(added_path(path, batch_id))

    return (
        firsts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def added_path(path: str, batch_id: int) -> str:
    return os.path.join(path, f"batch={batch_id}")


def detect_abandoned_runs(events: DataFrame, timeout: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """Runs that fell silent while running.

    ``events``: run_id, ts, status. A run's events form a session that ends
    after ``timeout`` of silence; when the watermark passes that end and the
    last status is RUNNING, the run is lost.
    """
    sessions = (
        events.withWatermark("ts", lateness)
        .groupBy("run_id", F.session_window("ts", timeout).alias("s"))
        .agg(F.max_by("status", "ts").alias("last_status"), F.max("ts").alias("last_seen"))
    )
    lost = sessions.filter(F.col("last_status") == "RUNNING")
    return lost.select(
        "run_id", "last_seen", F.lit("FAILED").alias("status"), F.lit("abandoned: the process that started this run is gone").alias("error")
    )
