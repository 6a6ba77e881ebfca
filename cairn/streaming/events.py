"""Streams over the event log: windows with watermarks, and a keyed state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.durable import Workspace

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, directory: str, watermark: str = "10 minutes", files: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """The event log as a stream of files, all at once or so many a micro-batch."""
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", files)
    raw = (source.option("maxFilesPerTrigger", per_trigger) if per_trigger else source).parquet(directory)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; appended once the watermark has passed a window, whose state then goes."""
    return _counted(events, F.window("ts", size))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """The same over overlapping windows."""
    return _counted(events, F.window("ts", size, step))


def _counted(events: DataFrame, window) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


STATE = "status string, attempts int, last_id long"
OUT = "user_id long, status string, attempts int, last_id long"
# What an event does to a job.
_NEXT = {"signup": "pending", "view": "running", "click": "completed", "purchase": "retryable", "error": "failed"}


#: A key without events for so long, in event time, loses its state.
IDLE_MS = 90 * 24 * 3600 * 1000


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's events of a micro-batch, chunk by chunk: nothing but the state is kept of what was seen."""
    if state.hasTimedOut:
        state.remove()
        return
    status, attempts, last = state.get if state.exists else ("pending", 0, -1)
    before, told, at = last, last, max(state.getCurrentWatermarkMs(), 0)
    for rows in batches:
        if len(rows):
            at = max(at, int(rows["ts"].max().timestamp() * 1000))
        rows = rows[rows["event_id"] > before].drop_duplicates("event_id")  # others were delivered again
        if not len(rows):
            continue
        attempts += int((rows["event_type"].map(_NEXT) == "running").sum())
        known = rows[rows["event_type"].isin(_NEXT.keys())]
        if len(known) and known["event_id"].max() > told:
            told = int(known["event_id"].max())
            status = _NEXT[known.loc[known["event_id"].idxmax(), "event_type"]]
        last = max(last, int(rows["event_id"].max()))
    state.update((status, int(attempts), int(last)))
    state.setTimeoutTimestamp(at + IDLE_MS)
    yield pd.DataFrame([(key[0], status, int(attempts), int(last))], columns=["user_id", "status", "attempts", "last_id"])


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after every micro-batch; micro-batches of one key arrive in order of their ids.

    Events behind the watermark do not count; a job without events for :data:`IDLE_MS` loses its state.
    """
    return events.select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, purpose: str) -> DataFrame:
    """Run a stream over what is there and return the result table; state and output lie in shared storage."""
    spark = stream.sparkSession
    space = Workspace(spark, f"stream-{purpose}")
    out, checkpoint = space.location("out"), space.location("state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{out}/epoch={epoch}")

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.parquet(f"{out}/epoch=*")
