"""Event streams: windows with a watermark, sittings, deliveries without repeats, state per key with expiry."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.staging import shared_dir

#: Schema of the event log; nothing is inferred.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """The event log as a stream; watermarks need a time with a zone, so ts is cast.

    All files that are there come in one batch, so that none moves the watermark past the rows of another. ``files`` a
    batch is for a log whose files come in order of time; rows later than the watermark allows are dropped then.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    reader = spark.readStream.schema(EVENTS)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        raw = reader.parquet(f"{folder}/events.parquet")
    else:  # a stream reads folders
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_all(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there, written to a table in the shared folder and read back; progress is kept beside it, so
    a restart goes on where it was."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}/progress").option("path", f"{place}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def windowed(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and values per window and type; later events than ``late`` are dropped, windows are given once closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "event_type", "events", "total")


def sittings(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events per user and sitting, a pause of ``gap`` ending one."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "events")


def first_deliveries(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first of events with equal keys that come within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def leases(events: DataFrame, key: str = "user_id", ttl_ms: int = 6 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """(key, status, beats, last_at): state per key. Every event is a heartbeat that prolongs the key's lease; a row
    EXPIRED is given when the watermark passes its end. The state holds two numbers a key, however many events come."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            beats, last = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["EXPIRED"], "beats": [beats], "last_at": [pd.Timestamp(last, unit="us", tz="UTC").tz_localize(None)]})
            return
        beats, last = state.get if state.exists else (0, 0)
        for pdf in frames:
            beats += len(pdf)
            last = max(last, int(pdf["ts"].astype("datetime64[us]").astype("int64").max()))
        state.update((beats, last))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", late)
        .groupBy(key)
        .applyInPandasWithState(step, f"`{key}` bigint, status string, beats bigint, last_at timestamp", "beats bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )
