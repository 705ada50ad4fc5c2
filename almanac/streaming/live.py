"""Sessions over event time, duplicates within a watermark, and folders that are watched."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almanac.session import shared_folder


def sessions(events: DataFrame, by: str = "user_id", ts: str = "ts", gap: str = "2 hours", watermark: str = "1 day") -> DataFrame:
    """by, session_start, session_end (of the last event) and n_events; batch or stream.

    An event ``gap`` after its forerunner still belongs to its session. In a stream, a session is final once the
    watermark has passed it; later events than the watermark allows are dropped.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", watermark)
    # a window closes gap + 1 microsecond after its last event, so that an event exactly gap later is in time
    grouped = timed.groupBy(by, F.session_window("_ts", f"{gap} 1 microsecond" if " " in gap else gap)).agg(F.count("*").alias("n_events"), F.max("_ts").alias("session_end"))
    return grouped.select(by, F.col("session_window.start").alias("session_start"), "session_end", "n_events")


def segments(events: DataFrame, by: str, ts: str = "ts", gap_seconds: int = 7200, watermark: str = "1 day") -> DataFrame:
    """by, segment (from 0), segment_start, segment_end and n_events of each closed segment of a stream's groups.

    Unlike sessions, segments are numbered: a group's state is its open segment and how many it has closed. One closes
    when a later event lies more than the gap behind it, or when the watermark has passed the gap. Events older than
    what a group has seen extend the open segment.
    """
    timed = events.select(F.col(by).alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", watermark)
    kind = dict(timed.dtypes)["key"]
    state_type = "number long, first double, last double, n long"

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, first, last, n = state.get if state.exists else (0, 0.0, 0.0, 0)
        closed = []

        def close() -> None:
            nonlocal number, n
            closed.append((key[0], number, pd.Timestamp(first, unit="s"), pd.Timestamp(last, unit="s"), n))
            number, n = number + 1, 0

        if state.hasTimedOut:
            if n:
                close()
        else:
            times = sorted(t.timestamp() for batch in batches for t in batch["at"])
            for t in times:
                if n and t - last > gap_seconds:
                    close()
                first, last, n = (t, t, 1) if not n else (min(first, t), max(last, t), n + 1)
        state.update((number, first, last, n))
        if n:
            state.setTimeoutTimestamp(max(int((last + gap_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["key", "segment", "segment_start", "segment_end", "n_events"])

    out = timed.groupBy("key").applyInPandasWithState(advance, f"key {kind}, segment long, segment_start timestamp, segment_end timestamp, n_events long", state_type, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", by)


def counts(events: DataFrame, width: str, slide: str | None = None, by: Sequence[str] = (), ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Events in tumbling windows, or sliding ones, by the given columns."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", watermark)
    window = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return timed.groupBy(window, *by).agg(F.count("*").alias("n_events")).select(F.col("window.start").alias("window_start"), *by, "n_events")


def distinct_messages(messages: DataFrame, key: Sequence[str], ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Each message once; in a stream, repeats are recognised within the watermark."""
    if not messages.isStreaming:
        return messages.dropDuplicates(list(key))
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))


def watch_files(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], pattern: str = "*.md", every: str = "5 seconds", checkpoint: str | None = None, max_files: int = 1000, once: bool = False) -> StreamingQuery:
    """``apply`` new files (name, text, modified) batch by batch; a batch that failed is given again after a restart.

    The file stream sees no deletions: run an update_diff over the whole folder now and then.
    """
    stream = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).text(folder, wholetext=True)
    named = stream.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    writer = named.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/watch-{hashlib.sha256(f'{folder}|{pattern}'.encode()).hexdigest()[:16]}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
