"""Streaming forms: windowed counts with late data, first sightings, sessions. Each takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(files: DataFrame, digest: str = "file_hash", late: str = "1 day") -> DataFrame:
    """Rows whose hash hasn't been seen yet."""
    return files.withWatermark("ts", late).dropDuplicatesWithinWatermark([digest]) if files.isStreaming else files.dropDuplicates([digest])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def expired_states(states: DataFrame, seconds: int, key: str = "session_id", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, at, updates): the last time of each key that has had no update for so many seconds, once it is over.

    On a stream a timer of event time ends a key's state; an update after that begins anew. On a batch, time stands at
    the latest row, and each quiet stretch within the rows ends one state.
    """
    kind = states.schema[key].dataType.simpleString()
    rows = states.select(key, F.col(at).cast("timestamp").alias(at))
    if not states.isStreaming:
        own = Window.partitionBy(key).orderBy(at)
        gap = F.col(at) - F.lag(at).over(own) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
        runs = rows.withColumn("_run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(own)).groupBy(key, "_run").agg(F.max(at).alias(at), F.count("*").alias("updates"))
        now = rows.agg(F.max(at).alias("_now"))  # one row
        over = F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)) < F.col("_now")
        ended = F.lead("_run").over(Window.partitionBy(key).orderBy("_run")).isNotNull()
        return runs.withColumn("_ended", ended).join(F.broadcast(now), F.lit(True)).where(F.col("_ended") | over).select(key, at, "updates")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = lambda last, n: pd.DataFrame({key: [k[0]], "_us": [last], "updates": [n]})
        last, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield over(last, n)
            return
        for b in batches:
            for now in sorted(b["_us"].tolist()):
                if last is not None and now - last > seconds * 1_000_000:
                    yield over(last, n)
                    n = 0
                last, n = max(now, last or now), n + 1
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    # times travel as numbers, which no time zone of a session moves
    held = rows.withWatermark(at, late).withColumn("_us", F.unix_micros(at)).groupBy(key)
    ended = held.applyInPandasWithState(step, f"{key} {kind}, _us long, updates long", "last long, updates long", "append", GroupStateTimeout.EventTimeTimeout)
    return ended.select(key, F.timestamp_micros("_us").alias(at), "updates")
