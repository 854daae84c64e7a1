"""Keyed state on streams: repeats across micro-batches and windowed aggregates."""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegate.operators.workload import window_aggregate

REPEAT_SEEN = "seen_before"


def drop_repeats(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Keep the first event of each id within the watermark; JVM-side state."""
    return (stream.withWatermark("event_time", lateness)
            .dropDuplicatesWithinWatermark(["event_id"]))


def flag_repeats(stream: DataFrame, lateness: str = "10 minutes",
                 keep_minutes: int = 60) -> DataFrame:
    """Add ``seen_before``: the id occurred earlier, in this batch or an earlier one.

    Unlike a dropping dedup, repeats stay in the output so the gate can quarantine and count
    them. The state of an id is one flag, forgotten after ``keep_minutes`` of event time; rows
    of an id pass through in Arrow batches and are never gathered. Rows without an id are
    never repeats; they are spread over keys of their own so that they do not meet in one task.
    """
    columns = stream.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    keyed = (stream.withWatermark("event_time", lateness)
             .withColumn("_key", F.coalesce("event_id", F.concat(
                 F.lit("no-id-"), F.pmod(F.xxhash64(*columns), F.lit(4096)).cast("string")))))

    def mark(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.exists
        newest = 0
        for batch in batches:
            ordered = batch.sort_values(["ingest_time", "source_sequence"])
            repeat = pd.Series(True, index=ordered.index)
            if not seen and len(ordered):
                repeat.iloc[0] = False
            repeat &= ordered["event_id"].notna()
            seen = seen or len(ordered) > 0
            times = ordered["event_time"].dropna()
            if len(times):
                newest = max(newest, int(times.max().timestamp() * 1000))
            yield ordered[columns].assign(**{REPEAT_SEEN: repeat})
        if seen:
            state.update((True,))
            deadline = max(newest, state.getCurrentWatermarkMs()) + keep_minutes * 60_000
            state.setTimeoutTimestamp(deadline)

    return keyed.groupBy("_key").applyInPandasWithState(
        mark, f"{schema}, {REPEAT_SEEN} BOOLEAN", "seen BOOLEAN", "append",
        GroupStateTimeout.EventTimeTimeout)


def windowed_workload(stream: DataFrame, width: str = "5 minutes",
                      lateness: str | None = "10 minutes") -> DataFrame:
    """The batch window aggregate over a stream, with bounded state.

    Pass ``lateness=None`` after a step that has already set the watermark.
    """
    if lateness:
        stream = stream.withWatermark("event_time", lateness)
    return window_aggregate(stream, width)
