"""Micro-batch gate: classify, split, score and write, safe to replay."""
from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pulsegate.operators.quality import accepted, classify_quality, quarantined
from pulsegate.operators.routing import risk_scored
from pulsegate.sources import message_log, sinks
from pulsegate.sources.readers import CORRUPT
from pulsegate.streaming.seen import remember_ids, seen_before


@dataclass
class GateSinks:
    """Where one gate stream writes.

    ``publish`` receives (name, frame) for message topics, ``documents`` names a connector and its
    options, ``logs`` is a folder of message logs. ``keep_days`` bounds how long ids count as
    seen; by default they always do.
    """

    folder: str
    publish: Callable[[str, DataFrame], None] | None = None
    documents: tuple[str, dict[str, str]] | None = None
    logs: str | None = None
    keep_days: int | None = None

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"


def _publish(invalid: DataFrame, scored: DataFrame, batch_id: int, out: GateSinks) -> None:
    """Send messages and documents; what a sink has committed for the batch is not sent again."""
    commits = out.path("commits")
    topics = {"quarantine": invalid, "predictions": scored}
    for name, frame in topics.items():
        if out.publish:
            sinks.once(frame.sparkSession, commits, f"topic-{name}", batch_id,
                       lambda: out.publish(name, sinks.as_messages(frame)))
        if out.logs:
            # the log knows its batches itself
            message_log.append(sinks.as_messages(frame), f"{out.logs}/{name}", str(batch_id))
    if out.documents:
        sinks.once(scored.sparkSession, commits, "documents", batch_id,
                   lambda: sinks.write_documents(scored, *out.documents))


def process_batch(batch: DataFrame, batch_id: int, out: GateSinks) -> None:
    """Gate one micro-batch and write every output under its batch id.

    Repeats stay in the batch until the gate counts them; an id that an earlier batch brought is a
    repeat, too. A replay of the batch overwrites the folders it wrote before. The source is read
    once and its rows are kept as they arrived. What was written counts itself: the metric row
    takes no pass over rows.
    """
    started = time.perf_counter()
    folder = out.path("seen_ids")
    arrived = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classified = classify_quality(
            arrived, seen_before(arrived, folder, batch_id, out.keep_days))
        valid = accepted(classified).drop(CORRUPT)
        # under its own name Spark would take the column for its own when reading it back
        invalid = quarantined(classified).withColumnRenamed(CORRUPT, "unreadable_text")
        scored = risk_scored(valid)
        sinks.write_validated(valid, out.path("validated"), batch_id)
        sinks.write_quarantine(invalid, out.path("quarantine"), batch_id)
        sinks.write_predictions(scored, out.path("predictions"), batch_id)
        _publish(invalid, scored, batch_id, out)
        remember_ids(arrived, folder, batch_id)
        # from the cache's and the files' own row counts
        received = arrived.count()
        kept = sinks.written_rows(batch.sparkSession, out.path("validated"), batch_id)
        sinks.write_metrics(
            _metrics(batch.sparkSession, received, kept, time.perf_counter() - started),
            out.path("metrics"), batch_id)
    finally:
        arrived.unpersist()


def _metrics(spark: SparkSession, received: int, kept: int, seconds: float) -> DataFrame:
    row = (received, kept, received - kept, seconds * 1000.0, received / max(seconds, 1e-9))
    return spark.createDataFrame([row], "received BIGINT, accepted BIGINT, quarantined BIGINT, "
                                        "duration_ms DOUBLE, processing_rows_per_second DOUBLE")


def run_gate(source: DataFrame, out: GateSinks, checkpoint: str,
             every: str | None = "10 seconds") -> StreamingQuery:
    """Start the gate over a stream; ``every=None`` drains what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (source.writeStream.foreachBatch(lambda batch, n: process_batch(batch, n, out))
            .outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def validated_table(spark: SparkSession, out: GateSinks) -> DataFrame:
    return spark.read.parquet(out.path("validated"))


def batch_rates(query: StreamingQuery) -> list[dict]:
    """Rows and rates of the most recent batches, as the engine itself measured them."""
    return [{"batch_id": p["batchId"], "rows": p["numInputRows"],
             "rows_per_second": p["processedRowsPerSecond"]} for p in query.recentProgress]
