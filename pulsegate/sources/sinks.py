"""Sinks: partitioned tables, message encoding, evidence, reports and exports."""
from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegate.schema import TELEMETRY_FIELDS

# Columns of the evidence tables.
QUARANTINE_COLUMNS = [
    "event_id",
    "event_time",
    "server_id",
    "is_injected_defect",
    "injected_defect_category",
    "injected_defect_type",
    "quality_failure_reasons",
    "detected_defect_categories",
    "quality_action",
]
AUDIT_COLUMNS = [
    "event_id",
    "event_time",
    "server_id",
    "task_type",
    "criticality",
    "latency_sla_ms",
    "expected_route",
    "route",
    "route_rule_id",
    "decision_reason",
    "decision_time",
    "route_correct",
    "workload_units",
]
PREDICTION_COLUMNS = [
    "event_id",
    "event_time",
    "server_id",
    "service_name",
    "risk_probability",
    "predicted_failure",
    "schema_version",
]

#: JSON of rows keeps microseconds; Spark's own patterns cut them to milliseconds.
ROW_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _batch_path(folder: str, batch_id: int | None) -> str:
    """Each micro-batch owns one folder, so a replay overwrites what it wrote before."""
    return folder if batch_id is None else f"{folder}/batch_id={batch_id}"


def write_validated(valid: DataFrame, folder: str, batch_id: int | None = None) -> None:
    """A task holds whole days and centres, or even parts of them, so files stay few."""
    keys = ["event_date", "data_center_id"]
    (valid.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
     .parquet(_batch_path(folder, batch_id)))


def written_rows(spark: SparkSession, folder: str, batch_id: int) -> int:
    """Rows of a batch in a Parquet sink, from the footers; no column is read."""
    return spark.read.schema("event_id STRING").parquet(_batch_path(folder, batch_id)).count()


def write_quarantine(invalid: DataFrame, folder: str, batch_id: int | None = None) -> None:
    (invalid.write.mode("overwrite").options(**ROW_TIMES)
     .json(_batch_path(folder, batch_id)))


def write_predictions(scored: DataFrame, folder: str, batch_id: int | None = None) -> None:
    (scored.write.mode("overwrite").partitionBy("event_date")
     .parquet(_batch_path(folder, batch_id)))


def write_metrics(metrics: DataFrame, folder: str, batch_id: int) -> None:
    (metrics.withColumns({"batch_id": F.lit(batch_id).cast("bigint"),
                          "processed_at": F.current_timestamp()})
     .write.mode("overwrite").json(f"{folder}/batch-{batch_id}"))


def as_messages(frame: DataFrame, key: str = "server_id") -> DataFrame:
    """Kafka row encoding: the key column and the whole row as JSON."""
    return frame.select(F.col(key).alias("key"), F.to_json(
        F.struct("*"), ROW_TIMES).alias("value"))


def write_messages(messages: DataFrame, servers: str, topic: str) -> None:
    """Send rows that ``as_messages`` has encoded; guard it with ``once`` against replays."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def prediction_documents(scored: DataFrame) -> DataFrame:
    return scored.select(*PREDICTION_COLUMNS)


def write_documents(scored: DataFrame, data_format: str, options: dict[str, str]) -> None:
    """Append the prediction projection through whichever connector the caller names."""
    (prediction_documents(scored).write.format(data_format).options(**options)
     .mode("append").save())


def once(spark: SparkSession, commits: str, sink: str, batch_id: int,
         send: Callable[[], None]) -> bool:
    """Send unless ``sink`` has committed the batch; its row in the commit table comes last.

    A batch that is replayed after it was committed sends nothing. One that stopped between the
    end of its sending and its commit is sent again, so connectors that can should upsert;
    message logs commit by themselves and have no such gap.
    """
    path = f"{commits}/sink={sink}/batch_id={batch_id}"
    try:
        if not spark.read.schema("committed_at TIMESTAMP").parquet(path).isEmpty():
            return False
    except AnalysisException:  # never sent
        pass
    send()
    spark.range(1).select(F.current_timestamp().alias("committed_at")).write.mode(
        "overwrite").parquet(path)
    return True


def write_accepted_evidence(classified: DataFrame, folder: str) -> None:
    (classified.where("is_valid").select(*TELEMETRY_FIELDS)
     .write.mode("overwrite").options(**ROW_TIMES).json(folder))


def write_quarantine_evidence(classified: DataFrame, folder: str) -> None:
    (classified.where("NOT is_valid").select(*QUARANTINE_COLUMNS)
     .write.mode("overwrite").parquet(folder))


def write_routing_audit(routed: DataFrame, folder: str) -> None:
    (routed.select(*AUDIT_COLUMNS).write.mode("overwrite").partitionBy("route")
     .parquet(folder))


def write_split_csv(split: DataFrame, folder: str, columns: list[str | Column],
                    overwrite: bool = False) -> None:
    """Header CSV in as many parts as there are partitions."""
    (split.select(*columns).write.mode("overwrite" if overwrite else "errorifexists")
     .option("header", True).csv(folder))


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)


def write_trace(trace: DataFrame, folder: str) -> None:
    trace.write.mode("overwrite").option("header", True).csv(folder)


def write_artefact(frame: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Parquet table; an existing one is refused unless overwriting is asked for.

    Without rows it is still a readable table with its columns, so an empty alert list can be
    told from a missing one.
    """
    frame.write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def capped_files(frame: DataFrame, folder: str, records: int) -> None:
    (frame.write.option("maxRecordsPerFile", records).mode("overwrite").parquet(folder))
