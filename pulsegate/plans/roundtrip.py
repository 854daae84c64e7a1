"""Queries that write through a sink and read back through its source: K1-K12, K15, S4, S5,
S8-S10, X1-X6, X9."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegate.operators import quality, routing
from pulsegate.plans.common import (accepted, classified, routed, rul_predictions, scored,
                                    split_rows)
from pulsegate.plans.registry import query
from pulsegate.plans.views import Tables
from pulsegate.schema import TELEMETRY_FIELDS
from pulsegate.sources import message_log, readers, sinks
from pulsegate.staging import shared_folder
from pulsegate.streaming import gate_stream

_RISK = """round(1 / (1 + exp(-(-6.0E0 + cpu_util_pct * 0.035E0 + memory_util_pct * 0.018E0
    + response_p95_ms * 0.003E0 + error_rate * 7.0E0 + queue_depth * 0.025E0))), 6)"""

# Rows of one file of the inbox; up to six times as many come as six files.
INBOX_ROWS = 100_000


def _folder(t: Tables, name: str) -> str:
    """A new folder that every executor reaches."""
    return f"{shared_folder(t.spark)}/roundtrip/{name}-{uuid.uuid4().hex}"


@query("k1_validated_rows", """
    SELECT event_id, source_sequence, data_center_id, CAST(event_time AS DATE) AS event_date
    FROM accepted""", ("accepted",))
def validated_rows(t):
    folder = _folder(t, "validated")
    sinks.write_validated(accepted(t), folder)
    return readers.validated_events(t.spark, folder).select(
        "event_id", "source_sequence", "data_center_id", "event_date")


@query("k2_quarantine_rows", """
    SELECT event_id, event_time, source_sequence, reasons AS quality_failure_type FROM classified
    WHERE NOT is_valid""", ("classified",))
def quarantine_rows(t):
    folder = _folder(t, "quarantine")
    sinks.write_quarantine(quality.quarantined(classified(t)), folder)
    return t.spark.read.schema(
        "event_id STRING, event_time TIMESTAMP, source_sequence BIGINT, "
        "quality_failure_type STRING").json(folder)


@query("k3_prediction_rows", f"""
    SELECT event_id, source_sequence, CAST(event_time AS DATE) AS event_date,
      {_RISK} AS risk_probability FROM accepted""", ("accepted",))
def prediction_rows(t):
    folder = _folder(t, "predictions")
    sinks.write_predictions(routing.risk_scored(accepted(t)), folder)
    return t.spark.read.parquet(folder).select(
        "event_id", "source_sequence", "event_date",
        F.round("risk_probability", 6).alias("risk_probability"))


@query("k4_published_messages", """
    SELECT server_id AS key, event_id, event_time, source_sequence, response_p95_ms FROM classified
    WHERE NOT is_valid""", ("classified",))
def published_messages(t):
    """Messages of the quarantine, sent to a message log and parsed again."""
    log = _folder(t, "log")
    invalid = quality.quarantined(classified(t)).select(*TELEMETRY_FIELDS)
    # a message that is sent twice under its batch's name is in the log once
    for _ in range(2):
        message_log.append(sinks.as_messages(invalid), log, "0")
    parsed = readers.parse_messages(message_log.messages(t.spark, log))
    return parsed.select(F.col("server_id").alias("key"), "event_id", "event_time",
                         "source_sequence", "response_p95_ms")


@query("k5_batch_metrics", """
    SELECT CAST(7 AS BIGINT) AS batch_id, count(*) AS received,
      count(*) FILTER (WHERE is_valid) AS accepted,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined FROM classified""", ("classified",))
def batch_metrics(t):
    folder = _folder(t, "metrics")
    sinks.write_metrics(quality.batch_counters(classified(t)), folder, 7)
    return readers.stream_metrics(t.spark, folder).select(
        "batch_id", "received", "accepted", "quarantined")


@query("k6_prediction_documents", f"""
    SELECT event_id, server_id, service_name, {_RISK} AS risk_probability, schema_version
    FROM accepted""", ("accepted",))
def stored_documents(t):
    """Documents appended once, though their batch is sent twice."""
    folder, commits = _folder(t, "documents"), _folder(t, "commits")
    rows = routing.risk_scored(accepted(t))
    for _ in range(2):
        sinks.once(t.spark, commits, "documents", 0,
                   lambda: sinks.write_documents(rows, "parquet", {"path": folder}))
    return t.spark.read.parquet(folder).select(
        "event_id", "server_id", "service_name",
        F.round("risk_probability", 6).alias("risk_probability"), "schema_version")


_EVIDENCE = ["event_id", "event_time", "ingest_time", "schema_version", "server_id",
             "memory_util_pct", "response_p95_ms", "traffic_campaign_flag", "criticality",
             "latency_sla_ms", "workload_units", "source_sequence"]


@query("k7_accepted_evidence", f"SELECT {', '.join(_EVIDENCE)} FROM accepted", ("accepted",))
def accepted_evidence(t):
    """Accepted rows as NDJSON, read with the explicit schema (S4)."""
    folder = _folder(t, "accepted")
    sinks.write_accepted_evidence(classified(t), folder)
    return readers.telemetry_files(t.spark, folder).select(*_EVIDENCE)


@query("s5_inferred_scan", """
    SELECT event_id, CAST(schema_version AS BIGINT) AS schema_version, cpu_util_pct,
      maintenance_flag, source_sequence FROM telemetry""", ("telemetry",))
def inferred_scan(t):
    folder = _folder(t, "inferred")
    t.telemetry().write.json(folder)
    return readers.telemetry_files_inferred(t.spark, folder).select(
        "event_id", "schema_version", "cpu_util_pct", "maintenance_flag", "source_sequence")


@query("k8_quarantine_evidence", """
    SELECT event_id, event_time, server_id, is_injected_defect, injected_defect_category,
      injected_defect_type, reasons, categories, 'quarantine' AS quality_action
    FROM classified WHERE NOT is_valid""", ("classified",))
def quarantine_evidence(t):
    folder = _folder(t, "quarantine-evidence")
    sinks.write_quarantine_evidence(classified(t), folder)
    return t.spark.read.parquet(folder).select(
        "event_id", "event_time", "server_id", "is_injected_defect", "injected_defect_category",
        "injected_defect_type", F.concat_ws("|", "quality_failure_reasons").alias("reasons"),
        F.concat_ws("|", "detected_defect_categories").alias("categories"), "quality_action")


@query("k9_routing_audit", """
    SELECT event_id, event_time, server_id, task_type, criticality, latency_sla_ms,
      expected_route, route, rule_id AS route_rule_id, route = expected_route AS route_correct,
      workload_units FROM routed""", ("routed",))
def routing_audit(t):
    folder = _folder(t, "audit")
    sinks.write_routing_audit(routed(t), folder)
    return t.spark.read.parquet(folder).drop("decision_time", "decision_reason")


@query("k10_split_csv", """
    SELECT event_id, server_id, day, p_static, split FROM splits
    WHERE split IS NOT NULL""", ("splits",))
def split_csv(t):
    """Split rows as header CSV, read with the schema a caller names (S8)."""
    folder = _folder(t, "splits")
    rows = split_rows(t).where("split IS NOT NULL")
    sinks.write_split_csv(rows, folder, ["event_id", "server_id", "day", "p_static", "split"])
    return readers.prepared_csv(t.spark, folder, "event_id STRING, server_id STRING, day INT, "
                                                 "p_static DOUBLE, split STRING")


@query("k11_report", """
    SELECT count(*) AS received, count(*) FILTER (WHERE is_valid) AS accepted,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined FROM classified""", ("classified",))
def written_report(t):
    """A report as JSON, read back by the views (S10)."""
    folder = _folder(t, "report")
    sinks.write_report(quality.batch_counters(classified(t)), folder)
    return readers.report(t.spark, folder).select("received", "accepted", "quarantined")


@query("k12_prediction_artefact", """
    SELECT unit_id, greatest(0.0E0, 90.0E0 - cycle + setting_1) AS predicted_rul FROM (
      SELECT *, max(cycle) OVER (PARTITION BY unit_id) AS last FROM trajectory)
    WHERE cycle = last""", ("trajectory",))
def prediction_artefact(t):
    folder = _folder(t, "artefact")
    sinks.write_artefact(rul_predictions(t), folder)
    return t.spark.read.parquet(folder)


@query("k15_rows_by_file", """
    SELECT event_id, source_sequence, TRUE AS within_cap FROM accepted""", ("accepted",))
def rows_by_file(t):
    """Rows of capped files, each with whether its file keeps the cap of 200 rows."""
    folder = _folder(t, "capped")
    sinks.capped_files(accepted(t), folder, 200)
    rows = t.spark.read.parquet(folder).select(
        "event_id", "source_sequence", F.col("_metadata.file_path").alias("file"))
    sizes = rows.groupBy("file").agg((F.count("*") <= 200).alias("within_cap"))
    return rows.join(sizes, "file").drop("file")


@query("x9_stream_outcome", """
    SELECT event_id, source_sequence, is_valid FROM classified""", ("classified",))
def stream_outcome(t):
    """The gate as a stream over an inbox, a third of the files a trigger, against the gate over all.

    Files are in order of the sequence and hold both copies of an event. Their number grows with
    the rows, so that no task writes more than about ``INBOX_ROWS``.
    """
    inbox, out = _folder(t, "inbox"), gate_stream.GateSinks(_folder(t, "stream"))
    events = t.telemetry().withColumn("_event", F.floor(F.col("source_sequence") / 2))
    each = 2 * max(1, -(-events.count() // (6 * INBOX_ROWS)))
    events.repartitionByRange(3 * each, "_event").drop("_event").write.json(inbox)
    gate_stream.run_gate(readers.telemetry_inbox(t.spark, inbox, each), out,
                         _folder(t, "stream-state"), None).awaitTermination()
    keys = "event_id STRING, source_sequence BIGINT"
    kept = t.spark.read.schema(keys).option("recursiveFileLookup", "true")
    return (kept.parquet(out.path("validated")).withColumn("is_valid", F.lit(True))
            .unionByName(kept.json(out.path("quarantine"))
                         .withColumn("is_valid", F.lit(False))))
