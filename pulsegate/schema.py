"""Telemetry record layout, required-field contracts and feature lists."""
from __future__ import annotations

from pyspark.sql import types as T

# Field names, types and order of one telemetry record.
TELEMETRY = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("ingest_time", T.TimestampType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("data_center_id", T.StringType()),
    T.StructField("rack_id", T.StringType()),
    T.StructField("server_id", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("cpu_util_pct", T.DoubleType()),
    T.StructField("memory_util_pct", T.DoubleType()),
    T.StructField("disk_util_pct", T.DoubleType()),
    T.StructField("disk_iops", T.DoubleType()),
    T.StructField("disk_queue_depth", T.DoubleType()),
    T.StructField("network_in_mbps", T.DoubleType()),
    T.StructField("network_out_mbps", T.DoubleType()),
    T.StructField("request_rate_rps", T.DoubleType()),
    T.StructField("response_p50_ms", T.DoubleType()),
    T.StructField("response_p95_ms", T.DoubleType()),
    T.StructField("error_rate", T.DoubleType()),
    T.StructField("timeout_rate", T.DoubleType()),
    T.StructField("queue_depth", T.DoubleType()),
    T.StructField("active_connections", T.IntegerType()),
    T.StructField("deployment_id", T.StringType()),
    T.StructField("software_version", T.StringType()),
    T.StructField("config_version", T.StringType()),
    T.StructField("maintenance_flag", T.BooleanType()),
    T.StructField("traffic_campaign_flag", T.BooleanType()),
    T.StructField("failure_within_30min", T.IntegerType()),
    T.StructField("cache_hit_ratio", T.DoubleType()),
    T.StructField("gc_pause_ms", T.DoubleType()),
    T.StructField("is_injected_defect", T.BooleanType()),
    T.StructField("injected_defect_category", T.StringType()),
    T.StructField("injected_defect_type", T.StringType()),
    T.StructField("expected_quality_action", T.StringType()),
    T.StructField("duplicate_ordinal", T.IntegerType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("criticality", T.StringType()),
    T.StructField("latency_sla_ms", T.IntegerType()),
    T.StructField("expected_route", T.StringType()),
    T.StructField("workload_units", T.DoubleType()),
    T.StructField("source_sequence", T.LongType()),
])
TELEMETRY_FIELDS = TELEMETRY.fieldNames()

# The fields the quality gate cannot do without.
GATE_REQUIRED = [
    "event_id",
    "event_time",
    "ingest_time",
    "schema_version",
    "data_center_id",
    "server_id",
    "cpu_util_pct",
    "memory_util_pct",
    "response_p50_ms",
    "response_p95_ms",
    "error_rate",
    "queue_depth",
]

# Keys the schema registry requires, per schema version.
REGISTRY_V1 = [
    "event_id",
    "event_time",
    "ingest_time",
    "schema_version",
    "data_center_id",
    "rack_id",
    "server_id",
    "service_name",
    "cpu_util_pct",
    "memory_util_pct",
    "disk_util_pct",
    "disk_iops",
    "disk_queue_depth",
    "network_in_mbps",
    "network_out_mbps",
    "request_rate_rps",
    "response_p50_ms",
    "response_p95_ms",
    "error_rate",
    "timeout_rate",
    "queue_depth",
    "active_connections",
    "software_version",
    "config_version",
]
REGISTRY_V2_EXTRA = ["cache_hit_ratio", "gc_pause_ms"]
REGISTRY = {1: REGISTRY_V1, 2: REGISTRY_V1 + REGISTRY_V2_EXTRA}

# Keys the file contract check asks of every record.
CONTRACT_REQUIRED = [
    "event_id",
    "event_time",
    "ingest_time",
    "schema_version",
    "server_id",
    "cpu_util_pct",
    "memory_util_pct",
    "response_p95_ms",
    "error_rate",
    "queue_depth",
    "failure_within_30min",
    "is_injected_defect",
    "expected_quality_action",
    "duplicate_ordinal",
    "task_type",
    "criticality",
    "latency_sla_ms",
    "expected_route",
    "workload_units",
    "source_sequence",
]

QUALITY_CATEGORIES = ["schema", "range", "temporal", "completeness", "cross_field"]

# Model input columns.
BASE_FEATURES = [
    "cpu_util_pct",
    "memory_util_pct",
    "disk_util_pct",
    "disk_iops",
    "disk_queue_depth",
    "network_in_mbps",
    "network_out_mbps",
    "request_rate_rps",
    "response_p50_ms",
    "response_p95_ms",
    "error_rate",
    "timeout_rate",
    "queue_depth",
    "active_connections",
]
HISTORY_FEATURES = [
    "error_rate_mean_5m",
    "error_rate_mean_15m",
    "error_rate_max_15m",
    "error_rate_delta_15m",
    "response_p95_mean_5m",
    "response_p95_mean_15m",
    "response_p95_delta_15m",
    "timeout_rate_mean_15m",
    "queue_depth_mean_15m",
    "cpu_util_mean_15m",
]
DRIFT_FEATURES = [
    "cpu_util_pct",
    "memory_util_pct",
    "response_p95_ms",
    "error_rate",
    "queue_depth",
]
TARGET = "failure_within_30min"

# Run-to-failure trajectory columns, 26 per text line.
SETTINGS = [f"setting_{n}" for n in range(1, 4)]
SENSORS = [f"sensor_{n}" for n in range(1, 22)]
TRAJECTORY_COLUMNS = ["unit_id", "cycle", *SETTINGS, *SENSORS]
TRAJECTORY_FEATURES = ["cycle", *SETTINGS, *SENSORS]
