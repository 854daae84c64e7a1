"""SQL views that shape the test tables into telemetry, incidents and trajectories.

The text is plain enough to run unchanged in Spark and in the checking engine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.operators.prefix import grouped_rank
from pulsegate.session import use_utc

TELEMETRY_SQL = """
WITH base AS (
SELECT CAST(event_id AS STRING) AS event_id, ts AS event_time,
  CASE WHEN event_id % 251 = 5 THEN ts + INTERVAL '20' MINUTE
       WHEN event_id % 251 = 6 THEN ts - INTERVAL '1' MINUTE
       ELSE ts + INTERVAL '3' SECOND END AS ingest_time,
  CASE WHEN event_id % 251 = 3 THEN 99 WHEN ts >= TIMESTAMP '2024-01-11 00:00:00' THEN 2 ELSE 1 END AS schema_version,
  CONCAT('dc-', CAST(user_id % 5 AS STRING)) AS data_center_id,
  CONCAT('rack-', CAST(user_id % 15 AS STRING)) AS rack_id,
  CONCAT('srv-', CAST(user_id AS STRING)) AS server_id,
  CASE WHEN user_id % 3 = 0 THEN 'messaging' ELSE 'feed' END AS service_name,
  CASE WHEN event_id % 251 = 11 THEN 125.0E0 ELSE CAST((event_id * 37) % 1000 AS DOUBLE) / 10.0E0 END AS cpu_util_pct,
  CASE WHEN event_id % 251 = 17 THEN NULL WHEN event_id % 251 = 53 THEN -1.0E0
       ELSE CAST((event_id * 53) % 1000 AS DOUBLE) / 10.0E0 END AS memory_util_pct,
  CASE WHEN event_id % 251 = 47 THEN 101.0E0 ELSE CAST(event_id % 90 AS DOUBLE) END AS disk_util_pct,
  CAST(event_id % 700 AS DOUBLE) AS disk_iops,
  CAST(event_id % 40 AS DOUBLE) AS disk_queue_depth,
  CAST(event_id % 60 AS DOUBLE) AS network_in_mbps,
  CAST(event_id % 80 AS DOUBLE) AS network_out_mbps,
  value AS request_rate_rps, value AS response_p50_ms,
  CASE WHEN event_id % 251 IN (23, 67) THEN value * 0.5E0 ELSE value * 2.0E0 END AS response_p95_ms,
  CASE WHEN event_id % 251 = 31 THEN 1.5E0 WHEN event_type = 'error' THEN 0.2E0 ELSE 0.01E0 END AS error_rate,
  CASE WHEN event_id % 251 = 37 THEN 0.5E0 WHEN event_id % 251 = 59 THEN -0.1E0
       WHEN event_type = 'error' THEN 0.05E0 ELSE 0.002E0 END AS timeout_rate,
  CASE WHEN event_id % 251 = 43 THEN -1.0E0 ELSE CAST(event_id % 40 AS DOUBLE) END AS queue_depth,
  CASE WHEN event_id % 251 = 41 THEN -1 ELSE CAST(event_id % 500 AS INT) END AS active_connections,
  CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 'deploy-b' END AS deployment_id,
  CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN '2.0.0' ELSE '1.0.0' END AS software_version,
  CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 'cfg-b' ELSE 'cfg-a' END AS config_version,
  FALSE AS maintenance_flag,
  CASE WHEN EXTRACT(HOUR FROM ts) = 18 THEN TRUE ELSE FALSE END AS traffic_campaign_flag,
  CASE WHEN value > 90.0E0 OR event_id % 50 = 0 THEN 1 ELSE 0 END AS failure_within_30min,
  CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN NULL WHEN event_id % 251 = 61 THEN 1.5E0 ELSE 0.9E0 END AS cache_hit_ratio,
  CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' OR event_id % 251 = 29 THEN NULL ELSE 12.0E0 END AS gc_pause_ms,
  CASE WHEN event_id % 251 IN (3, 29) THEN 'schema'
       WHEN event_id % 251 IN (11, 31, 43, 47, 53, 59, 61) THEN 'range'
       WHEN event_id % 251 IN (5, 6) THEN 'temporal'
       WHEN event_id % 251 = 17 THEN 'completeness'
       WHEN event_id % 251 IN (23, 37, 41) THEN 'cross_field' END AS injected_defect_category,
  CASE event_type WHEN 'error' THEN 'incident_response' WHEN 'click' THEN 'health_monitor'
       WHEN 'view' THEN 'capacity_analytics' WHEN 'purchase' THEN 'model_feedback' ELSE 'other' END AS task_type,
  CASE WHEN event_type = 'error' THEN 'High' WHEN event_id % 10 = 0 THEN NULL ELSE 'low' END AS criticality,
  CAST(CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 1000 ELSE 300000 END AS INT) AS latency_sla_ms,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type IN ('error', 'click') THEN 'stream' ELSE 'batch' END AS expected_route,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS workload_units,
  event_id AS raw_id
FROM events),
copies AS (
SELECT b.*, 0 AS duplicate_ordinal FROM base b
UNION ALL
SELECT b.*, 1 AS duplicate_ordinal FROM base b WHERE raw_id % 97 = 1 AND injected_defect_category IS NULL)
SELECT event_id, event_time, ingest_time, schema_version, data_center_id, rack_id, server_id, service_name,
  cpu_util_pct, memory_util_pct, disk_util_pct, disk_iops, disk_queue_depth, network_in_mbps, network_out_mbps,
  request_rate_rps, response_p50_ms, response_p95_ms, error_rate, timeout_rate, queue_depth, active_connections,
  deployment_id, software_version, config_version, maintenance_flag, traffic_campaign_flag, failure_within_30min,
  cache_hit_ratio, gc_pause_ms,
  CASE WHEN injected_defect_category IS NOT NULL OR duplicate_ordinal = 1 THEN TRUE ELSE FALSE END AS is_injected_defect,
  CASE WHEN duplicate_ordinal = 1 THEN 'completeness' ELSE injected_defect_category END AS injected_defect_category,
  CASE WHEN duplicate_ordinal = 1 THEN 'duplicate_event' ELSE injected_defect_category END AS injected_defect_type,
  CASE WHEN injected_defect_category IS NOT NULL OR duplicate_ordinal = 1 THEN 'quarantine' ELSE 'accept' END AS expected_quality_action,
  duplicate_ordinal, task_type, criticality, latency_sla_ms, expected_route, workload_units,
  raw_id * 2 + duplicate_ordinal AS source_sequence
FROM copies
"""

INCIDENTS_SQL = """
SELECT CONCAT('srv-', CAST(user_id AS STRING)) AS server_id, ts AS incident_time
FROM events WHERE event_type = 'error' AND value > 60.0E0
"""

TRAJECTORY_SQL = """
SELECT user_id AS unit_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
  CAST(user_id % 3 AS DOUBLE) AS setting_1, value AS sensor_1,
  CAST(event_id % 100 AS DOUBLE) AS sensor_2
FROM events
"""

START = "2024-01-01"
WINDOWS = {"initial_train": [1, 10], "feedback": [18, 21], "evaluation": [22, 30],
           "stability_window_days": 2, "recency_weight": 4.0}
DRIFT_DAYS = ([1, 10], [15, 17])


class Tables:
    """The views over one data folder, built lazily for one session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = use_utc(spark)
        self.folder = folder.rstrip("/")
        self._trajectory: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("FROM events", "FROM {events}"),
                              events=self.table("events"))

    def telemetry(self) -> DataFrame:
        return self._view(TELEMETRY_SQL)

    def incidents(self) -> DataFrame:
        return self._view(INCIDENTS_SQL)

    def trajectory(self) -> DataFrame:
        """What TRAJECTORY_SQL says; cycles are ranks over chunks, as one user may be hot."""
        if self._trajectory is None:
            rows = self.table("events").select("user_id", "ts", "event_id", "value")
            ranked = grouped_rank(rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()])
            self._trajectory = ranked.select(
                F.col("user_id").alias("unit_id"), F.col("rank").cast("bigint").alias("cycle"),
                (F.col("user_id") % 3).cast("double").alias("setting_1"),
                F.col("value").alias("sensor_1"),
                (F.col("event_id") % 100).cast("double").alias("sensor_2"))
        return self._trajectory
