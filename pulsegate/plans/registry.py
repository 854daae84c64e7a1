"""Collects the named queries and the SQL each one is checked against."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from pulsegate.plans.views import INCIDENTS_SQL, TELEMETRY_SQL, TRAJECTORY_SQL, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_CASE = "CASE WHEN {} THEN '{}' END"
# SQL twin of the gate, written apart from the Spark rules.
_RULES = [
    ("schema", "unsupported_schema", "schema_version NOT IN (1, 2)"),
    ("schema", "v2_required_field_missing",
     "schema_version = 2 AND (cache_hit_ratio IS NULL OR gc_pause_ms IS NULL)"),
    ("range", "cpu_out_of_range", "cpu_util_pct < 0 OR cpu_util_pct > 100"),
    ("range", "memory_out_of_range", "memory_util_pct < 0 OR memory_util_pct > 100"),
    ("range", "disk_out_of_range", "disk_util_pct < 0 OR disk_util_pct > 100"),
    ("range", "error_rate_out_of_range", "error_rate < 0 OR error_rate > 1"),
    ("range", "timeout_rate_out_of_range", "timeout_rate < 0 OR timeout_rate > 1"),
    ("range", "negative_queue_depth", "queue_depth < 0"),
    ("range", "cache_hit_out_of_range",
     "schema_version = 2 AND (cache_hit_ratio < 0 OR cache_hit_ratio > 1)"),
    ("temporal", "ingest_before_event", "ingest_time < event_time"),
    ("temporal", "event_too_late", "ingest_time > event_time + INTERVAL '10' MINUTE"),
    ("completeness", "missing_required_field",
     "event_id IS NULL OR event_time IS NULL OR ingest_time IS NULL OR schema_version IS NULL "
     "OR data_center_id IS NULL OR server_id IS NULL OR cpu_util_pct IS NULL "
     "OR memory_util_pct IS NULL OR response_p50_ms IS NULL OR response_p95_ms IS NULL "
     "OR error_rate IS NULL OR queue_depth IS NULL"),
    ("completeness", "duplicate_event",
     "event_id IS NOT NULL AND (COALESCE(duplicate_ordinal, 0) > 0 OR rk > 1)"),
    ("cross_field", "p95_below_p50", "response_p95_ms < response_p50_ms"),
    ("cross_field", "timeout_exceeds_error_rate", "timeout_rate > error_rate + 1e-9"),
    ("cross_field", "negative_active_connections", "active_connections < 0"),
]
RULE_SQL = {rule: condition for _, rule, condition in _RULES}
_CATEGORIES = ["schema", "range", "temporal", "completeness", "cross_field"]


def _reasons() -> str:
    cases = ", ".join(_CASE.format(condition, rule) for _, rule, condition in _RULES)
    return f"concat_ws('|', {cases})"


def _categories() -> str:
    cases = []
    for category in _CATEGORIES:
        any_of = " OR ".join(f"({c})" for k, _, c in _RULES if k == category)
        cases.append(_CASE.format(any_of, category))
    return f"concat_ws('|', {', '.join(cases)})"


_VIEWS = {
    "telemetry": ([], TELEMETRY_SQL),
    "incidents": ([], INCIDENTS_SQL),
    "trajectory": ([], TRAJECTORY_SQL),
    "ranked": (["telemetry"], """
        SELECT t.*, ROW_NUMBER() OVER (PARTITION BY event_id
          ORDER BY COALESCE(duplicate_ordinal, 0), ingest_time NULLS LAST,
                   COALESCE(source_sequence, 0)) AS rk FROM telemetry t"""),
    "evidence": (["ranked"], f"""
        SELECT *, {_reasons()} AS reasons, {_categories()} AS categories FROM ranked"""),
    "classified": (["evidence"], """
        SELECT *, CASE WHEN reasons = '' THEN 0
                  ELSE length(reasons) - length(replace(reasons, '|', '')) + 1 END AS rule_count,
          reasons = '' AS is_valid FROM evidence"""),
    "accepted": (["classified"], "SELECT * FROM classified WHERE is_valid"),
    "routed": (["accepted"], """
        SELECT *, CASE WHEN rule_id IN ('R4_DELAY_TOLERANT', 'R5_DEFAULT_BATCH')
                  THEN 'batch' ELSE 'stream' END AS route FROM (
          SELECT *, CASE WHEN lower(COALESCE(criticality, '')) = 'high'
                         THEN 'R1_HIGH_CRITICALITY'
                    WHEN latency_sla_ms <= 1000 THEN 'R2_TIGHT_SLA'
                    WHEN task_type IN ('health_monitor', 'incident_response',
                                       'incident_enrichment') THEN 'R3_STREAM_TASK'
                    WHEN task_type IN ('capacity_analytics', 'model_feedback',
                                       'audit_compaction') THEN 'R4_DELAY_TOLERANT'
                    ELSE 'R5_DEFAULT_BATCH' END AS rule_id FROM accepted)"""),
    "scored": (["accepted"], """
        SELECT *, round(1 / (1 + exp(-(-6.0E0 + cpu_util_pct * 0.035E0
            + memory_util_pct * 0.018E0 + response_p95_ms * 0.003E0 + error_rate * 7.0E0
            + queue_depth * 0.025E0))), 4) AS p_static,
          round(1 / (1 + exp(-(response_p50_ms - 90.0E0) / 20.0E0)), 4) AS p_adaptive,
          CAST(date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) + 1 AS INT) AS day
        FROM accepted"""),
    "splits": (["scored"], """
        SELECT *, CASE WHEN day BETWEEN 1 AND 10 THEN 'pre_drift_train'
            WHEN day BETWEEN 18 AND 21 AND substr(md5(event_id), 1, 1) < 'b'
                 THEN 'feedback_train'
            WHEN day BETWEEN 18 AND 21 THEN 'feedback_calibration'
            WHEN day BETWEEN 22 AND 30 THEN 'evaluation' END AS split FROM scored"""),
    "series": (["routed"], """
        SELECT date_trunc('hour', event_time) AS event_minute,
          sum(CASE WHEN route = 'stream' THEN COALESCE(workload_units, 1.0E0) ELSE 0 END)
            AS stream_units,
          sum(CASE WHEN route = 'batch' THEN COALESCE(workload_units, 1.0E0) ELSE 0 END)
            AS batch_units,
          max(CASE WHEN COALESCE(traffic_campaign_flag, FALSE) THEN 1 ELSE 0 END) AS is_burst
        FROM routed GROUP BY 1"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views and those they are built on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in ordered)
    if not ctes:
        return body
    return f"WITH {ctes}\n{body}"


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` is the statement over ``views`` it must agree with."""
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark, folder: str) -> DataFrame:
            return build(Tables(spark, folder))
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql, *views)
        return build
    return register
