"""Loads every query module and holds the flagship query."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.operators import quality, routing
from pulsegate.plans import (flow, gate, history, learning, life, roundtrip,  # noqa: F401
                             scoring, views_ops)
from pulsegate.plans.registry import query
from pulsegate.plans.views import Tables


def scored_alerts(t: Tables) -> DataFrame:
    """Gate, route and score the telemetry; keep the predicted failures."""
    judged = quality.accepted(quality.classify_quality(t.telemetry()))
    scored = routing.risk_scored(routing.route_tasks(judged))
    return (scored.where("predicted_failure")
            .select("event_id", "source_sequence", "event_time", "server_id", "route",
                    "route_rule_id", F.round("risk_probability", 6).alias("risk_probability")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return scored_alerts(Tables(spark, folder))


query("flagship_scored_alerts", """
    SELECT event_id, source_sequence, event_time, server_id, route, rule_id AS route_rule_id,
      round(p, 6) AS risk_probability
    FROM (SELECT *, 1 / (1 + exp(-(-6.0E0 + cpu_util_pct * 0.035E0
            + memory_util_pct * 0.018E0 + response_p95_ms * 0.003E0 + error_rate * 7.0E0
            + queue_depth * 0.025E0))) AS p FROM routed) WHERE p >= 0.5""",
      ("routed",))(scored_alerts)
