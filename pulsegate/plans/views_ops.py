"""Queries behind the operations views: W9, L2-L8, L11, L13, A28, A29."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.functions.scores import RISK_WEIGHTS
from pulsegate.operators import attribution, routing, serving
from pulsegate.plans.common import classified, evaluation, rounded
from pulsegate.plans.registry import query
from pulsegate.schema import TARGET

_EVALUATION = "(SELECT * FROM scored WHERE day BETWEEN 22 AND 30)"
_LATEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY server_id
    ORDER BY event_time DESC, event_id DESC) AS n FROM {_EVALUATION}) WHERE n = 1"""
_COLUMNS = ["event_id", "event_time", "server_id", TARGET, "p_adaptive"]
_LIST = ", ".join(_COLUMNS)


def latest(t):
    return serving.latest_per_server(evaluation(t).select(*_COLUMNS))


@query("w9_latest_per_server", f"SELECT {_LIST} FROM ({_LATEST})", ("scored",))
def latest_per_server(t):
    return latest(t)


@query("l2_alert_history", f"""
    SELECT {_LIST} FROM {_EVALUATION} WHERE p_adaptive >= 0.6
    ORDER BY event_time DESC, event_id DESC""", ("scored",))
def alert_history(t):
    return serving.newest_first(
        evaluation(t).select(*_COLUMNS).where(F.col("p_adaptive") >= 0.6))


@query("l3_recent_alerts", f"""
    SELECT {_LIST}, (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.6)
      AS total_alerts, (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.6) > 40
      AS truncated
    FROM {_EVALUATION} WHERE p_adaptive >= 0.6
    ORDER BY event_time DESC, event_id DESC LIMIT 40""", ("scored",))
def recent_alerts(t):
    return serving.recent_alerts(evaluation(t).select(*_COLUMNS), "p_adaptive", 0.6, 40)


@query("l4_alert_view", f"""
    SELECT {_LIST}, (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.7) AS total_alerts,
      (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.7) > 200 AS truncated
    FROM {_EVALUATION} WHERE p_adaptive >= 0.7
    ORDER BY event_time DESC, p_adaptive DESC, event_id DESC LIMIT 200""", ("scored",))
def alert_view(t):
    return serving.alert_view(evaluation(t).select(*_COLUMNS), "p_adaptive", 0.7, 200)


@query("l5_health_order", f"""
    SELECT {_LIST}, CASE WHEN p_adaptive >= 0.6 THEN 'failure_warning' ELSE 'normal' END
        AS status,
      row_number() OVER (ORDER BY CASE WHEN p_adaptive >= 0.6 THEN 0 ELSE 1 END,
        p_adaptive DESC, server_id) AS rank FROM ({_LATEST})""", ("scored",))
def health_order(t):
    return serving.health_view(latest(t), "p_adaptive", 0.6)


@query("a29_health_summary", f"""
    SELECT count(*) AS servers, count(*) FILTER (WHERE p_adaptive < 0.6) AS normal,
      count(*) FILTER (WHERE p_adaptive >= 0.6) AS failure_warning FROM ({_LATEST})""",
       ("scored",))
def health_summary(t):
    return serving.health_summary(routing.health_labelled(latest(t), "p_adaptive", 0.6))


@query("l8_alerts_to_explain", f"""
    SELECT {_LIST}, (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.6) AS total_alerts,
      (SELECT count(*) FROM {_EVALUATION} WHERE p_adaptive >= 0.6) > 100 AS truncated
    FROM {_EVALUATION} WHERE p_adaptive >= 0.6
    ORDER BY event_time, event_id LIMIT 100""", ("scored",))
def alerts_to_explain(t):
    return serving.alerts_to_explain(evaluation(t).select(*_COLUMNS), "p_adaptive", 0.6, 100)


_FEATURES = list(RISK_WEIGHTS)


def linear_attributions(t):
    """Contributions of the linear risk score: weight times distance from a usual value."""
    alerts = evaluation(t).where(F.col("p_static") >= 0.3)
    parts = [((F.col(name) - 0.5) * weight).alias(name) for name, weight in RISK_WEIGHTS.items()]
    return alerts.select("event_id", *parts)


_PARTS = ", ".join(f"({n} - 0.5E0) * {w}E0 AS {n}" for n, w in RISK_WEIGHTS.items())
_WIDE = f"SELECT event_id, {_PARTS} FROM {_EVALUATION} WHERE p_static >= 0.3"
_TALL = " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS feature, {n} AS value FROM ({_WIDE})" for n in RISK_WEIGHTS)
_MEANS = f"""SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM ({_TALL})
    GROUP BY feature"""


@query("a28_global_importance", _MEANS, ("scored",))
def global_importance(t):
    return rounded(attribution.global_importance(linear_attributions(t), _FEATURES),
                   "mean_abs")


@query("l7_top_features", f"{_MEANS} ORDER BY mean_abs DESC, feature LIMIT 3", ("scored",))
def top_features(t):
    return rounded(attribution.top_features(linear_attributions(t), 3, _FEATURES), "mean_abs")


@query("l6_top_contributors", f"""
    SELECT event_id, n AS place, feature, round(value, 6) AS value FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY event_id
        ORDER BY abs(value) DESC, feature DESC) AS INT) AS n FROM ({_TALL}))
    WHERE n <= 3""", ("scored",))
def top_contributors(t):
    best = attribution.top_contributors(linear_attributions(t), 3, _FEATURES)
    placed = best.select("event_id", F.posexplode("top_contributors").alias("n", "c"))
    return placed.select("event_id", (F.col("n") + 1).alias("place"), "c.feature",
                         F.round("c.value", 6).alias("value"))


def daily_counters(t):
    return (classified(t).groupBy(F.date_diff("event_date", F.lit("2024-01-01").cast("date"))
                                  .alias("batch_id"))
            .agg(F.count("*").alias("received"), F.count_if("is_valid").alias("accepted"),
                 F.count_if(~F.col("is_valid")).alias("quarantined")))


@query("l11_newest_metric", """
    SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) AS INT)
        AS batch_id,
      count(*) AS received, count(*) FILTER (WHERE is_valid) AS accepted,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined
    FROM classified GROUP BY 1 ORDER BY 1 DESC LIMIT 1""", ("classified",))
def newest_metric(t):
    return serving.newest_metric(daily_counters(t))


@query("l13_source_fallback", f"""
    SELECT {_LIST}, 'server_health_snapshot' AS source FROM ({_LATEST})""", ("scored",))
def source_fallback(t):
    rows = evaluation(t).select(*_COLUMNS)
    return serving.first_non_empty([
        ("threshold_alerts", rows.where(F.col("p_adaptive") > 1.5)),
        ("server_health_snapshot", latest(t)),
        ("explained_alerts_fallback", rows.where(F.col("p_adaptive") >= 0.9))])
