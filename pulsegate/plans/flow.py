"""Queries on routing, scoring and workload: R1-R7, A5-A11, A31-A33, J6, W12-W15, L1, L12."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.functions.scores import hex_digit, share
from pulsegate.operators import labels, routing, serving, splits, workload
from pulsegate.plans.common import accepted, classified, hourly, routed, rounded
from pulsegate.plans.registry import query
from pulsegate.plans.views import START

KEY = ["event_id", "source_sequence"]


@query("r1_route", "SELECT event_id, source_sequence, route FROM routed", ("routed",))
def route(t):
    return routed(t).select(*KEY, "route")


@query("r2_route_audit", """
    SELECT event_id, source_sequence, rule_id AS route_rule_id,
      CASE rule_id WHEN 'R1_HIGH_CRITICALITY' THEN 'high criticality requires immediate analysis'
        WHEN 'R2_TIGHT_SLA' THEN 'latency SLA is at most 1000 ms'
        WHEN 'R3_STREAM_TASK' THEN 'task type is latency sensitive'
        WHEN 'R4_DELAY_TOLERANT' THEN 'task type permits deferred execution'
        ELSE 'no stream rule matched' END AS decision_reason FROM routed""", ("routed",))
def route_audit(t):
    return routed(t).select(*KEY, "route_rule_id", "decision_reason")


@query("r3_route_correct", """
    SELECT event_id, source_sequence, route = expected_route AS route_correct FROM routed""",
       ("routed",))
def route_correct(t):
    return routed(t).select(*KEY, "route_correct")


_RISK = ("1 / (1 + exp(-(-6.0E0 + cpu_util_pct * 0.035E0 + memory_util_pct * 0.018E0 "
         "+ response_p95_ms * 0.003E0 + error_rate * 7.0E0 + queue_depth * 0.025E0)))")


@query("r4_risk_score", f"""
    SELECT event_id, source_sequence, round({_RISK}, 6) AS risk_probability,
      {_RISK} >= 0.5 AS predicted_failure FROM accepted""", ("accepted",))
def risk_score(t):
    return rounded(routing.risk_scored(accepted(t)), "risk_probability").select(
        *KEY, "risk_probability", "predicted_failure")


@query("r5_health_label", f"""
    SELECT event_id, source_sequence,
      CASE WHEN {_RISK} >= 0.7 THEN 'failure_warning' ELSE 'normal' END AS status
    FROM accepted""", ("accepted",))
def health_label(t):
    scored = routing.risk_scored(accepted(t))
    return routing.health_labelled(scored, "risk_probability", 0.7).select(*KEY, "status")


@query("r6_display_threshold", """
    SELECT event_id, k / 60.0E0 AS requested,
      least(1.0E0, greatest(0.0E0, k / 60.0E0)) AS threshold_all,
      greatest(0.7E0, least(1.0E0, greatest(0.0E0, k / 60.0E0))) AS threshold_alerts
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) - 10 AS k
          FROM events)""")
def display_threshold(t):
    wanted = t.table("events").select("event_id", (
        (F.get_json_object("props", "$.k").cast("double") - 10) / 60.0).alias("requested"))
    shown = routing.display_threshold(wanted, "requested", 0.7, alerts_only=False)
    shown = shown.withColumnRenamed("threshold", "threshold_all")
    return (routing.display_threshold(shown, "requested", 0.7, alerts_only=True)
            .withColumnRenamed("threshold", "threshold_alerts"))


@query("a5_routing_report", """
    SELECT *, round(correct_rows / labelled_rows, 6) AS routing_accuracy FROM (
      SELECT count(*) AS routed_rows, count(*) FILTER (WHERE route = 'stream') AS stream_rows,
        count(*) FILTER (WHERE route = 'batch') AS batch_rows,
        count(expected_route) AS labelled_rows,
        count(*) FILTER (WHERE route = expected_route) AS correct_rows,
        round(sum(COALESCE(workload_units, 1.0)), 4) AS workload_units FROM routed)""",
       ("routed",))
def routing_report(t):
    report = rounded(routing.routing_report(routed(t)), "routing_accuracy")
    return rounded(report, "workload_units", digits=4)


@query("a6_routing_lossless", """
    SELECT count(*) AS accepted_rows, count(*) AS routed_rows, CAST(0 AS BIGINT) AS lost_rows,
      CAST(0 AS BIGINT) AS added_rows, TRUE AS lossless FROM routed""", ("routed",))
def routing_lossless(t):
    kept = accepted(t)
    return routing.routing_losses(kept, routing.route_tasks(kept), KEY)


_GROUPED = """SELECT time_bucket(INTERVAL '6' HOUR, event_time, TIMESTAMP '2024-01-01') AS
      window_start, data_center_id, service_name, count(*) AS records,
      round(avg(response_p95_ms), 6) AS response_p95_mean,
      round(avg(error_rate), 6) AS error_rate_mean, max(queue_depth) AS queue_depth_max,
      round(sum(request_rate_rps), 4) AS request_rate_sum
    FROM routed GROUP BY 1, 2, 3"""


@query("a7_window_aggregate", _GROUPED, ("routed",))
def window_aggregate(t):
    grouped = workload.window_aggregate(routed(t), "6 hours")
    return rounded(rounded(grouped, "response_p95_mean", "error_rate_mean"),
                   "request_rate_sum", digits=4)


@query("a8_window_summary", f"""
    SELECT CAST(sum(records) AS BIGINT) AS input_rows, count(*) AS output_groups
    FROM ({_GROUPED})""", ("routed",))
def window_summary(t):
    return workload.window_summary(workload.window_aggregate(routed(t), "6 hours"))


@query("a9_path_comparison", """
    SELECT path, load, CAST(sum(n) AS BIGINT) AS input_rows, count(*) AS output_groups FROM (
      SELECT p.path, l.load, time_bucket(INTERVAL '6' HOUR, event_time,
          TIMESTAMP '2024-01-01') AS w, data_center_id, service_name, count(*) AS n
      FROM routed r
      JOIN (VALUES ('all'), ('stream'), ('batch')) p(path) ON p.path = 'all'
        OR p.path = r.route
      JOIN (VALUES ('all'), ('normal'), ('burst')) l(load) ON l.load = 'all'
        OR (l.load = 'burst') = COALESCE(r.traffic_campaign_flag, FALSE)
      GROUP BY ALL) GROUP BY path, load""", ("routed",))
def path_comparison(t):
    return workload.path_comparison(routed(t), "6 hours")


@query("a10_workload_series", """
    SELECT event_minute, round(stream_units, 4) AS stream_units,
      round(batch_units, 4) AS batch_units, is_burst = 1 AS is_burst FROM series""",
       ("series",))
def workload_series(t):
    return rounded(hourly(t), "stream_units", "batch_units", digits=4)


_PLAN = """
    SELECT capacity, p95_stream, n AS normal_share,
      least(0.97, greatest(0.88, n + 0.08)) AS burst_share
    FROM (SELECT *, least(0.90, greatest(0.55, p95_stream / capacity + 0.02)) AS n
      FROM (SELECT quantile_cont(stream_units + batch_units, 0.95) * 1.10 AS capacity,
        quantile_cont(stream_units, 0.95) AS p95_stream FROM series WHERE is_burst = 0))"""


@query("a11_capacity_plan", f"""
    SELECT round(capacity, 4) AS capacity, round(p95_stream, 4) AS p95_stream,
      round(normal_share, 6) AS normal_share, round(burst_share, 6) AS burst_share
    FROM ({_PLAN})""", ("series",))
def capacity_plan(t):
    plan = workload.capacity_plan(hourly(t), 1.10)
    return rounded(rounded(plan, "capacity", "p95_stream", digits=4),
                   "normal_share", "burst_share")


@query("w15_elapsed_minutes", """
    SELECT event_minute, COALESCE(greatest(1.0E0, date_diff('minute',
      lag(event_minute) OVER (ORDER BY event_minute), event_minute)), 1.0E0)
      AS elapsed_minutes
    FROM series""", ("series",))
def elapsed_minutes(t):
    return workload.with_elapsed(hourly(t)).select("event_minute", "elapsed_minutes")


# Units are cut to whole numbers so that sums agree to the last digit in any order; rounding
# comes first because a sum that is whole on paper may end just below it.
def whole_series(t, by=None):
    series = hourly(t, by)
    return workload.with_elapsed(series.withColumns({
        c: F.floor(F.round(c, 4)).cast("double") for c in ("stream_units", "batch_units")}), by)


def mean_capacity(series):
    """Units per minute just above the average inflow, so that queues form and drain."""
    return series.agg(F.floor(F.sum(F.col("stream_units") + F.col("batch_units")) * 1.0625
                              / F.sum("elapsed_minutes") * 64) / 64.0).scalar()


_BACKLOG = """
    whole AS (SELECT event_minute, is_burst = 1 AS is_burst,
        floor(round(stream_units, 4)) AS stream_units,
        floor(round(batch_units, 4)) AS batch_units,
        COALESCE(greatest(1.0E0, date_diff('minute',
          lag(event_minute) OVER (ORDER BY event_minute), event_minute)), 1.0E0)
          AS elapsed_minutes FROM series),
    cap AS (SELECT floor(sum(stream_units + batch_units) * 1.0625E0 / sum(elapsed_minutes)
        * 64) / 64.0E0 AS capacity FROM whole),
    sums AS (SELECT w.*, capacity, sum(stream_units + batch_units - capacity
        * elapsed_minutes) OVER (ORDER BY event_minute) AS s FROM whole w, cap),
    queue AS (SELECT *, greatest(0, s - least(0, min(s) OVER (ORDER BY event_minute)))
        AS baseline_backlog FROM sums)"""


def _with_queue(body):
    return f"SELECT * FROM (WITH {_BACKLOG} {body})"


def unified(t):
    series = whole_series(t)
    return workload.unified_backlog(series, mean_capacity(series))


@query("w12_backlog", _with_queue("""
    SELECT event_minute, round(baseline_backlog, 4) AS baseline_backlog,
      round(baseline_backlog / capacity, 4) AS baseline_delay FROM queue"""), ("series",))
def backlog(t):
    return rounded(unified(t).select("event_minute", "baseline_backlog", "baseline_delay"),
                   "baseline_backlog", "baseline_delay", digits=4)


@query("w12_backlog_peaks", _with_queue("""
    SELECT round(max(baseline_backlog), 4) AS max_backlog_units,
      round(max(baseline_backlog / capacity), 4) AS max_delay_minutes FROM queue"""),
       ("series",))
def backlog_peaks(t):
    peaks = workload.backlog_peaks(unified(t), "baseline_backlog", "baseline_delay")
    return rounded(peaks, "max_backlog_units", "max_delay_minutes", digits=4)


@query("w14_recovery", _with_queue("""
    SELECT last_burst, min(CASE WHEN event_minute >= last_burst AND baseline_backlog <= 0
      THEN CAST(date_diff('minute', last_burst, event_minute) AS DOUBLE) END)
      AS recovery_minutes
    FROM queue, (SELECT max(CASE WHEN is_burst THEN event_minute END) AS last_burst
                 FROM queue) GROUP BY last_burst"""), ("series",))
def recovery(t):
    return workload.recovery_minutes(unified(t), "baseline_backlog")


@query("l1_first_rows", """
    SELECT event_id, source_sequence, event_time FROM telemetry
    ORDER BY event_time, source_sequence LIMIT 500""", ("telemetry",))
def first_rows(t):
    rows = t.telemetry().select(*KEY, "event_time")
    return serving.first_rows(rows, 500, ["event_time", "source_sequence"])


@query("l12_ordered_series", """
    SELECT event_minute, round(stream_units, 4) AS stream_units FROM series
    ORDER BY event_minute""", ("series",))
def ordered_series(t):
    return rounded(hourly(t).select("event_minute", "stream_units"), "stream_units",
                   digits=4).orderBy("event_minute")


def scaling_counts(t):
    judged = classified(t)
    scored = routing.risk_scored(judged)
    return scored.agg(
        F.count("*").alias("processed_rows"),
        F.count_if("is_valid").alias("accepted_rows"),
        F.count_if(~F.col("is_valid")).alias("quarantined_rows"),
        F.count_if(F.col("is_valid") & F.col("predicted_failure")).alias("predicted_alerts"))


_SCALING = f"""SELECT count(*) AS processed_rows,
      count(*) FILTER (WHERE is_valid) AS accepted_rows,
      count(*) FILTER (WHERE NOT is_valid) AS quarantined_rows,
      count(*) FILTER (WHERE is_valid AND {_RISK} >= 0.5) AS predicted_alerts
    FROM classified"""


@query("a31_scaling_counts", _SCALING, ("classified",))
def scaling(t):
    return scaling_counts(t)


@query("a32_experiment_origin", """
    SELECT CAST(min(event_time) AS DATE) AS experiment_start FROM telemetry""",
       ("telemetry",))
def experiment_origin(t):
    return splits.experiment_origin(t.telemetry())


@query("a33_quality_share", f"""
    SELECT round(100.0 * accepted_rows / processed_rows, 6) AS accepted_pct,
      round(100.0 * quarantined_rows / processed_rows, 6) AS quarantined_pct
    FROM ({_SCALING})""", ("classified",))
def quality_share(t):
    counts = scaling_counts(t)
    return counts.select(*[
        F.round(share(F.col(f"{side}_rows"), F.col("processed_rows")) * 100.0, 6)
        .alias(f"{side}_pct") for side in ("accepted", "quarantined")])
