"""Queries on trajectories and incidents: S6, S7, J1-J5, W2-W4, A12-A15, U3, P9, P10."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.operators import labels, splits
from pulsegate.plans.common import rounded, rul_predictions, rul_truth
from pulsegate.plans.registry import query
from pulsegate.plans.views import START
from pulsegate.sources import readers

KEY = ["event_id", "source_sequence"]
TWO_DAYS = 2 * 24 * 60.0
COLUMNS = ["unit_id", "cycle", "setting_1", "sensor_1", "sensor_2"]


@query("s6_trajectory_text", "SELECT * FROM trajectory", ("trajectory",))
def trajectory_text(t):
    lines = t.trajectory().select(F.concat(
        F.lit("  "), F.concat_ws("   ", *[F.col(c).cast("string") for c in COLUMNS]),
        F.lit(" \t")).alias("value"))
    return readers.parse_trajectory(lines, COLUMNS)


@query("s7_ordered_labels", """
    SELECT event_id, CAST(position AS BIGINT) AS position,
      CASE position WHEN 1 THEN value WHEN 2 THEN CAST(user_id AS DOUBLE)
        ELSE CAST(event_id % 125 AS DOUBLE) END AS value
    FROM events CROSS JOIN (VALUES (1), (2), (3)) p(position)""")
def ordered_labels(t):
    texts = t.table("events").select("event_id", F.concat_ws(
        "\n", F.col("value").cast("string"), F.col("user_id").cast("string"),
        F.pmod("event_id", F.lit(125)).cast("string")).alias("text"))
    return readers.ordered_values(texts, "text", ["event_id"])


_TERMINAL = """SELECT *, max(cycle) OVER (PARTITION BY unit_id) AS terminal
    FROM trajectory"""
_TRUTH = "SELECT DISTINCT unit_id, unit_id % 50 + 5 AS rul FROM trajectory"
_PREDICTED = f"""SELECT unit_id, greatest(0.0E0, 90.0E0 - cycle + setting_1) AS predicted_rul
    FROM ({_TERMINAL}) WHERE cycle = terminal"""
_ERRORS = f"""SELECT p.unit_id, predicted_rul, CAST(rul AS DOUBLE) AS actual_rul,
      predicted_rul - rul AS error, abs(predicted_rul - rul) AS absolute_error,
      CASE WHEN predicted_rul < rul THEN exp(-(predicted_rul - rul) / 13.0E0) - 1
        ELSE exp((predicted_rul - rul) / 10.0E0) - 1 END AS nasa_penalty
    FROM ({_PREDICTED}) p JOIN ({_TRUTH}) t ON p.unit_id = t.unit_id"""


def _errors(t):
    truth = rul_truth(t).select("unit_id",
                                F.col("rul_at_final_cycle").cast("double").alias("actual_rul"))
    return labels.rul_errors(rul_predictions(t), truth)


@query("j1_predictions_with_truth", f"""
    SELECT unit_id, predicted_rul, actual_rul, error, absolute_error FROM ({_ERRORS})""",
       ("trajectory",))
def predictions_with_truth(t):
    return _errors(t).drop("nasa_penalty")


@query("a15_asymmetric_penalty", f"""
    SELECT unit_id, round(nasa_penalty, 6) AS nasa_penalty FROM ({_ERRORS})""",
       ("trajectory",))
def penalties(t):
    return rounded(_errors(t).select("unit_id", "nasa_penalty"), "nasa_penalty")


@query("a14_regression_report", f"""
    SELECT count(*) AS test_engines, round(sqrt(avg(error * error)), 6) AS rmse,
      round(avg(absolute_error), 6) AS mae, round(avg(error), 6) AS mean_error,
      round(sum(nasa_penalty), 3) AS nasa_score,
      round(avg(CASE WHEN absolute_error <= 10 THEN 1.0E0 ELSE 0 END), 6)
        AS within_10_cycles,
      round(1 - sum(error * error) / (SELECT sum((e.actual_rul - m) * (e.actual_rul - m))
        FROM ({_ERRORS}) e, (SELECT avg(actual_rul) AS m FROM ({_ERRORS}))), 6) AS r2
    FROM ({_ERRORS})""", ("trajectory",))
def regression_report(t):
    report = rounded(labels.regression_report(_errors(t)), "rmse", "mae", "mean_error",
                     "within_10_cycles", "r2")
    return rounded(report, "nasa_score", digits=3)


_TEST = f"""SELECT f.* EXCLUDE (terminal), rul + terminal - cycle AS actual_rul,
      CASE WHEN rul + terminal - cycle <= 30 THEN 1 ELSE 0 END AS failure_within_horizon
    FROM ({_TERMINAL}) f JOIN ({_TRUTH}) r ON f.unit_id = r.unit_id"""


@query("j2_backfilled_rul", _TEST, ("trajectory",))
def backfilled_rul(t):
    return labels.horizon_target(t.trajectory(), 30, rul_truth(t))


@query("j3_label_reconciliation", """
    SELECT count(*) FILTER (WHERE unit_id % 7 = 0) AS units_without_label,
      count(*) FILTER (WHERE unit_id % 11 = 0) AS labels_without_unit
    FROM (SELECT DISTINCT unit_id FROM trajectory)""", ("trajectory",))
def label_reconciliation(t):
    truth = rul_truth(t)
    known = truth.where("unit_id % 7 <> 0")
    stray = truth.where("unit_id % 11 = 0").withColumn("unit_id", -F.col("unit_id") - 1)
    return labels.reconcile_counts(t.trajectory(), known.unionByName(stray))


@query("w2_train_rul", f"""
    SELECT unit_id, cycle, least(CAST(terminal - cycle AS DOUBLE), 60.0E0) AS label
    FROM ({_TERMINAL})""", ("trajectory",))
def train_rul(t):
    return labels.life_target(t.trajectory(), 60.0).select("unit_id", "cycle", "label")


@query("w3_last_cycle", f"SELECT * EXCLUDE (terminal) FROM ({_TERMINAL}) "
                         "WHERE cycle = terminal", ("trajectory",))
def last_cycle(t):
    return labels.at_last_cycle(t.trajectory())


_TRAIN = f"""SELECT unit_id, cycle, terminal - cycle AS actual_rul,
      CASE WHEN terminal - cycle <= 30 THEN 1 ELSE 0 END AS failure_within_horizon
    FROM ({_TERMINAL})"""


@query("w4_horizon_label", _TRAIN, ("trajectory",))
def horizon_label(t):
    return labels.horizon_target(t.trajectory(), 30).select(
        "unit_id", "cycle", "actual_rul", "failure_within_horizon")


@query("a12_label_distribution", f"""
    SELECT count(*) AS "rows", count(DISTINCT unit_id) AS engines,
      CAST(sum(failure_within_horizon) AS BIGINT) AS positive_rows,
      round(sum(failure_within_horizon) / count(*), 6) AS positive_rate
    FROM ({_TRAIN})""", ("trajectory",))
def label_distribution(t):
    return rounded(labels.label_distribution(labels.horizon_target(t.trajectory(), 30)),
                   "positive_rate")


@query("a13_rul_bands", f"""
    SELECT CASE WHEN actual_rul <= 30 THEN '0-30' WHEN actual_rul <= 60 THEN '31-60'
      WHEN actual_rul <= 120 THEN '61-120' ELSE '121+' END AS rul_band, count(*) AS "rows"
    FROM ({_TEST}) GROUP BY 1""", ("trajectory",))
def rul_bands(t):
    return labels.rul_bands(labels.horizon_target(t.trajectory(), 30, rul_truth(t)))


@query("u3_distinct_engines", """
    SELECT count(DISTINCT unit_id) AS engines FROM trajectory""", ("trajectory",))
def distinct_engines(t):
    return t.trajectory().select("unit_id").distinct().agg(F.count("*").alias("engines"))


_NEXT = """SELECT t.event_id, t.source_sequence, (SELECT min(i.incident_time)
      FROM incidents i WHERE i.server_id = t.server_id AND i.incident_time > t.event_time
        AND i.incident_time <= t.event_time + INTERVAL '2' DAY) AS n, t.event_time
    FROM telemetry t"""
_LEAD = f"""SELECT event_id, source_sequence,
      (epoch_us(n) - epoch_us(event_time)) / 60000000.0E0 AS lead FROM ({_NEXT})"""


@query("j4_future_incident", f"""
    SELECT event_id, source_sequence, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS future_incident
    FROM ({_NEXT})""", ("telemetry", "incidents"))
def future_incident(t):
    return labels.future_incident(t.telemetry(), t.incidents(), TWO_DAYS).select(
        *KEY, "future_incident")


def _leads(t):
    return labels.lead_minutes(t.telemetry(), t.incidents(), TWO_DAYS)


@query("j5_lead_minutes", f"""
    SELECT event_id, source_sequence, round(lead, 6) AS lead_minutes FROM ({_LEAD})""",
       ("telemetry", "incidents"))
def lead_minutes(t):
    return rounded(_leads(t).select(*KEY, "lead_minutes"), "lead_minutes")
