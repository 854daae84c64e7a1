"""Frames that several query modules start from."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegate.functions.scores import hex_digit, logistic
from pulsegate.operators import labels, quality, routing, splits, workload
from pulsegate.plans.views import START, WINDOWS, Tables

VARIANTS = {"static_rf": ("p_static", 0.5), "weighted_retraining": ("p_adaptive", 0.5),
            "full_adaptive": ("p_adaptive", 0.6)}


def classified(t: Tables) -> DataFrame:
    return quality.classify_quality(t.telemetry())


def accepted(t: Tables) -> DataFrame:
    return quality.accepted(classified(t))


def routed(t: Tables) -> DataFrame:
    return routing.route_tasks(accepted(t))


def scored(t: Tables) -> DataFrame:
    """Accepted rows with their day and two rounded scores, so that ties occur."""
    frame = splits.with_experiment_day(routing.risk_scored(accepted(t)), START)
    return frame.withColumns({
        "p_static": F.round("risk_probability", 4),
        "p_adaptive": F.round(logistic((F.col("response_p50_ms") - 90.0) / 20.0), 4)})


def split_rows(t: Tables) -> DataFrame:
    return splits.with_split(scored(t), WINDOWS, in_training=hex_digit("event_id") < 11)


def evaluation(t: Tables) -> DataFrame:
    return scored(t).where(F.col("day").between(*WINDOWS["evaluation"]))


def hourly(t: Tables, by: list[str] | None = None) -> DataFrame:
    series = workload.workload_series(routed(t), "hour", by)
    return series.withColumn("event_minute", F.col("event_minute").cast("timestamp_ntz"))


def rul_truth(t: Tables) -> DataFrame:
    """One remaining-life value per unit of the trajectories."""
    return (t.trajectory().select("unit_id").distinct()
            .withColumn("rul_at_final_cycle", F.pmod("unit_id", F.lit(50)) + 5))


def rul_predictions(t: Tables) -> DataFrame:
    final = labels.at_last_cycle(t.trajectory())
    return final.select("unit_id", F.greatest(
        F.lit(0.0), F.lit(90.0) - F.col("cycle") + F.col("setting_1")).alias("predicted_rul"))


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})
