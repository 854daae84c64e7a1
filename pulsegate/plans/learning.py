"""Queries that fit models: M2-M12, M14. All settings are the defaults of the library.

Fitted values have no SQL twin. The ``*_facts`` queries take what must hold for any fit (keys,
counts, ranges) from the same results, and those have one.
"""
from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from pulsegate.functions.scores import hex_digit
from pulsegate.operators import drift, labels, metrics, models, splits
from pulsegate.operators.models import AdaptiveRun
from pulsegate.plans.common import accepted, scored, split_rows
from pulsegate.plans.registry import query
from pulsegate.plans.views import DRIFT_DAYS, WINDOWS
from pulsegate.schema import BASE_FEATURES, TARGET
from pulsegate.staging import stage

LIFE_FEATURES = ["cycle", "setting_1", "sensor_1", "sensor_2"]
FOLDS = 10

_fitted: dict[tuple[str, str, str], object] = {}


def _once(t, name: str, make: Callable):
    """``make()``, once per application and folder: queries of one folder share their fits."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def forget_fits() -> None:
    """Fit anew from now on, as a timing needs it."""
    _fitted.clear()


def _life(t):
    """Trajectories with both labels; units are split by hash into train and test."""
    def make():
        frame = labels.horizon_target(labels.life_target(t.trajectory(), 60.0), 30)
        return stage(frame.withColumn("held", hex_digit("unit_id") < 4), "life")
    frame = _once(t, "life", make)
    return frame.where("NOT held"), frame.where("held")


def _folded(t) -> DataFrame:
    """Training rows of the horizon models with their stratified fold."""
    def make():
        keyed = _life(t)[0].withColumn("row_key", F.concat_ws("-", "unit_id", "cycle"))
        return stage(splits.stratified_folds(keyed, labels.HORIZON_LABEL, "row_key", FOLDS),
                     "folds")
    return _once(t, "folds", make)


def _rul_report(t, pipeline):
    train, test = _life(t)
    predicted = models.predict_rul(pipeline.fit(models.spread(train)), test, ["unit_id", "label"])
    errors = predicted.withColumn("actual_rul", F.col("label"))
    error = F.col("predicted_rul") - F.col("actual_rul")
    return labels.regression_report(errors.withColumns({
        "error": error, "absolute_error": F.abs(error),
        "nasa_penalty": labels.asymmetric_penalty(error)}))


@query("m2_linear_rul")
def linear_rul(t):
    return _rul_report(t, models.linear_rul(LIFE_FEATURES))


@query("m3_boosted_rul")
def boosted_rul(t):
    return _rul_report(t, models.boosted_rul(LIFE_FEATURES))


def _predicted(t) -> DataFrame:
    train, test = _life(t)
    model = _once(t, "linear", lambda: models.linear_rul(LIFE_FEATURES).fit(train))
    return models.predict_rul(model, test, ["unit_id", "cycle"])


@query("m4_floored_predictions")
def floored_predictions(t):
    return _predicted(t)


@query("m4_prediction_facts", """
    SELECT unit_id, cycle, TRUE AS floored FROM trajectory
    WHERE substr(md5(CAST(unit_id AS VARCHAR)), 1, 1) < '4'""", ("trajectory",))
def prediction_facts(t):
    return _predicted(t).select("unit_id", "cycle", (F.col("predicted_rul") >= 0).alias("floored"))


def _fold_report(t) -> DataFrame:
    def make():
        forest = models.forest(LIFE_FEATURES, labels.HORIZON_LABEL)
        return stage(models.cross_validated(forest, _folded(t), labels.HORIZON_LABEL, FOLDS),
                     "fold-report")
    return _once(t, "fold-report", make)


@query("m5_forest_folds")
def forest_folds(t):
    return _fold_report(t)


# a horizon of 30 cycles: the last 31 rows of each unit are positive
_TRAIN_SQL = """
    SELECT CAST(max(cycle) OVER (PARTITION BY unit_id) - cycle <= 30 AS INT) AS y FROM trajectory
    WHERE substr(md5(CAST(unit_id AS VARCHAR)), 1, 1) {} '4'"""


@query("m5_fold_facts", f"""
    SELECT {FOLDS} AS folds, count(*) AS held_rows, sum(y) AS positives
    FROM ({_TRAIN_SQL.format('>=')})""", ("trajectory",))
def fold_facts(t):
    return _fold_report(t).agg(
        F.count("*").cast("int").alias("folds"),
        F.sum(F.expr("tp + fp + fn + tn")).alias("held_rows"),
        F.sum(F.expr("tp + fn")).alias("positives"))


def _compared(t, names: list[str]) -> DataFrame:
    """One metric row per model; each model is fitted once for all queries."""
    label = labels.HORIZON_LABEL
    estimators = {
        "logistic_regression": models.ridge_logistic(LIFE_FEATURES, label, FOLDS),
        "random_forest": models.forest(LIFE_FEATURES, label),
        "gradient_boosting": models.boosted(LIFE_FEATURES, label)}
    rows = [_once(t, name, lambda name=name: stage(models.compare_models(
        {name: estimators[name]}, _folded(t), _life(t)[1]), name)) for name in names]
    return reduce(DataFrame.unionByName, rows)


@query("m6_ridge_logistic")
def ridge_logistic(t):
    return _compared(t, ["logistic_regression"])


@query("m7_boosted_classifier")
def boosted_classifier(t):
    return _compared(t, ["gradient_boosting"])


@query("m8_model_comparison")
def model_comparison(t):
    return _compared(t, ["logistic_regression", "random_forest", "gradient_boosting"])


@query("m8_comparison_facts", f"""
    SELECT model, count(*) AS held_rows, sum(y) AS positives
    FROM ({_TRAIN_SQL.format('<')}), (VALUES ('logistic_regression'), ('random_forest'),
      ('gradient_boosting')) AS m(model) GROUP BY model""", ("trajectory",))
def comparison_facts(t):
    rows = _compared(t, ["logistic_regression", "random_forest", "gradient_boosting"])
    return rows.select("model", F.expr("tp + fp + fn + tn").alias("held_rows"),
                       F.expr("tp + fn").alias("positives"))


def adaptive_run(t) -> AdaptiveRun:
    """The adaptive protocol, gated by the drift that the data show."""
    def make():
        found = drift.ks_by_feature(drift.drift_windows(scored(t), *DRIFT_DAYS))
        detected = bool(drift.drift_gate(found).first()["drift_detected"])
        return AdaptiveRun(split_rows(t), WINDOWS, detected, BASE_FEATURES, TARGET)
    return _once(t, "adaptive", make)


@query("m9_adaptive_variants")
def adaptive_variants(t):
    return adaptive_run(t).variant_report()


_COMPLETE = " AND ".join(f"{name} IS NOT NULL" for name in [*BASE_FEATURES, TARGET])


@query("m9_variant_facts", f"""
    SELECT variant, count(*) AS evaluated, sum({TARGET}) AS positives
    FROM splits, (VALUES ('static_rf'), ('weighted_retraining'), ('full_adaptive')) AS v(variant)
    WHERE split = 'evaluation' AND {_COMPLETE} GROUP BY variant""", ("splits",))
def variant_facts(t):
    report = adaptive_run(t).variant_report().where("variant <> 'unweighted_retraining'")
    return report.select("variant", F.expr("tp + fp + fn + tn").alias("evaluated"),
                         F.expr("tp + fn").alias("positives"))


@query("m9_adaptive_stability")
def adaptive_stability(t):
    return adaptive_run(t).stability()


@query("m10_calibrated_threshold")
def calibrated_threshold(t):
    run = adaptive_run(t)
    held = models.scored_by(
        run.adaptive, models.spread(run.rows.where("split = 'feedback_calibration'")))
    return metrics.metrics_at(held, "p1", run.threshold).withColumn(
        "threshold", F.lit(run.threshold))


@query("m11_health_snapshot")
def health_snapshot(t):
    return adaptive_run(t).health_snapshot()


@query("m11_threshold_alerts")
def threshold_alerts(t):
    return adaptive_run(t).threshold_alerts()


@query("m12_attributions")
def attributions(t):
    return adaptive_run(t).explanations()


@query("m12_attribution_facts", "SELECT TRUE AS every_alert_once, TRUE AS adds_up")
def attribution_facts(t):
    """Every alert has one row, and contributions and bias add up to its probability."""
    run = adaptive_run(t)
    parts = sum((F.col(f"{name}_contribution") for name in BASE_FEATURES), F.col("BiasTerm"))
    rows = run.explanations().agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"),
        F.coalesce(F.max(F.abs(parts - F.col("p1"))), F.lit(0.0)).alias("off"))
    alerts = run.evaluated().where(F.col("p_adaptive") >= run.threshold).agg(
        F.count("*").alias("alerts"))
    return rows.crossJoin(alerts).select(
        F.expr("rows = alerts AND ids = alerts").alias("every_alert_once"),
        (F.col("off") < 1e-9).alias("adds_up"))


@query("m14_balanced_baseline")
def balanced_baseline(t):
    parted = splits.three_way_split(splits.complete_rows(accepted(t), BASE_FEATURES))
    rows = stage(parted.select("part", *BASE_FEATURES, TARGET), "baseline-rows")
    train = models.with_class_weight(rows.where("part = 'train'"), TARGET)
    model = models.baseline_forest(BASE_FEATURES, TARGET).fit(models.spread(train))
    tested = models.scored_by(model, models.spread(rows.where("part = 'test'")))
    return metrics.binary_summary(tested, "p1", 0.5)
