"""Queries on drift and metrics: D1-D4, A16-A22, A24-A27, W10, W11, L9, L10, J7, J8."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegate.operators import drift, metrics, splits
from pulsegate.plans.common import VARIANTS, accepted, evaluation, rounded, scored
from pulsegate.plans.registry import query
from pulsegate.plans.views import DRIFT_DAYS, START, WINDOWS
from pulsegate.schema import DRIFT_FEATURES, TARGET
from pulsegate.staging import stage

_RATIOS = ("precision", "recall", "f1", "accuracy")


def drift_long(t):
    dated = splits.with_experiment_day(accepted(t), START)
    return drift.drift_windows(dated, *DRIFT_DAYS)


_SIDES = "CASE WHEN day BETWEEN 1 AND 10 THEN 'reference' ELSE 'current' END"
_COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in DRIFT_FEATURES)
_LONG = " UNION ALL ".join(
    f"SELECT {_SIDES} AS \"window\", '{f}' AS feature, {f} AS value FROM scored "
    f"WHERE (day BETWEEN 1 AND 10 OR day BETWEEN 15 AND 17) AND {_COMPLETE} "
    "AND cpu_util_pct BETWEEN 0 AND 100 AND memory_util_pct BETWEEN 0 AND 100"
    for f in DRIFT_FEATURES)
_KS = f"""SELECT feature, max(abs(r / nr - c / nc)) AS d, max(nr) AS nr, max(nc) AS nc FROM (
      SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY value) AS r,
        sum(b) OVER (PARTITION BY feature ORDER BY value) AS c,
        CAST(sum(a) OVER (PARTITION BY feature) AS BIGINT) AS nr,
        CAST(sum(b) OVER (PARTITION BY feature) AS BIGINT) AS nc
      FROM (SELECT feature, value, count(*) FILTER (WHERE "window" = 'reference') AS a,
        count(*) FILTER (WHERE "window" = 'current') AS b FROM ({_LONG}) GROUP BY 1, 2))
    GROUP BY feature"""
_P = f"""SELECT *, CASE WHEN d = 0 THEN 1.0E0 ELSE least(1.0E0, greatest(0.0E0, list_sum(
      list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0E0 ELSE -2.0E0 END)
        * exp(-2.0E0 * k * k * x * x))))) END AS p
    FROM (SELECT *, (sqrt(e) + 0.12E0 + 0.11E0 / sqrt(e)) * d AS x
      FROM (SELECT *, nr * nc * 1.0E0 / (nr + nc) AS e FROM ({_KS})))"""


@query("d1_drift_windows", _LONG, ("scored",))
def drift_windows(t):
    return drift_long(t)


@query("d2_ks", f"""
    SELECT feature, round(d, 6) AS ks_d, nr AS reference_rows, nc AS current_rows
    FROM ({_KS})""", ("scored",))
def ks(t):
    return rounded(drift.ks_by_feature(drift_long(t)).drop("p_value"), "ks_d")


@query("d3_ks_p_value", f"SELECT feature, round(p, 6) AS p_value FROM ({_P})", ("scored",))
def ks_p_value(t):
    return rounded(drift.ks_by_feature(drift_long(t)).select("feature", "p_value"), "p_value")


@query("d4_drift_gate", f"""
    SELECT round(max(d), 6) AS max_ks_d,
      count(*) FILTER (WHERE d > 0.05) AS features_over_threshold,
      bool_or(d > 0.05 AND p < 0.05) AS drift_detected FROM ({_P})""", ("scored",))
def drift_gate(t):
    return rounded(drift.drift_gate(drift.ks_by_feature(drift_long(t)), 0.05), "max_ks_d")


def _counts(score: str, threshold: str, by: str = "", source: str = "scored") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    y, a = "failure_within_30min = 1", f"{score} >= {threshold}"
    return (f"SELECT {keys}count(*) FILTER (WHERE {y} AND {a}) AS tp, "
            f"count(*) FILTER (WHERE NOT {y} AND {a}) AS fp, "
            f"count(*) FILTER (WHERE {y} AND NOT {a}) AS fn, "
            f"count(*) FILTER (WHERE NOT {y} AND NOT {a}) AS tn FROM {source}{group}")


_RATIO_SQL = ("round(tp / nullif(tp + fp, 0), 6) AS \"precision\", "
              "round(tp / nullif(tp + fn, 0), 6) AS recall, "
              "round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, "
              "round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy")


@query("a16_confusion", _counts("p_static", "0.5"), ("scored",))
def confusion(t):
    return metrics.confusion(scored(t), "p_static", 0.5)


@query("a17_threshold_metrics", f"""
    SELECT *, {_RATIO_SQL} FROM ({_counts("p_static", "0.5")})""", ("scored",))
def threshold_metrics(t):
    return rounded(metrics.metrics_at(scored(t), "p_static", 0.5), *_RATIOS)


@query("a21_diagnostics", f"""
    SELECT tp, fp, fn, tn, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate,
      round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate,
      round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate,
      round((tp / nullif(tp + fp, 0)) / nullif((tp + fn) / (tp + fp + fn + tn), 0), 6)
        AS precision_lift,
      round(fp / nullif(tp, 0), 6) AS false_alerts_per_true_alert
    FROM ({_counts("p_static", "0.5")})""", ("scored",))
def diagnostics(t):
    frame = metrics.diagnostics(metrics.confusion(scored(t), "p_static", 0.5))
    return rounded(frame, "false_positive_rate", "false_negative_rate", "alert_rate",
                   "precision_lift", "false_alerts_per_true_alert")


def _points(score: str, source: str = "scored", by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}threshold, pos, neg,
        CAST(sum(pos) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS tp,
        CAST(sum(neg) OVER ({part}ORDER BY threshold DESC) AS BIGINT) AS fp,
        CAST(sum(pos) OVER ({part}) AS BIGINT) AS p,
        CAST(sum(neg) OVER ({part}) AS BIGINT) AS n
      FROM (SELECT {keys}{score} AS threshold,
          count(*) FILTER (WHERE failure_within_30min = 1) AS pos,
          count(*) FILTER (WHERE failure_within_30min <> 1) AS neg
        FROM {source} GROUP BY {keys}{score})"""


def _areas(points: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}sum(neg * (tp - pos / 2.0E0)) / (max(p) * max(n)) AS roc_auc, "
            f"sum(pos * (tp / (tp + fp))) / max(p) AS pr_auc FROM ({points}){group}")


_CURVE_SQL = ("round(tp / nullif(p, 0), 6) AS tpr, round(fp / nullif(n, 0), 6) AS fpr, "
              "round(tp / nullif(tp + fp, 0), 6) AS \"precision\", "
              "round(tp / nullif(p, 0), 6) AS recall, "
              "round(2 * tp / (tp + p + fp), 6) AS f1, "
              "round((tp + n - fp) / (p + n), 6) AS accuracy, "
              "tp, fp, p - tp AS fn, n - fp AS tn")


def points(t, score="p_adaptive"):
    return metrics.score_points(scored(t), score)


def curve(t, score="p_adaptive"):
    return rounded(metrics.threshold_curve(points(t, score)), *_RATIOS, "tpr", "fpr")


@query("a18_effective_threshold", f"""
    SELECT threshold, CAST(0.503 AS DOUBLE) AS requested_threshold
    FROM ({_points("p_adaptive")}) ORDER BY abs(threshold - 0.503E0), threshold LIMIT 1""",
       ("scored",))
def effective_threshold(t):
    return metrics.effective_threshold(points(t), 0.503)


@query("a19_roc_auc", f"""
    SELECT round(roc_auc, 6) AS roc_auc FROM ({_areas(_points("p_static"))})""", ("scored",))
def roc_auc(t):
    return rounded(metrics.areas(points(t, "p_static")).select("roc_auc"), "roc_auc")


@query("a20_pr_auc", f"""
    SELECT round(pr_auc, 6) AS pr_auc FROM ({_areas(_points("p_static"))})""", ("scored",))
def pr_auc(t):
    return rounded(metrics.areas(points(t, "p_static")).select("pr_auc"), "pr_auc")


@query("w10_precision_recall", f"""
    SELECT threshold, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS "precision"
    FROM ({_points("p_static")}) UNION ALL SELECT NULL, 0.0, 1.0""", ("scored",))
def precision_recall(t):
    return rounded(metrics.precision_recall_points(points(t, "p_static")),
                   "precision", "recall")


@query("w11_threshold_curve", f"""
    SELECT threshold, {_CURVE_SQL} FROM ({_points("p_adaptive")})""", ("scored",))
def threshold_curve(t):
    return curve(t)


@query("l9_curve_downsample", f"""
    SELECT threshold, {_CURVE_SQL} FROM (
      SELECT *, row_number() OVER (ORDER BY threshold DESC) AS i, count(*) OVER () AS m
      FROM ({_points("p_adaptive")}))
    WHERE m <= 100 OR (i - 1) % CAST(ceil(m / 100.0E0) AS BIGINT) = 0 OR i = m""",
       ("scored",))
def curve_downsample(t):
    return metrics.downsample_curve(curve(t), 100)


def _best(source: str) -> str:
    return f"""SELECT threshold, round(f1, 6) AS f1 FROM (
        SELECT threshold, 2 * tp / (tp + p + fp) AS f1
        FROM ({_points("p_adaptive", source)}))
      ORDER BY round(f1, 6) DESC, threshold DESC LIMIT 1"""


@query("l10_best_f1", _best("scored"), ("scored",))
def best_f1(t):
    return metrics.best_f1(curve(t))


_EVALUATION = "(SELECT * FROM scored WHERE day BETWEEN 22 AND 30)"


@query("a24_post_hoc_best_f1", _best(_EVALUATION), ("scored",))
def post_hoc_best_f1(t):
    found = metrics.score_points(evaluation(t), "p_adaptive")
    return metrics.best_f1(rounded(metrics.threshold_curve(found), "f1"))


@query("a22_evaluation_by", f"""
    SELECT 'day' AS "grouping", CAST(day AS VARCHAR) AS member, count(*) AS "rows",
      CAST(sum(failure_within_30min) AS BIGINT) AS positives,
      round(sum(failure_within_30min) / count(*), 6) AS positive_rate
    FROM {_EVALUATION} GROUP BY day UNION ALL
    SELECT 'server', server_id, count(*), CAST(sum(failure_within_30min) AS BIGINT),
      round(sum(failure_within_30min) / count(*), 6)
    FROM {_EVALUATION} GROUP BY server_id""", ("scored",))
def evaluation_by(t):
    return rounded(metrics.evaluation_by(evaluation(t)), "positive_rate")


@query("a22_evaluation_totals", f"""
    SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(p) AS BIGINT) AS positive_rows,
      count(*) AS servers, count(*) FILTER (WHERE p = 0) AS servers_without_positive_rows
    FROM (SELECT server_id, count(*) AS n, sum(failure_within_30min) AS p
      FROM {_EVALUATION} GROUP BY server_id)""", ("scored",))
def evaluation_totals(t):
    return metrics.evaluation_totals(evaluation(t))


def _variants_sql(by: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {by}, '{name}' AS variant, {score} AS score, {threshold} AS threshold, "
        "failure_within_30min FROM scored" for name, (score, threshold) in VARIANTS.items())
    keys = f"{by}, variant"
    counts = _counts("score", "threshold", keys, f"({rows})")
    areas = _areas(_points("score", f"({rows})", keys), keys)
    return (f"SELECT c.*, roc_auc, pr_auc, tp / nullif(tp + fp, 0) AS \"precision\", "
            "tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, "
            "(tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, "
            f"fp / nullif(fp + tn, 0) AS fpr FROM ({counts}) c JOIN ({areas}) a "
            f"USING ({keys})")


def variants(t, by):
    return metrics.variant_metrics(scored(t), VARIANTS, by=[by])


def _pick(column: str, variant: str) -> str:
    return f"max(CASE WHEN variant = '{variant}' THEN {column} END)"


@query("a25_scenario_summary", f"""
    SELECT service_name, round({_pick('fpr', 'static_rf')}, 6) AS fpr_static_rf,
      round({_pick('fpr', 'weighted_retraining')}, 6) AS fpr_weighted_retraining,
      round({_pick('fpr', 'full_adaptive')}, 6) AS fpr_full_adaptive,
      round({_pick('pr_auc', 'weighted_retraining')} - {_pick('pr_auc', 'static_rf')}, 6)
        AS ranking_pr_auc_weighted_minus_static,
      round({_pick('f1', 'full_adaptive')} - {_pick('f1', 'weighted_retraining')}, 6)
        AS threshold_f1_full_minus_weighted,
      round({_pick('f1', 'full_adaptive')} - {_pick('f1', 'static_rf')}, 6)
        AS end_to_end_f1_full_minus_static
    FROM ({_variants_sql("service_name")}) GROUP BY service_name""", ("scored",))
def scenario_summary(t):
    summary = metrics.scenario_summary(variants(t, "service_name"), "service_name")
    return rounded(summary, *[c for c in summary.columns if c != "service_name"])


@query("a26_subset_table", f"""
    SELECT data_center_id, variant, tp, fp, fn, tn, round("precision", 6) AS "precision",
      round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
      round(fpr, 6) AS fpr, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
    FROM ({_variants_sql("data_center_id")})""", ("scored",))
def subset_table(t):
    table = variants(t, "data_center_id")
    return rounded(table, *_RATIOS, "fpr", "roc_auc", "pr_auc")


@query("a27_stability", f"""
    SELECT w AS window_start_day, least(w + 1, 30) AS window_end_day, tp, fp, fn, tn,
      {_RATIO_SQL} FROM ({_counts("p_adaptive", "0.6", "w", f'''(SELECT *,
        CAST(22 + floor((day - 22) / 2) * 2 AS INT) AS w FROM {_EVALUATION})''')})""",
       ("scored",))
def stability(t):
    windows = metrics.stability_windows(scored(t), WINDOWS["evaluation"], 2)
    keys = ["window_start_day", "window_end_day"]
    return rounded(metrics.metrics_at(windows, "p_adaptive", 0.6, by=keys), *_RATIOS)


@query("a17_binary_summary", f"""
    SELECT c.*, roc_auc, pr_auc, CAST(0.5 AS DOUBLE) AS requested_threshold FROM (
      SELECT threshold, tp, fp, p - tp AS fn, n - fp AS tn,
        round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / p, 6) AS recall,
        round(2 * tp / (tp + p + fp), 6) AS f1, round((tp + n - fp) / (p + n), 6) AS accuracy
      FROM ({_points("p_adaptive")}) ORDER BY abs(threshold - 0.5), threshold LIMIT 1) c,
      (SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
       FROM ({_areas(_points("p_adaptive"))}))""", ("scored",))
def binary_summary(t):
    return rounded(metrics.binary_summary(scored(t), "p_adaptive", 0.5), *_RATIOS,
                   "roc_auc", "pr_auc")


@query("j7_attach_predictions", """
    SELECT event_id, event_time, server_id, failure_within_30min, p_adaptive AS p1
    FROM scored""", ("scored",))
def attach_predictions(t):
    rows = stage(scored(t).select("event_id", "event_time", "server_id", TARGET, "p_adaptive"),
                 "stored-predictions")
    stored = rows.select("event_id", F.col("p_adaptive").alias("p1"))
    return rows.drop("p_adaptive").join(stored, "event_id")


_CHANGED = "CASE WHEN p_static > 0.4 THEN round(p_static, 2) ELSE p_static END"


def prediction_sets(t):
    before = scored(t).select("event_id", TARGET, F.col("p_static").alias("p1"))
    after = (scored(t).where("service_name = 'feed'")
             .select("event_id", TARGET, F.expr(_CHANGED).alias("p1")))
    return before, after


@query("j8_prediction_changes", f"""
    SELECT *, only_baseline + only_candidate + changed_rows = 0 AS identical FROM (
      SELECT count(*) AS baseline_rows,
        count(*) FILTER (WHERE service_name = 'feed') AS candidate_rows,
        count(*) FILTER (WHERE service_name <> 'feed') AS only_baseline,
        CAST(0 AS BIGINT) AS only_candidate,
        count(*) FILTER (WHERE service_name = 'feed' AND {_CHANGED} <> p_static)
          AS changed_rows FROM scored)""", ("scored",))
def prediction_changes(t):
    before, after = prediction_sets(t)
    return metrics.prediction_changes(before, after, "event_id", ["p1"])


_SIDE = "SELECT unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric, unnest([" \
        "tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), " \
        "(tp + tn) / (tp + fp + fn + tn)]) AS v FROM ({})"


@query("j8_non_regression", f"""
    SELECT metric, round(b.v, 6) AS baseline, round(c.v, 6) AS candidate,
      round(c.v - b.v, 6) AS delta, abs(c.v - b.v) <= 0.01 AS passed
    FROM ({_SIDE.format(_counts("p_static", "0.45"))}) b
    JOIN ({_SIDE.format(_counts(f"({_CHANGED})", "0.45", "",
                                "(SELECT * FROM scored WHERE service_name = 'feed')"))}) c
    USING (metric)""", ("scored",))
def non_regression(t):
    before, after = prediction_sets(t)
    return rounded(metrics.non_regression(before, after, "event_id", "p1", TARGET, 0.45),
                   "baseline", "candidate", "delta")
