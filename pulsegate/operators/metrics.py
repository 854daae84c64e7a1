"""Exact binary metrics from score tables, and comparisons between prediction sets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.functions.scores import count_of, share
from pulsegate.operators.prefix import global_rank, running_totals
from pulsegate.schema import TARGET


def confusion(frame: DataFrame, score: str, threshold: Column | float, label: str = TARGET,
              by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn at a threshold (score >= threshold is an alert)."""
    alert = F.col(score) >= threshold
    positive = F.col(label) == 1
    return frame.groupBy(*(by or [])).agg(
        count_of(positive & alert).alias("tp"), count_of(~positive & alert).alias("fp"),
        count_of(positive & ~alert).alias("fn"), count_of(~positive & ~alert).alias("tn"))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; NULL where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "accuracy": share(tp + tn, tp + fp + fn + tn)})


def metrics_at(frame: DataFrame, score: str, threshold: Column | float, label: str = TARGET,
               by: list[str] | None = None) -> DataFrame:
    return with_ratios(confusion(frame, score, threshold, label, by))


def diagnostics(counts: DataFrame) -> DataFrame:
    """Rates derived from confusion counts; NULL instead of a division by zero."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    everything = tp + fp + fn + tn
    return counts.withColumns({
        "false_positive_rate": share(fp, fp + tn),
        "false_negative_rate": share(fn, fn + tp),
        "alert_rate": share(tp + fp, everything),
        "precision_lift": F.try_divide(share(tp, tp + fp), share(tp + fn, everything)),
        "false_alerts_per_true_alert": share(fp, tp)})


def score_points(frame: DataFrame, score: str, label: str = TARGET,
                 by: list[str] | None = None, chunks: int | None = None) -> DataFrame:
    """One row per distinct score with counts at that score and at or above it.

    Rows are reduced per (group, score) before ordering, so ties are exact and the ordered
    table is as long as the number of distinct scores.
    """
    counts = (frame.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*(by or []), F.col(score).alias("threshold"))
              .agg(count_of(F.col(label) == 1).alias("pos"),
                   count_of(F.col(label) != 1).alias("neg")))
    return running_totals(counts, by or [], "threshold", ["pos", "neg"], descending=True,
                          chunks=chunks)


def threshold_curve(points: DataFrame) -> DataFrame:
    """threshold, f1, precision, recall, tpr, fpr, accuracy for every distinct score."""
    counts = points.withColumns({
        "tp": F.col("run_pos"), "fp": F.col("run_neg"),
        "fn": F.col("total_pos") - F.col("run_pos"),
        "tn": F.col("total_neg") - F.col("run_neg")})
    curve = with_ratios(counts).withColumns({
        "tpr": F.col("recall"), "fpr": share(F.col("fp"), F.col("fp") + F.col("tn"))})
    return curve.drop("pos", "neg", "run_pos", "run_neg", "total_pos", "total_neg")


def precision_recall_points(points: DataFrame) -> DataFrame:
    """Precision and recall along falling score, starting from recall 0, precision 1."""
    walked = points.select(
        "threshold", share(F.col("run_pos"), F.col("total_pos")).alias("recall"),
        share(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"))
    start = points.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"))
    return start.unionByName(walked)


def areas(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (trapezoids over tied scores) and PR-AUC (step average precision)."""
    won = F.col("neg") * (F.col("run_pos") - F.col("pos") / 2.0)
    precision = share(F.col("run_pos"), F.col("run_pos") + F.col("run_neg"))
    positives, negatives = F.max("total_pos"), F.max("total_neg")
    return points.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(won), positives.cast("double") * negatives).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), positives.cast("double"))
        .alias("pr_auc"))


def effective_threshold(points: DataFrame, requested: float) -> DataFrame:
    """The observed score nearest to the requested one; the lower of two equally near."""
    gap = F.abs(F.col("threshold") - requested)
    return points.agg(F.min_by("threshold", F.struct(gap, F.col("threshold")))
                      .alias("threshold")).withColumn("requested_threshold", F.lit(requested))


def best_f1(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold of the largest F1; of equal ones the highest threshold."""
    return curve.groupBy(*(by or [])).agg(
        F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"),
        F.max("f1").alias("f1"))


def downsample_curve(curve: DataFrame, max_points: int = 250,
                     chunks: int | None = None) -> DataFrame:
    """Every ceil(n / max)-th point along falling threshold, plus the last one."""
    ranked = global_rank(curve, [F.desc("threshold")], chunks)
    step = F.ceil(F.col("total") / max_points)
    keep = ((F.col("total") <= max_points) | (F.pmod(F.col("rank") - 1, step) == 0)
            | (F.col("rank") == F.col("total")))
    return ranked.where(keep).drop("rank", "total")


def binary_summary(frame: DataFrame, score: str, threshold: float, label: str = TARGET,
                   chunks: int | None = None) -> DataFrame:
    """One row: requested and effective threshold, ratios, confusion counts and both areas."""
    points = score_points(frame, score, label, chunks=chunks)
    used = effective_threshold(points, threshold)
    at_used = threshold_curve(points).join(used, "threshold", "left_semi")
    both = areas(points)
    return at_used.drop("tpr", "fpr").withColumns({
        "requested_threshold": F.lit(float(threshold)),
        "roc_auc": both.select("roc_auc").scalar(),
        "pr_auc": both.select("pr_auc").scalar()})


def evaluation_by(frame: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows and positives per day and per server, reduced once to (day, server)."""
    cells = frame.groupBy("day", "server_id").agg(
        F.count("*").alias("rows"), F.sum(label).alias("positives"))
    grouped = cells.groupingSets([["day"], ["server_id"]], "day", "server_id").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.grouping("day").alias("_per_server"))
    kind = F.when(F.col("_per_server") == 1, "server").otherwise("day")
    name = F.when(F.col("_per_server") == 1, F.col("server_id")).otherwise(
        F.col("day").cast("string"))
    return grouped.select(kind.alias("grouping"), name.alias("member"), "rows", "positives",
                          share(F.col("positives"), F.col("rows")).alias("positive_rate"))


def evaluation_totals(frame: DataFrame, label: str = TARGET) -> DataFrame:
    per_server = frame.groupBy("server_id").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(label), F.lit(0)).alias("positives"))
    return per_server.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positive_rows"),
        F.count("*").alias("servers"),
        count_of(F.col("positives") == 0).alias("servers_without_positive_rows"))


def variants_long(frame: DataFrame, variants: dict[str, tuple[str, float]],
                  keep: list[str]) -> DataFrame:
    """Stack (score, threshold) variants of the same rows: columns variant, score, threshold."""
    cells = [F.struct(F.lit(name).alias("variant"), F.col(score).alias("score"),
                      F.lit(float(threshold)).alias("threshold"))
             for name, (score, threshold) in variants.items()]
    return frame.select(*keep, F.inline(F.array(*cells)))


def variant_metrics(frame: DataFrame, variants: dict[str, tuple[str, float]],
                    label: str = TARGET, by: list[str] | None = None) -> DataFrame:
    """Confusion, ratios, false-positive rate and PR-AUC per variant (and group)."""
    keys = [*(by or []), "variant"]
    stacked = variants_long(frame, variants, [*(by or []), label])
    counts = metrics_at(stacked, "score", F.col("threshold"), label, keys)
    curve_areas = areas(score_points(stacked, "score", label, keys), keys)
    return (counts.withColumn("fpr", share(F.col("fp"), F.col("fp") + F.col("tn")))
            .join(curve_areas, keys))


def scenario_summary(metrics: DataFrame, by: str) -> DataFrame:
    """One row per scenario: FPR of each variant and the three gain deltas."""
    names = ["static_rf", "weighted_retraining", "full_adaptive"]

    def pick(column: str, variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    return metrics.groupBy(by).agg(
        *[pick("fpr", name).alias(f"fpr_{name}") for name in names],
        (pick("pr_auc", names[1]) - pick("pr_auc", names[0]))
        .alias("ranking_pr_auc_weighted_minus_static"),
        (pick("f1", names[2]) - pick("f1", names[1])).alias("threshold_f1_full_minus_weighted"),
        (pick("f1", names[2]) - pick("f1", names[0])).alias("end_to_end_f1_full_minus_static"))


def missing_members(metrics: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected subsets without any metrics."""
    return expected.join(metrics.select(key).distinct(), key, "left_anti")


def require_members(metrics: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The metrics table, or an error when a subset of the short expected list is missing."""
    absent = [row[0] for row in missing_members(metrics, expected, key).take(20)]
    if absent:
        raise ValueError(f"no metrics for {key}: {absent}")
    return metrics


def stability_windows(frame: DataFrame, evaluation: list[int], window_days: int) -> DataFrame:
    """Add the evaluation window of each row; the last window may be short."""
    first, last = evaluation
    start = F.floor((F.col("day") - first) / window_days) * window_days + first
    return (frame.where(F.col("day").between(first, last))
            .withColumn("window_start_day", start.cast("int"))
            .withColumn("window_end_day",
                        F.least(start + window_days - 1, F.lit(last)).cast("int")))


def prediction_changes(before: DataFrame, after: DataFrame, key: str,
                       columns: list[str]) -> DataFrame:
    """One row: rows on both sides, keys on one side only, rows whose values differ."""
    left = before.select(key, F.struct(*columns).alias("before"))
    right = after.select(key, F.struct(*columns).alias("after"))
    joined = left.join(right, key, "full_outer")
    return joined.agg(
        F.count("before").alias("baseline_rows"), F.count("after").alias("candidate_rows"),
        count_of(F.col("after").isNull()).alias("only_baseline"),
        count_of(F.col("before").isNull()).alias("only_candidate"),
        count_of(F.col("before").isNotNull() & F.col("after").isNotNull()
                 & ~F.col("before").eqNullSafe(F.col("after"))).alias("changed_rows"),
    ).withColumn("identical", F.col("only_baseline") + F.col("only_candidate")
                 + F.col("changed_rows") == 0)


def non_regression(before: DataFrame, after: DataFrame, key: str, score: str, label: str,
                   threshold: float, tolerance: float = 0.01) -> DataFrame:
    """One row per metric with both values, the delta and whether it stays in tolerance."""
    names = ["precision", "recall", "f1", "accuracy"]

    def long(frame: DataFrame, side: str) -> DataFrame:
        return (metrics_at(frame, score, threshold, label).select(*names)
                .unpivot([], names, "metric", side))

    return (long(before, "baseline").join(long(after, "candidate"), "metric")
            .withColumn("delta", F.col("candidate") - F.col("baseline"))
            .withColumn("passed", F.abs("delta") <= tolerance))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counting copies, with their side."""
    return (left.exceptAll(right).withColumn("side", F.lit("left_only"))
            .unionByName(right.exceptAll(left).withColumn("side", F.lit("right_only"))))
