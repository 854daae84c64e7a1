"""Experiment days, leakage-safe splits, stable sampling, weights and folds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegate.functions.scores import count_of, hash_unit, share
from pulsegate.operators.prefix import grouped_rank
from pulsegate.schema import TARGET

# Default experiment windows.
DEFAULT_WINDOWS = {"initial_train": [1, 3], "feedback": [5, 5], "evaluation": [6, 7],
                   "stability_window_days": 1, "recency_weight": 4.0}
NEGATIVE_SHARE = 0.08


def experiment_origin(frame: DataFrame) -> DataFrame:
    return frame.agg(F.min(F.to_date("event_time")).alias("experiment_start"))


def with_experiment_day(frame: DataFrame, start: str) -> DataFrame:
    origin = F.lit(start).cast("date")
    return frame.withColumn("day", F.datediff(F.to_date("event_time"), origin) + 1)


def resolve_windows(configured: dict | None = None, overrides: dict | None = None) -> dict:
    """Defaults, then configuration, then explicit arguments; checks order and positivity.

    An override counts when it is not None, so an explicit 0 is rejected, not ignored.
    """
    resolved = {**DEFAULT_WINDOWS, **(configured or {})}
    resolved.update({k: v for k, v in (overrides or {}).items() if v is not None})
    ranges = ("initial_train", "feedback", "evaluation")
    for name in ranges:
        first, last = (int(day) for day in resolved[name])
        if not 0 < first <= last:
            raise ValueError(f"{name} is not a valid day range: {resolved[name]}")
        resolved[name] = [first, last]
    for before, after in zip(ranges, ranges[1:]):
        if resolved[before][1] >= resolved[after][0]:
            raise ValueError(f"{before} must end before {after} begins")
    for name, kind in (("stability_window_days", int), ("recency_weight", float)):
        resolved[name] = kind(resolved[name])
        if resolved[name] <= 0:
            raise ValueError(f"{name} must be positive")
    return resolved


def recent_days(evaluation: list[int], days: int) -> list[int]:
    """The last one or two evaluation days, not before the first one."""
    if days not in (1, 2):
        raise ValueError("recent window is one or two days")
    return [max(evaluation[0], evaluation[1] - days + 1), evaluation[1]]


def seventy_of_hundred(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(10)) < 7


def with_split(frame: DataFrame, windows: dict, recent: int = 2,
               in_training: Column | None = None, split_key: str = "event_id") -> DataFrame:
    """Label every row once: split by day, feedback cut by a hash of the split key.

    ``is_recent`` marks evaluation rows of the last days. Rows outside all windows keep a
    NULL split.
    """
    if split_key not in ("event_id", "server_id"):
        raise ValueError("split key must be event_id or server_id")
    day = F.col("day")
    training_part = in_training if in_training is not None else seventy_of_hundred(split_key)
    split = (F.when(day.between(*windows["initial_train"]), "pre_drift_train")
             .when(day.between(*windows["feedback"]) & training_part, "feedback_train")
             .when(day.between(*windows["feedback"]), "feedback_calibration")
             .when(day.between(*windows["evaluation"]), "evaluation"))
    return frame.withColumns({
        "split": split,
        "is_recent": day.between(*recent_days(windows["evaluation"], recent))})


def adaptive_training(labelled: DataFrame, drift_detected: Column | bool) -> DataFrame:
    """Pre-drift rows, plus feedback training rows if drift was detected."""
    gate = F.lit(drift_detected) if isinstance(drift_detected, bool) else drift_detected
    pre = labelled.where(F.col("split") == "pre_drift_train")
    feedback = labelled.where((F.col("split") == "feedback_train") & gate)
    return pre.unionByName(feedback)


def keep_positives(frame: DataFrame, label: str = TARGET, fraction: float = NEGATIVE_SHARE,
                   unit: Column | None = None, key: str = "event_id") -> DataFrame:
    """All positives and a hash-stable share of negatives, whatever the partitioning."""
    draw = unit if unit is not None else hash_unit(key)
    return frame.where((F.col(label) == 1) | ((F.col(label) == 0) & (draw < fraction)))


def with_recency_weight(frame: DataFrame, feedback: list[int], weight: float) -> DataFrame:
    return frame.withColumn(
        "sample_weight", F.when(F.col("day").between(*feedback), F.lit(float(weight)))
        .otherwise(1.0))


def complete_rows(frame: DataFrame, features: list[str], label: str = TARGET) -> DataFrame:
    return frame.dropna(subset=[*features, label])


def three_way_split(frame: DataFrame, unit: Column | None = None,
                    key: str = "event_id") -> DataFrame:
    """60/20/20 by hash of the key."""
    draw = unit if unit is not None else hash_unit(key)
    return frame.withColumn("part", F.when(draw < 0.6, "train").when(draw < 0.8, "validation")
                            .otherwise("test"))


def stratified_folds(frame: DataFrame, label: str, key: str, folds: int = 10) -> DataFrame:
    """Fold 0..k-1 per label, balanced to within one row.

    Rows are ranked inside a label by md5 of their unique key. The ranks are found over ranges
    of rows of about equal size, so a label has as many pieces as its rows need: no window
    sorts a whole class, and nothing is broadcast.
    """
    digest = F.md5(F.col(key).cast("string"))
    ranked = grouped_rank(frame.withColumn("_digest", digest), [label],
                          [F.col("_digest").asc(), F.col(key).asc()])
    return (ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int"))
            .drop("_digest", "rank", "total"))


def split_counts(frame: DataFrame, by: str = "split", label: str = TARGET) -> DataFrame:
    return frame.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(label), F.lit(0)).alias("positive_rows"))


def split_priors(frame: DataFrame, label: str = TARGET) -> DataFrame:
    """Positive rate per split and its multiple of the evaluation rate (four rows)."""
    rates = (split_counts(frame.where(F.col("split").isNotNull()), "split", label)
             .withColumn("positive_rate", share(F.col("positive_rows"), F.col("rows"))))
    every = Window.partitionBy()
    prior = F.max(F.when(F.col("split") == "evaluation", F.col("positive_rate"))).over(every)
    return rates.withColumn("prior_multiple", F.try_divide("positive_rate", prior))


def split_overlap(frame: DataFrame) -> DataFrame:
    """Event ids that occur in more than one split; must be empty."""
    return (frame.where(F.col("split").isNotNull()).groupBy("event_id")
            .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
            .where("first_split <> last_split"))


def split_overlap_counts(frame: DataFrame) -> DataFrame:
    per_id = (frame.where(F.col("split").isNotNull()).groupBy("event_id")
              .agg(F.min("split").alias("lo"), F.max("split").alias("hi")))
    return per_id.agg(F.count("*").alias("ids"),
                      count_of(F.col("lo") != F.col("hi")).alias("ids_in_two_splits"))


def surrogate_event_id(frame: DataFrame, namespace: str, parts: list[str]) -> DataFrame:
    """Stable id of a logical observation from the columns that identify it."""
    key = F.concat_ws(":", F.lit(namespace), *[F.col(p).cast("string") for p in parts])
    return frame.withColumn("surrogate_id", F.md5(key))
